"""The pipeline's stages against plain Python on their own inputs."""

import corpus_pipeline
from scriptorium.llm import mixing, secret_scan
from tests.llm import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name != "mixing":
            assert docs.columns == names
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "near_dedup":
            classes = brute.classes([(i, r.text) for i, r in before.items()])
            assert set(after) == set(classes.values())
        elif name == "decontamination":
            items = [brute.WORD.findall(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in items]
            leaks = {i for i, r in before.items() if any(s and 100 * len(s & brute.shingle_set(r.text)) >= 80 * len(s) for s in sets)}
            assert leaks and set(after) == set(before) - leaks
        elif name == "secret_scan":
            assert set(after) == set(before)
            for i, r in after.items():
                assert secret_scan.findings(r.text)[1] == [] and r.n_chars == len(r.text)
                if not secret_scan.findings(before[i].text)[1]:
                    assert r.text == before[i].text
        else:
            taken = {r.doc_id: r.taken // r.size for r in mixing.mix(spark.read.parquet(f"{tmp_path}/{k - 1}")).collect() if r.taken}
            assert {i: r.passes_taken for i, r in after.items()} == taken
        before = after


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3)), (4, text(4)), (4, text(5)), (None, text(6)), (None, text(7)), (None, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    order = lambda x: sorted(x, key=str)
    assert order(kept) == order([rows[0], rows[2], rows[3], *rows[5:]])
    spark.createDataFrame([(1, text(4)), (2, text(6))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [tuple(r) for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()]
    assert order(clean) == order([*rows[:5], rows[6], *rows[8:]])


def test_stages_on_awkward_rows(spark, sf, tmp_path):
    """Nulls everywhere, empty and long texts, repeated rows, clashing names; then no rows at all."""
    words = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and length(text) > 500").limit(6).collect()]
    rows = [(k, t, "en", "s", len(t), 1, 2, 3, "x") for k, t in enumerate(words)] + [(50, words[0], "en", None, None, 1, 2, 3, "x"), (1, words[1], "en", "s", len(words[1]), 1, 2, 3, "x"), (None, words[2], None, "s", None, 1, 2, 3, None)]
    rows += [(60, None, None, None, None, None, None, None, None), (61, "", "en", "s", 0, 1, 2, 3, "x"), (62, "1 2 3", "fr", "s", 5, 1, 2, 3, "x"), (63, (words[3] + " ") * 200, "en", "t", None, 1, 2, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, _mix long, _language long, id string")
    spark.createDataFrame([(1, words[4]), (None, words[5]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        "language_id": [r for r in rows if r[1] and r[0] != 62],
        "near_dedup": [r for k, r in enumerate(rows) if k not in (6, 7) and r[0] not in (61, 63)],  # 63 has the shingles of 3
        "decontamination": [r for r in rows if r[0] != 4],
        "secret_scan": [(*r[:4], None if r[1] is None else len(r[1]), *r[5:]) for r in rows],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = [tuple(r) for r in out.collect()]
        if name in want:
            assert out.columns == docs.columns
            assert sorted(map(str, got)) == sorted(map(str, want[name])), name
        else:
            assert set(out.columns) == {*docs.columns, "passes_taken"} and all(r.text and r.text.strip() for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
