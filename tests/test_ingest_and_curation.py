"""Ingest against plain Python, the answer graph's branches, patient calls, drafting and stores."""

import bisect

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunking, cleaning, curation, embedding, flow, structure
from scriptorium.operators.ingest import ingest
from scriptorium.sources import tables

SIZES = {"recursive": {"size": 12, "overlap": 3}, "parent_child": {"parent": 30, "child": 8}}


def _book(spark):
    pages = []
    for book, n in (("a", 9), ("b", 4), ("c", 2)):
        for i in range(n):
            body = "" if (book, i) == ("b", 1) else "\n".join(f"Word{i} says thing {k} of page {i}. It is bro-\nken here." for k in range(1 + i % 4))
            pages.append((book, i, f"Running head\n{body}\n{i + 3}"))
    toc = [("a", 0, 1, "One", 1), ("a", 1, 2, "Inner", 4), ("a", 2, 1, "Two", 4), ("a", 3, 1, "Three", 7), ("b", 0, 1, "Only", 0), ("a", 4, 1, "Beyond", 40)]
    books = [("a", "A", 3), ("b", "B", -2), ("c", "C", None)]
    return spark.createDataFrame(pages, "book string, page_num int, text string"), spark.createDataFrame(toc, "book string, seq int, level int, title string, page int"), spark.createDataFrame(books, "book string, doc_id string, page_offset int"), toc, books


@pytest.mark.parametrize("strategy", ["recursive", "parent_child"])
def test_ingest_equals_a_loop_over_books(spark, strategy):
    pages, toc, books, outline, info = _book(spark)
    chunks, parents, counts = ingest(pages, toc, books, strategy, **SIZES[strategy])
    clean = {(r.book, r.page_num): r.text for r in cleaning.clean(pages).collect()}
    crumbs = {(r.book, r.page_num): r.path for r in structure.breadcrumbs(toc, pages.select("book", "page_num")).collect()}
    want, above = [], []
    for book, doc_id, shift in info:
        n = sum(b == book for b, _ in clean)
        borders = sorted({0} | {p for b, _, _, _, p in outline if b == book and p < n})
        seq = 0
        for first, end in zip(borders, [*borders[1:], n]):
            texts = [clean[book, i] for i in range(first, end)]
            starts, at = [], 0
            for t in texts:
                starts.append(at)
                at += len(t) + 2
            text = "\n\n".join(texts)
            if not text.strip():
                continue
            page_of = lambda x: first + bisect.bisect_right(starts, x) - 1  # noqa: B023, E731

            def row(span, kind, parent=None):
                nonlocal seq
                seq += 1
                page = page_of(span[1])  # noqa: B023
                printed = shift is not None and page + shift >= 1
                return (f"{book}:{kind}:{seq:06d}", doc_id, span[0], len(span[0].split()), page, page_of(max(span[1], span[2] - 1)), page + shift if printed else page + 1, "printed" if printed else "physical", tuple(crumbs[book, page]), parent)  # noqa: B023

            if strategy == "recursive":
                want += [row(s, "rec") for s in chunking.split_recursive(text, 12, 3)]
            else:
                for p, children in chunking.split_parent_child(text, 30, 8):
                    above.append(row(p, "par"))
                    want += [row(c, "chd", above[-1][0]) for c in children]
    columns = ["chunk_id", "doc_id", "text", "n_tokens", "page_start", "page_end", "cite_page", "cite_kind", "breadcrumb", "parent_id"]
    plain = lambda df: sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())
    assert plain(chunks) == sorted(want, key=lambda r: r[0]) and len(want) > 10
    assert plain(parents) == sorted(above, key=lambda r: r[0])
    found = {r.book: (r.n_pages, r.toc_entries, r.header_lines_removed > 0) for r in counts.collect()}
    assert found == {"a": (9, 5, True), "b": (4, 1, True), "c": (2, 0, True)}
    with pytest.raises(KeyError):
        ingest(pages, toc, books, "windows")


def test_graph_decomposes_and_rewrites_once(spark):
    state = spark.createDataFrame([(1, "good question", None), (2, "bad question", "user: before")], "qid long, question string, history string")
    asked = []

    def found(queries):
        asked.append(queries)
        listed = queries.groupBy("qid").agg(F.array_sort(F.collect_list("query")).alias("q"))
        return listed.select("qid", F.array_join("q", "|").alias("context"), F.transform("q", lambda x, i: F.concat(F.lit("S"), i + 1)).alias("sids"))

    nodes = {"memory": True, "decompose": True, "crag": True}
    config = flow.GraphConfig(
        retrieve=found, nodes=nodes, condense=lambda p: p.str.split("\n").str[-1], decompose=lambda p: "1. part of " + p + "\n2. rest of " + p,
        grade=lambda p: p.str.contains("bad").map({True: "1: no", False: "1: yes"}), rewrite=lambda p: "better " + p, template="{context}?{question}", generate=lambda p: p + " [S1] [S7]",
    )
    rows = {r.qid: r for r in flow.answer(state, config).collect()}
    assert rows[1].answer == "good question|part of good question|rest of good question?good question [S1] [S7]"
    assert rows[2].answer == "bad question|better bad question?bad question [S1] [S7]" and rows[2].sids == ["S1", "S2"]
    assert rows[1].trace == ["start_turn", "condense", "decompose", "retrieve", "grade", "generate"]
    served = flow.serve(flow.answer(state, config), F.create_map(F.lit("S1"), F.lit("Book, p. 1")), F.when(F.col("qid") == 2, "jailbreak"), F.lit(0.9), F.lit(True))
    got = {r.qid: r for r in served.collect()}
    assert got[2].blocked == "injection" and got[2].reply is None and got[1].report.fabricated == ["S7"] and "Book, p. 1" in got[1].reply


def test_patient_calls():
    calls, waits = [], []

    def flaky(prompt, **how):
        calls.append(how)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert flow.patient(flaky, wait=waits.append)(pd.Series(["x"])).tolist() == ["done"] and waits == [1, 2]
    for error, most in ((TypeError("bug"), 1), (OSError("402 Payment Required"), 1), (OSError("model not found"), 1), (OSError("busy"), 4)):
        calls.clear()

        def fails(prompt, error=error, **how):
            calls.append(how)
            raise error

        with pytest.raises((TypeError, RuntimeError)):
            flow.patient(fails, wait=waits.append)(pd.Series(["x"]))
        assert len(calls) == most
    calls.clear()

    def thinks(prompt, **how):
        calls.append(how)
        return "answer" if len(calls) == 2 else "<think>too long</think> "

    assert flow.patient(thinks, max_tokens=100)(pd.Series(["x"])).tolist() == ["answer"]
    assert calls == [{"max_tokens": 100, "temperature": 0.0, "seed": None}, {"max_tokens": 2100, "temperature": 0.8, "seed": 7}]


def test_drafts_have_equal_books_and_far_pairs(spark):
    pool = spark.createDataFrame([(b, f"{b}{i}", [f"s{i // 3}"], i) for b, n in (("x", 200), ("y", 30), ("z", 1)) for i in range(n)], "book string, chunk_id string, breadcrumb array<string>, page_start int")
    rows = curation.draft_plan(pool).orderBy("job").collect()
    assert [r.job for r in rows] == list(range(1, 81)) and {b: sum(r.book == b for r in rows) for b in "xyz"} == {"x": 29, "y": 27, "z": 24}
    pairs = [r for r in rows if r.second is not None and r.book == "x"]
    assert pairs and all(int(r.first[1:]) // 3 != int(r.second[1:]) // 3 and abs(int(r.first[1:]) - int(r.second[1:])) > 5 for r in pairs)
    assert rows == curation.draft_plan(pool.repartition(5)).orderBy("job").collect()
    assert curation.draft_plan(pool.limit(0)).count() == 0


def test_keyword_search(spark):
    chunks = spark.createDataFrame([("a", i, ["Ch"], f"line one\nhas a.b{'c' * (i % 2)} in it") for i in range(5)] + [("a", 9, ["Index"], "a.b"), ("b", 1, ["Ch"], "A.B")], "book string, chunk_id long, breadcrumb array<string>, text string")
    rows = curation.keyword_search(chunks, "a.b", context=4).orderBy("book", "place").collect()
    assert [(r.book, r.hits, r.chunk_id, r.snippet) for r in rows] == [("a", 5, 0, "has a.b in "), ("a", 5, 1, "has a.bc in"), ("a", 5, 2, "has a.b in "), ("b", 1, 1, "A.B")]
    assert curation.keyword_search(chunks, "a.b", whole_word=True, books=["a"]).first().hits == 3
    assert curation.keyword_search(chunks, "a.?bc", regex=True).first().hits == 2


def test_registry_store_and_outline(spark, tmp_path):
    with pytest.raises(KeyError):
        embedding.get_embedder("nope")
    embedding.register_embedder("narrow", embedding.HashEmbedder, dim=8, query_prefix="query: ")
    assert embedding.get_embedder("narrow").dim == 8 and embedding.load_spec("hash") == {"dim": 64}
    rows = spark.createDataFrame([("1", "a b"), ("2", "c"), ("1", "a b")], "hash string, text string")
    path = f"{tmp_path}/store"
    for frame in (rows.where("hash = '1'"), rows, rows):
        embedding.write_vectors(frame, path, "hash", "recursive")
    stored = embedding.read_vectors(spark, path, "hash", "recursive")
    assert stored.count() == 2 and embedding.require_vectors(rows, stored).count() == 3
    assert [r.hash for r in embedding.beyond_context(rows, 2, F.length("text")).distinct().collect()] == ["1"]
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "a.txt.toc").write_text("1\tStart\t0\n2\tMore\t1\n")
    spark.dataSource.register(tables.OutlineSource)
    found = spark.read.format("outline").option("path", f"{tmp_path}/*.txt").load().orderBy("seq").collect()
    assert [(r.level, r.title, r.page) for r in found] == [(1, "Start", 0), (2, "More", 1)]
