"""Every operator against plain Python, on documents with every awkward case."""

import base64
import bz2
import gzip
import hashlib
import itertools
import json
import lzma
import math
import random
import re
import urllib.parse
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, language_id, mixing, near_dedup, quality_net, quality_rules, queries, secret_scan, suffix_dedup, token_counts, url_filter
from tests.llm import brute
from tests.parity import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, id long, class string, passes_taken string"


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 7)))
    vocabulary = [word() for _ in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    texts = []
    for _ in range(30):
        edited = list(base)
        for _ in range(r.randint(0, 9)):
            edited[r.randrange(150)] = r.choice(vocabulary)
        texts.append(" ".join(edited))
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80))) + "." for _ in range(25)]
    texts += ["one two three four. " * 9, "same line.\nsame line.\nother\n\nother", "Home | About | Help | Login", "### ***", "ab" * 150 + " " + "ab" * 90]
    texts += [None, None, "", "  \n\t ", "a", "don't <|endoftext|> I'll ﬁ 12½ \u0301x", " ".join(r.choice(vocabulary) for _ in range(20_000))]
    out = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s3", None)[min(i % 7, 3)], None, "k", 1, 2, "c", "p") for i, t in enumerate(texts)]
    return out + [out[3], (None, "null key with some text", "en", "s1", 1, "k", 1, 2, "c", "p")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def unique():
    return {r[0]: r[1] for r in rows() if r[0] is not None}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_sql_of_all(spark, sf):
    for name, sql in queries.ORACLE_SQL.items():
        assert compare(queries.QUERIES[name](spark, sf), duck(sf), sql) == "", name


def test_token_counts(spark, docs, unique, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for size in (0, 10, token_counts.DICTIONARY):
        got = by_id(token_counts.token_counts(docs, path, dictionary=size, sample=20))
        for i, t in unique.items():
            n = len(library.encode(t or "", add_special_tokens=False))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.token_counts(docs, path).count() == docs.count()
    assert token_counts.token_counts(empty, path).count() == 0


def test_quality_rules(docs, unique, empty):
    got = by_id(quality_rules.quality_rules(docs))
    for i, t in unique.items():
        t = t or ""
        words = brute.WORD.findall(t)
        windows = list(zip(words, words[1:], words[2:]))
        covered = {k + o for k, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)} if len(words) < 500 else None
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        if covered is not None:
            assert r.n_repeat_words == len(covered)
            assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0


def test_line_rules(spark):
    prose = " ".join(f"word{k}" for k in range(60)) + " and then we all walked home."
    notice = "Read our privacy policy!\nHome. Login.\na | b | c. d e f g h i j k l m n\nwell!! so?? it!!! is."
    lines = [(1, prose), (2, f"{prose}\n{notice}"), (3, " ".join(f"word{k}" for k in range(60))), (4, f"{notice}\n" * 12)]
    got = {r.doc_id: r for r in quality_rules.measure(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, True, False, False]  # prose, prose with a menu, no sentence, menus only
    assert got[1].clean_text == got[2].clean_text == prose and got[3].clean_text == got[4].clean_text == ""
    assert quality_rules.measure(spark.createDataFrame([(5, "so?!??! it!!! is.")], "doc_id long, text string")).first().clean_text == ""


def test_mixing(docs, unique, empty, spark):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    sizes = {}
    for r in out:
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = {r.source: r.target for r in out}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    for s in order:
        assert targets[s] == pytest.approx(want[s])
        taken = sum(r.taken for r in out if r.source == s)
        assert abs(taken - want[s]) <= max(r.size for r in out if r.source == s)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    again = mixing.mixed(docs)
    assert set(docs.columns) == set(again.columns)


@pytest.mark.parametrize("heavy", [suffix_dedup.HEAVY_BYTES, 0])
def test_suffix_dedup(spark, docs, unique, empty, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", heavy)  # 0: every hash is dealt out again, down to whole strings
    want = brute.repeated_bytes(list(unique.items()))
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        n, removed, runs, left = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) == (n, removed, runs, hashlib.sha256(left).hexdigest(), left), r.doc_id
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_of_texts_with_one_key(spark):
    a, b = ("".join(random.Random(k).choices("abcdefgh ", k=400)) for k in (1, 2))
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a[:300] + b[200:]), (3, "x" * 5000), (4, "x" * 99)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs, with_text=False).collect())
    assert got == [(1, 400, 0, 0)] * 3 + [(2, 500, 500, 1), (3, 5000, 4999, 1), (4, 99, 0, 0)]


def test_merge_of_small_shards(spark, sf, monkeypatch):
    """All segments through tasks of many shards, texts in parts, and hashes split by every longer piece."""
    for name, value in (("BLOCK_BYTES", 4096), ("SHARD_BYTES", 4096), ("TASK_BYTES", 32 << 10)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000").collect()]
    want = brute.repeated_bytes(texts)
    column = pa.array([t for _, t in sorted(texts)])
    ids = np.array([i for i, _ in sorted(texts)])
    for piece in suffix_dedup.PIECES[:3]:
        rows = []
        for row, data, at, shift in suffix_dedup._parts(column):
            s = suffix_dedup.segments(data, at, piece)
            for k in range(len(s.hashes)):
                begin = at[s.text[k]] + s.start[k]
                rows.append((s.hashes[k] % np.uint64(999_983), ids[row + s.text[k]], 0, shift + s.start[k], s.n[k], True, data[begin : begin + s.n[k] + 99].tobytes()))
        rows.sort(key=lambda x: x[0])
        names = ["h", "id", "v", "start", "n", "several", "bytes"]
        table = pa.table({c: pa.array([r[k] for r in rows]) for k, c in enumerate(names)})
        found = {}
        for batch in suffix_dedup._merged(iter(table.to_batches(200))):
            for r in batch.to_pylist():
                found.setdefault(r["id"], []).append((r["a"], r["b"]))
        for i, t in texts:
            assert suffix_dedup.cut_out((t or "").encode(), found.get(i, ())) == want[i]


def test_interleave_finds_equal_contexts():
    r = np.random.default_rng(1)
    texts = [r.integers(0, 3, n).astype(np.uint16) for n in (50, 33, 71)]
    for depth in (1, 3, 6):
        for sorted_by in (1, depth):
            shards, orders, every = [], [], []
            for t in texts:
                order, before = suffix_dedup.transform(t, sorted_by)
                shards.append(before)
                orders.append(order)
                every += [tuple(np.resize(np.roll(t, -i), depth)) for i in order]
            merged, block = suffix_dedup.interleave(shards, orders, [np.arange(len(x)) for x in shards], depth)
            want = {}
            for k, x in enumerate(every):
                want.setdefault(x, set()).add(k)
            got = {}
            for k, g in zip(merged.tolist(), block.tolist()):
                got.setdefault(g, set()).add(k)
            assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_language_forward_pass():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁ab": 5}
    table = np.vstack([np.random.default_rng(2).random((6, 2)), np.full((1, 2), language_id.UNSEEN)])
    scorer = language_id.Scorer(["x", "y"], pieces, table)

    def every(w):
        if not w:
            yield np.ones(2)
        for n in range(1, len(w) + 1):
            if w[:n] in pieces:
                for rest in every(w[n:]):
                    yield table[pieces[w[:n]]] * rest

    for n in range(1, 6):
        for letters in itertools.product("ab", repeat=n):
            w = "".join(letters)
            assert np.exp(scorer._short(["▁" + w])[0]) == pytest.approx(sum(every("▁" + w)), rel=1e-4)
            assert scorer._long("▁" + w) == pytest.approx(scorer._short(["▁" + w])[0])
    assert np.isfinite(scorer._long("▁" + "ab" * 5000)).all()


def test_language_id(spark, docs, unique, empty):
    path = queries.vocabulary("piece_bpe_32k.model")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(real, path).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    out = by_id(language_id.language_id(docs, path))
    for i, t in unique.items():
        assert (out[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t or ""))
        assert 0 <= out[i].score <= 1
        assert out[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 4 == 2)
    assert language_id.language_id(empty, path).count() == 0


SECRET = 'password = "hunter2hunter2"'


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: s,
        lambda s: urllib.parse.quote(s, safe=""),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: urllib.parse.quote(base64.b64encode(base64.b64encode(gzip.compress(s.encode()))).decode(), safe=""),
    ],
)
def test_secret_layers(wrap):
    text = "é 漢 " + wrap(SECRET) + " end"
    base, every = secret_scan.findings(text)
    assert [k for k, _, _ in every] == ["assign"] and set(base) <= set(every)
    _, start, end = every[0]
    assert 4 <= start < end <= len(text) - 4
    assert "hunter2" not in secret_scan.redact(text, [{"start": start, "end": end}])
    assert secret_scan.findings(secret_scan.redact(text, [{"start": start, "end": end}]))[1] == []


def masked(text):
    return secret_scan.redact(text, [{"start": a, "end": b} for _, a, b in secret_scan.findings(text)[1]])


def test_same_encoded_secret_twice():
    secret = b"password=hunter2hunter2"
    plain, packed = base64.b64encode(secret).decode(), base64.b64encode(gzip.compress(secret, mtime=0)).decode()
    for text, n in ((f"a {plain} b\na {plain} b", 2), (f"{plain} and {packed} and {packed}", 3)):
        assert len(secret_scan.findings(text)[1]) == n
        assert plain not in masked(text) and secret_scan.findings(masked(text))[1] == []


def wrapped(data, width, end="\n"):
    text = base64.b64encode(data).decode()
    return end.join(text[i : i + width] for i in range(0, len(text), width))


PACKED = gzip.compress(b", some other text, " * 3 + SECRET.encode(), mtime=0)


@pytest.mark.parametrize(
    "text",
    [p + base64.b64encode(x).decode() + q for p in ("v1/", "id-", "ab/", "/cfg/", "data_", "a", "") for q in ("", "-end", "/x") for x in (SECRET.encode(), PACKED, zlib.compress(PACKED))]
    + ["see\n" + wrapped(x, n, end) + "\nThe end" for n in (8, 16, 19, 64) for end in ("\n", "\r\n", "\n    ", "\\n") for x in (b"-" * 50 + SECRET.encode(), PACKED)]
    + [urllib.parse.quote(PACKED, safe=""), "".join(f"%{b:02x}" for b in PACKED), "%ff" + urllib.parse.quote(SECRET, safe="")]
    + ["".join(f"\\x{b:02x}" for b in PACKED), "".join(f"\\u{b:04x}" for b in PACKED), json.dumps(PACKED.decode("latin-1")), repr(PACKED)],
)
def test_hidden_secret_layers(text):
    assert secret_scan.findings(text)[1] and re.search(secret_scan.ANYTHING, text)
    assert secret_scan.findings(masked(text))[1] == []


def deflated(data):
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("pack", [bz2.compress, lzma.compress, deflated, lambda x: bz2.compress(b"x" * 40) + bz2.compress(x), lambda x: lzma.compress(base64.b64encode(bz2.compress(x)))])
def test_kinds_of_compression(pack):
    data = pack(b", some other text, " * 3 + SECRET.encode())
    texts = ["v1/" + base64.b64encode(data).decode() + "-end", "see\n" + wrapped(data, 19) + "\nThe end"]
    if pack is not deflated:  # it is told by where it ends, so only as a whole layer
        texts.append("".join(f"\\x{b:02x}" for b in data))
    for text in texts:
        assert secret_scan.findings(text)[1] and re.search(secret_scan.ANYTHING, text)
        assert secret_scan.findings(masked(text))[1] == []


def test_secret_behind_a_long_layer():
    text = base64.b64encode(gzip.compress(b"," * (65 << 20) + SECRET.encode(), mtime=0)).decode()
    assert secret_scan.findings("a " + text + " b") == ([], [("assign", 2, 2 + len(text))])


def test_secret_scan(docs, unique, empty, spark):
    assert secret_scan.scan("secret: token: abcdefghijklmnop") == []
    assert secret_scan.scan("xAKIA" + "A" * 14)[0] == ("access", 1, 19)
    assert secret_scan.scan("pa\u017fsword=abcdefghijklmnop") == []
    texts = [(1, "Token='abcdefghijkl' and 0123456789abcdef."), (2, None), (3, "")]
    out = by_id(secret_scan.digest(secret_scan.secrets(spark.createDataFrame(texts, "doc_id long, text string"))))
    assert (out[1].n_assign, out[1].n_access, out[1].n_hex) == (1, 0, 1)
    assert out[1].spans == "assign:0:19,hex:25:41"
    assert out[2].spans == "" and out[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.secrets(docs).count() == docs.count() and secret_scan.secrets(empty).count() == 0
    assert secret_scan.redacted(docs).columns == docs.columns


def test_base_secrets_of_all_documents(spark):
    """The query's base columns against plain Python, for every document; the method only adds spans."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op6_secret_scan(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute.base_secrets(texts[r.doc_id])
        spans = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in secret_scan.KINDS)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in out) > 0


def test_url_filter(spark):
    urls = [f"http://h{i % 3}.example.com/{'de' if i % 2 else 'en'}/{i}" for i in range(60)]
    urls += ["HTTP://A.NET/x", "http://net/", "http://a.net", "http://www.Example.NET/en/1?q#f", "http://x.org/fr/", "http://x.org/frx", "no scheme", None, "", "a://b://c/d", "http://notnet/x", "http://x.example.com/de"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, template string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate({k: k + 32 for k in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, got[i].verdict)  # the tree's, which test_url_tree checks
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *rule), u
    assert url_filter.judge(pages.limit(0)).count() == 0


def tree_rows(urls):
    return [(i, u, "x", "y", 1) for i, u in enumerate(urls)]


def test_url_tree(spark):
    """The whole tree against plain Python, on hosts of every kind."""
    r = random.Random(3)
    urls = []
    for host, share in (("a.example.com", 0.5), ("b.example.com", 0.1), ("www.x.org", 0.4), ("new.io", 0.0), ("mixed.org", 0.5)):
        for k in range(120):
            head = "/de/" if "com" in host and r.random() < share else "/fr/" if "org" in host and r.random() < share else r.choice(["/en/", "/it/", "/about", "/deadbeef01/", "/", "", "/~/", "/*/", f"/s{k}/"])
            urls.append(f"http://{host}{head}{r.choice(['', f'{k}', f'{k}.html', 'page', f'x/{k}/y', 'p/' * r.randint(1, 12)])}")
    urls += [f"http://many.example.com/{'de' if k < 21 else f'c{k % 30}'}/{k}" for k in range(200)] + urls[:30] + ["http://deep.org/" + "a/" * 300, None, "x"]
    pages = spark.createDataFrame(tree_rows(urls), "page_id long, url string, host string, template string, n long")
    got = {x.page_id: x for x in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    want = brute.url_templates([(got[i].host, got[i].path, {None: None, "block": 1, "allow": 0}[got[i].verdict if got[i].rule else None]) for i in range(len(urls))])
    for i in range(len(urls)):
        template, labelled, purity = want[got[i].host, got[i].path]
        assert (got[i].template, got[i].purity) == (template, pytest.approx(purity)), urls[i]
        assert got[i].rule or got[i].verdict == ("block" if purity >= url_filter.REJECT else "allow")
    assert sum(1 for x in got.values() if not x.rule and x.verdict == "block") > 50
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_tree_rejects_what_its_siblings_taught(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/{'bad' if i % 2 else 'good'}/{i}") for i in range(120)] + [(999, "http://a.com/bad/777/x"), (None, "http://a.com/good/5")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules=[("block", "a.com", "/bad/1"), ("allow", "a.com", "/good/2")]).collect()}
    assert got[35] == got[999] == "block" and got[34] == "allow" and got[None] == "allow"


@pytest.mark.parametrize("few", [0, decontaminate.BROADCAST_HASHES])
def test_decontaminate(spark, docs, unique, empty, few):
    long = unique[max(i for i, t in unique.items() if t and len(t) > 10_000)].split()
    common = long[700:720]
    items = [(1, " ".join(long[5000:5030])), (2, " ".join(long[9000:9010] + ["zz"] + long[9011:9060])), (3, "not in any document at all today"), (4, "a b"), (5, None), (6, ""), (7, " ".join(long[40:43])), (8, "one two three four."), (9, "a")]
    items += [(10 + k, " ".join(common + long[800 + 20 * k : 810 + 20 * k])) for k in range(10)] + [(1, items[0][1])]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, h string")
    want = set()
    for n, t in items:
        w = brute.WORD.findall(t or "")
        size = min(len(w), 5)
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for i, d in unique.items():
            v = brute.WORD.findall(d or "")
            k = len(s & {tuple(v[j : j + size]) for j in range(len(v) - size + 1)})
            if s and 100 * k >= 80 * len(s):
                want.add((i, n, k, len(s)))
    got = decontaminate.leaks(docs, bench, few=few).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got} == want and len(got) == len(want) and {1, 2, 7, 8} <= {n for _, n, _, _ in want}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_convolution_against_a_direct_one():
    r = np.random.default_rng(9)
    net = quality_net.start_net()
    net.mean, net.top, net.offset = r.normal(size=16), r.normal(size=16), r.normal(size=16)
    for n in (0, 1, 5, 255, 256, 257, 1500):
        data = r.integers(0, 256, n).astype(np.uint8)
        padded = np.concatenate((data, np.zeros(6, np.uint8)))
        response = np.array([sum(net.vectors[padded[i + k]] @ net.filters[k] for k in range(6)) for i in range(max(n, 1))])
        starts = range(0, max(n - 256, 1), 256)
        pooled = np.array([np.maximum(response[a : a + 512].max(0) + net.offset, 0) for a in starts])
        want = 1 / (1 + np.exp(-(pooled.mean(0) @ net.mean + pooled.max(0) @ net.top + net.bias)))
        assert quality_net.combine(net, quality_net.block_maxima(net.tables(), data)) == pytest.approx(want, rel=1e-4)


def test_learning_sums_over_all_segmentations():
    mark, pieces, counts = "\u2581", ["\u2581", "a", "b", "ab", "\u2581a", "ba"], {"ab": 3, "aab": 1, "ba": 2}

    def cuts(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in pieces or n == 1:
                for rest in cuts(w[n:]):
                    yield [w[:n]] * (w[:n] in pieces) + rest
                    if n == 1 and w[:n] in pieces:
                        yield [None, *rest]

    start = {}
    for w, n in counts.items():
        w = mark + w
        for p in pieces:
            start[p] = start.get(p, 0) + n * sum(w.startswith(p, i) for i in range(len(w)))
    prob = {p: x / sum(start.values()) for p, x in start.items()}
    expected = dict.fromkeys(prob, 0.0)
    for w, n in counts.items():
        ways = [(c, math.prod(prob[p] if p else language_id.UNKNOWN for p in c)) for c in cuts(mark + w)]
        for c, q in ways:
            for p in c:
                if p:
                    expected[p] += n * q / sum(x for _, x in ways)
    got = language_id.learn(counts, pieces, 1)
    for p, x in expected.items():
        assert got[p] == pytest.approx(x / sum(expected.values()), rel=1e-6)


def test_quality_net(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_net.quality(real, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93
    assert out[out.quality == 1].predicted.mean() > 0.97
    some = quality_net.quality(docs, labels.limit(0))
    assert some.count() == docs.count() and some.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality_net.quality(empty, labels.limit(0)).count() == 0


def test_near_dedup(spark, docs, unique, empty):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    want = brute.classes(list(unique.items()))
    assert {i: c for i, c in got.items() if i is not None} == want
    assert near_dedup.near_duplicates(docs).count() == docs.count()
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)] + [(5, 5)]
    root = {}
    for a, b in links * 60:
        if a != b:
            m = min(root.get(a, a), root.get(b, b))
            root[a] = root[b] = m
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"), few)
    assert {x.id: x["class"] for x in got.collect() if x.id != x["class"]} == {i: c for i, c in root.items() if i != c}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_cells_of_long_texts_give_all_links():
    r = np.random.default_rng(6)
    base = r.integers(1, 1 << 60, 20_000)
    sets = [np.unique(np.concatenate([base[: 20_000 - 40 * k], r.integers(1, 1 << 60, 30 * k)])) for k in range(60)]
    rows = pd.DataFrame({"id": np.arange(60), "class": np.arange(60), "n": [len(s) for s in sets], "side": np.arange(60) % 2, "shingles": sets})
    got = {tuple(x) for x in near_dedup._cell_links(80)(rows)[["a", "b"]].to_numpy().tolist()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 != j % 2 and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
    assert got == want and want


def test_near_dedup_of_repeated_lines(spark, tmp_path):
    r = random.Random(8)
    texts = []
    for _ in range(6):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(words), " ".join(words + words[40:60] * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duck(str(tmp_path))
    want = dict(con.sql(near_dedup.ORACLE_SQL).fetchall())
    assert want == {i: i // 2 * 2 for i in range(12)}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == want


def test_signature_estimates_probability_jaccard():
    from scriptorium.llm.shingles import Shingles

    r = np.random.default_rng(3)
    element = r.integers(1, 1 << 62, 300).astype(np.uint64)
    wa, wb = r.integers(1, 5, 300).astype(float), r.integers(1, 5, 300).astype(float)
    wa[:60], wb[-60:] = 0, 0
    real = sum(1 / sum(max(x / wa[d], y / wb[d]) for x, y in zip(wa, wb)) for d in range(300) if wa[d] and wb[d])
    sign = [near_dedup.signatures(Shingles(np.zeros((w > 0).sum(), int), element[w > 0]), w[w > 0], 1, 2048)[0] for w in (wa, wb)]
    assert abs((sign[0] == sign[1]).mean() - real) < 5 * math.sqrt(real * (1 - real) / 2048)
