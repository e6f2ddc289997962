"""Near duplicates by ProbMinHash signatures, banding and verification.

A text is its distinct five-word shingles, each of weight 1, as links are defined on them. For every register the
signature holds the shingle that arrives first, where a shingle's arrivals are a Poisson process with its weight as rate
and each arrival falls on a random register. A shingle is followed only until its next arrival would come after the last
register's current first one, so long texts cost little more than one arrival a shingle. Two texts agree on a register
with the probability Jaccard similarity of their weighted shingles; with weights of 1 it is the Jaccard similarity of
the sets, the measure that links are verified by.

Texts with equal words are collapsed first. The remaining ones are banded. Inside a bucket no pairs are listed:
members are compared with one member (the hub), links join them to classes, and this is repeated with another hub. What
then still lies in different classes of one bucket is compared member by member, so no link is lost; only pairs whose
similarity an exact bound leaves open (by their sizes and the shingles that each has alone) are formed. Every link is
verified on the distinct shingles of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if_small, cut, discard, small_batches
from scriptorium.llm.shingles import BASE, GOLDEN, U, Shingles, blocks, distinct, mix, shingle_hashes, word_hashes

BANDS, ROWS = 32, 5
#: Rounds with one hub a bucket before what is left in a bucket is compared member by member.
HUB_ROUNDS = 2
#: Buckets with more comparisons left than this are compared in cells of about CELL x CELL members, others by a join.
MANY, CELL = 2_048, 256
#: Shared shingles of a cell that are multiplied at once; links that one task unites (some 200 MB).
COLUMNS, FEW_LINKS = 4_096, 1_000_000


def signatures(s: Shingles, weights: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the shingle that arrives first at each register (0 for a text without shingles)."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    text, element, rate = s.text, s.hashes, weights.astype(float)
    clock, step = np.zeros(len(text)), 0
    while len(text):
        ahead = int(np.clip(4096 // len(text), 1, 64))  # few shingles left: several arrivals at once
        noise = mix(element[:, None] + GOLDEN * np.arange(step + 1, step + 1 + ahead, dtype=np.uint64))
        gaps = -np.log1p(-(noise >> U(11)).astype(float) * 2.0**-53) + 1e-300
        arrivals = clock[:, None] + np.cumsum(gaps / rate[:, None], axis=1)
        at = (text[:, None] * registers + (mix(noise ^ BASE) % U(registers)).astype(np.int64)).ravel()
        np.minimum.at(first, at, arrivals.ravel())
        won = first[at] == arrivals.ravel()
        winner[at[won]] = np.repeat(element, ahead)[won]
        last = first.reshape(texts, registers).max(axis=1)
        clock, step = arrivals[:, -1], step + ahead
        on = clock < last[text]
        text, element, rate, clock = text[on], element[on], rate[on], clock[on]
    return winner.reshape(texts, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for k in range(rows):
        out = out * BASE + signature[:, k::rows][:, :bands]
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)


def _signed(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks(batch.column(1)):
                keys, texts = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
                words = word_hashes(texts)
                s, _ = distinct(shingle_hashes(words, size))
                marks = band_hashes(signatures(s, np.ones(len(s.text)), len(texts), bands * rows), bands, rows).view(np.int64)
                same = [xxhash.xxh3_128_digest(words.hashes[a:b].tobytes()) for a, b in zip(words.first, words.first[1:])]
                counts = np.bincount(s.text, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(same, pa.binary()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * bands, pa.array(marks.ravel()))],
                    names=["id", "words", "n", "bands"],
                )

    return run


def _shingled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks(batch.column(1)):
                keys, texts = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
                s, _ = distinct(shingle_hashes(word_hashes(texts), size))
                ends = np.searchsorted(s.text, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(s.hashes.view(np.int64)))], names=["id", "shingles"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) of one task -> (id, class) by union of trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    if root:
        ids = sorted(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "class"])


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(a, b) links -> (id, class): the least id that each linked id reaches.

    At most `few` links are united in one task. More are contracted by large-star and small-star in turn: a vertex's
    neighbours are never gathered, their minimum is aggregated and joined back to the links.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    if edges.count() <= few:
        out = cut(edges.coalesce(1).mapInArrow(_united, "id long, class long"))
        discard(edges)
        return out
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, edges = edges, cut(small)
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            out = cut(edges.select(F.col("u").alias("id"), F.col("v").alias("class")))
            discard(edges)
            return out
        before = now


def _similar(pairs: DataFrame, shingled: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of ids, those whose distinct shingles have a Jaccard similarity of percent/100 or more."""
    joined = pairs.join(shingled.toDF("a", "sa"), "a").join(shingled.toDF("b", "sb"), "b")
    shared = joined.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("k"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    return shared.where((F.col("na") + F.col("nb") > 0) & (100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k")))).select("a", "b")


def _cell_links(percent: int):
    """Links of one cell: its members on the first side against those on the second, by products of shared shingles."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = (rows[rows["side"] == k] for k in (0, 1))
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(one) or not len(two):
            return none
        flat = [np.concatenate(x["shingles"].to_list()) for x in (one, two)]
        both = np.intersect1d(*map(np.unique, flat))
        if not len(both):
            return none
        held = []
        for x, values in zip((one, two), flat):
            owner = np.repeat(np.arange(len(x)), x["shingles"].str.len())
            at = np.minimum(np.searchsorted(both, values), len(both) - 1)
            hit = both[at] == values
            by = np.argsort(at[hit], kind="stable")
            held.append((len(x), owner[hit][by], at[hit][by]))
        k = np.zeros((len(one), len(two)), np.int64)
        for begin in range(0, len(both), COLUMNS):  # tables of bounded width, however long the texts
            tables = []
            for members, owner, at in held:
                a, b = np.searchsorted(at, (begin, begin + COLUMNS))
                table = np.zeros((members, COLUMNS), np.float32)
                table[owner[a:b], at[a:b] - begin] = 1
                tables.append(table)
            k += (tables[0] @ tables[1].T).astype(np.int64)
        n = one["n"].to_numpy()[:, None] + two["n"].to_numpy()[None]
        p, q = np.nonzero((100 * k >= percent * (n - k)) & (one["class"].to_numpy()[:, None] != two["class"].to_numpy()[None]))
        a, b = one["id"].to_numpy()[p], two["id"].to_numpy()[q]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _links_in_cells(state: DataFrame, largest: DataFrame, shingled: DataFrame, percent: int) -> DataFrame:
    """Links between a crowded bucket's largest class and the rest, and within the rest. Only links leave a cell.

    Both sides are dealt to a grid of cells, so no task holds more than about two cells' worth of a bucket's members,
    and a bucket of any size is spread over many tasks. Members that no text can resemble enough are left out.
    """
    parts = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    crowded = largest.select("band", "h", "top", parts("outside").alias("i_parts"), parts("members").alias("j_parts"))
    possible = state.where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n")).join(crowded, ["band", "h"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    first = F.when(F.col("class") != F.col("top"), F.transform(every("j_parts"), lambda j: cell(own("i_parts"), j, 0)))
    second = F.transform(every("i_parts"), lambda i: cell(i, own("j_parts"), 1))
    # One explode, no union: two sides partitioned by bucket would pass for partitioned together.
    cells = F.explode(F.concat(F.coalesce(first, F.array().cast("array<struct<i:int,j:int,side:int>>")), second))
    dealt = possible.select("band", "h", "id", "class", "n", cells.alias("cell")).select("band", "h", "id", "class", "n", "cell.*").join(shingled, "id")
    return dealt.groupBy("band", "h", "i", "j").applyInPandas(_cell_links(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Key and class_id (the least key of the class) of every row.

    Texts with the same words in the same order are one class, empty and null texts (no words) too. A text under five
    words is one shingle. A null key is a class of its own (null). Repeated rows and ties get equal class ids, an
    empty table an empty result; other columns are not carried. Keys are integers. Long texts are used whole.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = slim.where("id is not null")
    signed = cut(known.mapInArrow(_signed(bands, rows, size), "id long, words binary, n long, bands array<long>"))
    copies = cut(signed.groupBy("words").agg(F.min(F.struct("id", "n", "bands")).alias("r")).select("words", "r.*"))
    banded = copies.where("n > 0").select("id", "n", F.posexplode("bands").alias("band", "h"))
    crowded = banded.groupBy("band", "h").agg(F.count("*").alias("m")).where("m > 1").select("band", "h")
    near = cut(banded.join(crowded, ["band", "h"]))
    ids = cut(near.select("id").distinct())
    shingled = known.join(broadcast_if_small(ids), "id", "left_semi").select("id", "text").mapInArrow(_shingled(size), "id long, shingles array<long>")
    shingled = cut(shingled.dropDuplicates(["id"]))
    # Shingles that one member alone has: no other member can share them.
    alone = shingled.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
    alone = cut(alone.groupBy("id").agg(F.count("*").alias("u")))
    members = cut(near.join(broadcast_if_small(alone), "id", "left").fillna(0, ["u"]))
    discard(near, ids, alone)
    links, state, made, classes = None, members.withColumn("class", F.col("id")), [], None
    for step in range(HUB_ROUNDS + 1):
        in_cells = None
        if step < HUB_ROUNDS:  # one hub a bucket: first the member with the smallest share of its own, then one drawn
            own = F.col("u") / F.col("n") if step == 0 else F.lit(0.0)
            draw = F.struct(own.alias("own"), F.xxhash64("id", "band", F.lit(step)).alias("x"), "id", "class", "n", "u")
            hubs = state.groupBy("band", "h").agg(F.min(draw).alias("hub"), F.min("class").alias("c0"), F.max("class").alias("c1"))
            hubs = hubs.where("c0 != c1").select("band", "h", F.col("hub.id").alias("hub"), F.col("hub.class").alias("hub_class"), F.col("hub.n").alias("hub_n"), F.col("hub.u").alias("hub_u"))
        else:  # every member outside the bucket's largest class
            sizes = state.groupBy("band", "h", "class").agg(F.count("*").alias("k"))
            largest = sizes.groupBy("band", "h").agg(F.max(F.struct("k", "class")).alias("t"), F.count("*").alias("classes"), F.sum("k").alias("members")).where("classes > 1")
            largest = cut(largest.select("band", "h", F.col("t.class").alias("top"), "members", (F.col("members") - F.col("t.k")).alias("outside")))
            made.append(largest)
            much = F.col("outside") * F.col("members") > MANY
            if largest.where(much).limit(1).count():
                in_cells = _links_in_cells(state, largest.where(much), shingled, percent)
            outside = state.join(largest.where(~much), ["band", "h"]).where("class != top")
            hubs = outside.select("band", "h", F.col("id").alias("hub"), F.col("class").alias("hub_class"), F.col("n").alias("hub_n"), F.col("u").alias("hub_u"))
        # What one side has alone is not shared and adds to the union: a bound that no pair above the threshold fails.
        most = F.least(F.col("n") - F.col("u"), F.col("hub_n") - F.col("hub_u"))
        least = F.greatest(F.col("n") + F.col("hub_u"), F.col("hub_n") + F.col("u"))
        open_ = (100 * most >= percent * least) & (F.col("class") != F.col("hub_class"))
        pairs = cut(state.join(hubs, ["band", "h"]).where(open_).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
        found = _similar(pairs, shingled, percent)
        found = cut(found if in_cells is None else found.union(in_cells))
        links = found if links is None else links.union(found)
        made += [pairs, found] + ([classes] if classes else [])
        classes = components(links)
        if step < HUB_ROUNDS:
            state = cut(members.join(broadcast_if_small(classes), "id", "left").withColumn("class", F.coalesce("class", "id")))
            made.append(state)
    labelled = copies.select("words", "id").join(broadcast_if_small(classes), "id", "left").select("words", F.coalesce("class", "id").alias("class_id"))
    discard(shingled, members, *made)
    out = signed.select("id", "words").join(labelled, "words").select(F.col("id").alias(key), "class_id")
    return out.union(slim.where("id is null").select("id", F.lit(None).cast("long")))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id < b.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, class_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.class_id FROM r JOIN e ON e.a = r.doc_id WHERE r.class_id < e.b)
SELECT doc_id, min(class_id) AS class_id FROM r GROUP BY doc_id
"""
