"""Benchmark decontamination: short items searched inside long documents.

Items are partitioned by size, in powers of two of their shingles. An item with n shingles that a document holds to
80 % or more lacks a fifth of n at most, so among any floor(n / 5) + 1 of its shingles at least one is in the document.
A partition's MinHash sketches have that many for its largest size: the least hashes of an item, rare ones first (those
that fewer items have), so a passage that many items share makes no candidates while an item has others. A document
that shares no sketch hash cannot contain the item, however long it is: containment, unlike Jaccard similarity, does
not fade with its length. The candidates are then verified on all shingles of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if_small, cut, discard, small_batches
from scriptorium.llm.shingles import blocks, distinct, shingle_hashes, word_hashes

#: Shingles (8 bytes each) that go to the executors as one sorted array; beyond, the search is a shuffled join.
BROADCAST_HASHES = 4_000_000


SIZE = 5


def _of_items(size: int):
    """(key, text) -> (key, words of a shingle, hash of each distinct shingle). A shorter text is one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_hashes(batch.column(1))
            s, _ = distinct(shingle_hashes(words, size))
            sizes = np.minimum(np.diff(words.first), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.text)), pa.array(sizes[s.text], pa.int32()), pa.array(s.hashes.view(np.int64))], names=["item", "words", "h"])

    return run


def _shingled(sizes: list[int], among=None):
    """(key, text) -> (key, hash of each distinct shingle of these sizes), only those in the broadcast sorted array if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if among is None else among.value
        for batch in batches:
            for start, stop in blocks(batch.column(1)):
                keys, words = batch.column(0).slice(start, stop - start), word_hashes(batch.column(1).slice(start, stop - start))
                for size in sizes:
                    s = shingle_hashes(words, size, short=False)
                    if known is not None:
                        if not len(known):
                            continue
                        at = np.searchsorted(known, s.hashes)
                        hit = known[np.minimum(at, len(known) - 1)] == s.hashes
                        s.text, s.hashes = s.text[hit], s.hashes[hit]
                    s, _ = distinct(s)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(s.text)), pa.array(s.hashes.view(np.int64))], names=["id", "h"])

    return run


def _hits(docs: DataFrame, hashes: DataFrame, sizes: list[int], few: int) -> DataFrame:
    """(id, h) of the documents' distinct shingles that are among the hashes."""
    wanted = hashes.select("h").distinct()
    some = wanted.limit(few + 1).toArrow()  # 8 bytes each
    if some.num_rows <= few:
        array = np.sort(some.column("h").to_numpy().view(np.uint64))
        return docs.mapInArrow(_shingled(sizes, docs.sparkSession.sparkContext.broadcast(array)), "id long, h long")
    return docs.mapInArrow(_shingled(sizes), "id long, h long").join(wanted, "h", "left_semi").select("id", "h")


def sketches(of_items: DataFrame, percent: int) -> DataFrame:
    """(item, words, h) -> (item, h) of each item's sketch, as many as its size partition needs."""
    sizes = of_items.groupBy("item").agg(F.count("*").alias("n"))
    holders = of_items.groupBy("h").agg(F.count("*").alias("holders"))
    partition = F.length(F.bin("n"))  # n is under 2 ** partition
    largest = F.pow(F.lit(2), partition) - 1
    ranked = of_items.join(sizes, "item").join(holders, "h").withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy("holders", "h")))
    return ranked.where(F.col("place") <= F.floor((100 - percent) * largest / 100) + 1).select("item", "h")


def leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", size: int = SIZE, percent: int = 80, few: int = BROADCAST_HASHES) -> DataFrame:
    """Pairs of key and item_key with n_shared of the item's n_shingles, where n_shared is percent or more of them.

    An item under five words is one shingle of its words, so it is found where they stand in a row. Null and empty texts
    have no shingles. Null keys never match. Repeated rows of a table count once. Empty tables give an empty result;
    other columns are not carried. Documents are searched whole. At most `few` hashes go to the executors as an array.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    sought = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null")
    of_items = cut(sought.mapInArrow(_of_items(size), "item long, words int, h long").distinct())
    lengths = sorted(r.words for r in of_items.select("words").distinct().collect())  # `size` values at most
    sizes = of_items.groupBy("item").agg(F.count("*").alias("n_shingles"))
    sketch = cut(sketches(of_items, percent))
    candidates = cut(_hits(slim, sketch, lengths, few).join(broadcast_if_small(sketch), "h").select("item", "id").distinct())
    ids = cut(candidates.select("id").distinct())
    verified = of_items.select("item", "h").join(candidates.select("item").distinct(), "item", "left_semi")
    shared = _hits(slim.join(broadcast_if_small(ids), "id", "left_semi"), verified, lengths, few).distinct()
    counted = shared.join(broadcast_if_small(of_items), "h").join(candidates, ["item", "id"], "left_semi").groupBy("item", "id").agg(F.count("*").alias("n_shared"))
    full = counted.join(sizes, "item").where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    discard(sketch)
    return full.select(F.col("id").alias(key), F.col("item").alias(item_key), "n_shared", "n_shingles")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
z AS (SELECT DISTINCT least(len(w), 5) AS z FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
x AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + z - 1], ' ') AS s FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, z)),
k AS (SELECT doc_id, item_id, count(*) AS n_shared FROM x JOIN s USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles FROM k JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_shingles
"""
