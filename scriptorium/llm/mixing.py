"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed by source and hash bucket. A source's target is a whole number of passes over it and a remainder; the
remainder is met by the documents whose hash lies under a threshold. The histogram gives the bucket in which the
budget runs out; only that bucket is summed again, by finer buckets, and the threshold is set at the last finer boundary within
the budget. What is left of the budget sets a second threshold above the first in the same way, for documents small
enough to fit into it, at the boundary nearest to it. Nothing is sorted, and no step gathers the documents of a source:
the histograms have at most 1,024 cells a source, however hot it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if_small, cut, free_name, n_words

#: Sources in order weigh these, repeating; no source is taken more often than MAX_PASSES.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Buckets of the hash: 60 bits, first by the upper 10, in the boundary bucket by the next 10.
COARSE, FINE, BITS = 50, 40, 60


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size -> source, source_size, target: shares of the whole by weight, capped, the excess reshared.

    Resharing until none is above its cap ends where one level of target over weight holds for all uncapped sources;
    with sources ordered by cap over weight, that level is found by running sums. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.get(F.array(*map(F.lit, weights)), index.cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", (max_passes * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level"))))
    return levels.withColumn("found", first.over(whole)["level"]).select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce("found", F.lit(0.0))).alias("target"))


def _running(cells: DataFrame, bucket: str) -> DataFrame:
    """Words of a source in the cells up to each cell; a source has 1,024 cells at most."""
    return cells.withColumn("cum", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy(bucket)))


def _coarse(sized: DataFrame) -> DataFrame:
    return cut(sized.groupBy("source", F.shiftright("h", COARSE).alias("bucket")).agg(F.sum("size").alias("words")))


def _boundary(sized: DataFrame, coarse: DataFrame, rests: DataFrame, nearest: bool) -> DataFrame:
    """(source, rest) -> source, below, got: the fine boundary up to which a source's rows hold `got` words.

    The last one that does not exceed the rest, or the nearest to it. A source that the rest exhausts has no row.
    """
    with_rest = coarse.join(rests.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = _running(with_rest.withColumn("base", F.lit(0)), "bucket")
    edge = cells.where(F.col("cum") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("cum") - F.col("words")).alias("base"), "rest")).alias("e"))
    few = broadcast_if_small(cut(edge.select(F.col("source").alias("s"), "e.*")))
    inside = sized.join(few, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", COARSE) == F.col("bucket")))
    fine = _running(inside.groupBy("source", "base", "rest", F.shiftright("h", FINE).alias("cell")).agg(F.sum("size").alias("words")), "cell")
    before = F.struct(F.abs(F.col("cum") - F.col("words") - F.col("rest")).alias("off"), F.shiftleft("cell", FINE).alias("below"), (F.col("cum") - F.col("words")).alias("got"))
    behind = F.struct(F.abs(F.col("cum") - F.col("rest")).alias("off"), F.shiftleft(F.col("cell") + 1, FINE).alias("below"), F.col("cum").alias("got"))
    best = F.least(before, behind) if nearest else F.when(F.col("cum") - F.col("words") <= F.col("rest"), before)
    return fine.groupBy("source").agg(F.min(best).alias("b")).select("source", "b.below", "b.got")


def thresholds(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size, target, passes, below, small, below_small.

    A document is taken `passes` times, and once more if its hash is under `below`, or under `below_small` and it has
    at most `small` words: the first threshold stops short of the budget, the second spends what is left on documents
    that fit into it.
    """
    coarse = _coarse(sized)
    aims = targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_passes)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = cut(aims.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    first = cut(_boundary(sized, coarse, aims, False).toDF("s", "below", "got"))
    everything = F.when(F.col("rest") > 0, F.lit(1 << BITS)).otherwise(F.lit(0)).cast("long")  # the rest exhausts the source
    aims = aims.join(first, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    small = F.when(F.col("below").isNull(), F.lit(0.0)).otherwise(F.col("rest") - F.col("got"))
    aims = cut(aims.withColumn("small", small).withColumn("below", F.coalesce("below", everything)))
    open_ = broadcast_if_small(aims.select(F.col("source").alias("s"), "below", "small"))
    fit = sized.join(open_, F.col("source").eqNullSafe(F.col("s"))).where("h >= below and size > 0 and size <= small").select("source", "size", "h")
    second = _boundary(fit, _coarse(fit), aims.select("source", F.col("small").alias("rest")), True).select(F.col("source").alias("s"), F.col("below").alias("below_small"))
    out = aims.join(second, F.col("source").eqNullSafe(F.col("s")), "left")
    # Without a boundary the documents that fit are all needed, or none is there.
    return out.select("source", "source_size", "target", "passes", "below", "small", F.coalesce("below_small", F.lit(1 << BITS)).cast("long").alias("below_small"))


def _extra(h: Column, size: Column) -> Column:
    return F.when((h < F.col("below")) | ((h < F.col("below_small")) & (size <= F.col("small"))), 1).otherwise(0)


def mixed(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The rows that the mix takes, all their columns, and `passes_taken`, how often (an existing column of that name goes).

    Rows that it does not take are left out, among them rows without a word. Other cases are as for mix().
    """
    sized = cut(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _hash(F.col(key)).alias("h")))
    name = free_name(docs, "_mix")
    at = cut(thresholds(sized, weights, max_passes).select(F.struct("source", "passes", "below", "small", "below_small").alias(name)))
    joined = docs.join(broadcast_if_small(at), docs[source].eqNullSafe(F.col(f"{name}.source")))
    h, size, m = _hash(F.col(key)), n_words(F.col(text)), F.col(name)
    extra = (h < m["below"]) | ((h < m["below_small"]) & (size <= m["small"]))
    taken = m["passes"] + F.when(extra, 1).otherwise(0)
    return joined.withColumn("passes_taken", taken).where((F.col("passes_taken") > 0) & (size > 0)).drop(name)


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Key, source, size, source_size, target and taken (words the mix takes, repeats counted) of every row.

    Null text: size 0. Null source: a source of its own, last in order. Null key: hashed as an empty one. Rows with
    equal keys hash alike and are taken alike. An empty table gives an empty one. Other columns are not carried.
    A source's taken words miss its target by less than the document at its first threshold has.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _hash(F.col(key)).alias("h"))
    sized = cut(sized)  # a few bytes a row: the texts are read once, the histograms read this
    at = cut(thresholds(sized, weights, max_passes).withColumnRenamed("source", "s"))
    joined = sized.join(broadcast_if_small(at), F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("size") * (F.col("passes") + _extra(F.col("h"), F.col("size")))
    return joined.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM v WHERE level <= cap / w)) AS target FROM v),
a AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM t),
r AS (SELECT *, target - passes * source_size AS rest FROM a),
f AS (SELECT source, h >> {FINE} AS cell, sum(size) AS words FROM d GROUP BY ALL),
g AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY cell) AS cum FROM f),
e AS (SELECT g.source, cell, words, cum, rest FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source WHERE cum > rest),
h AS (SELECT source, min(cell) << {FINE} AS below, arg_min(cum - words, cell) AS got FROM e GROUP BY source),
x AS (SELECT r.*, coalesce(below, CASE WHEN rest > 0 THEN 1::BIGINT << {BITS} ELSE 0 END) AS below, CASE WHEN below IS NULL THEN 0 ELSE rest - got END AS small FROM r LEFT JOIN h ON r.source IS NOT DISTINCT FROM h.source),
y AS (SELECT d.source, d.h >> {FINE} AS cell, sum(size) AS words, small FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source WHERE d.h >= x.below AND size > 0 AND size <= small GROUP BY ALL),
z AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY cell) AS cum FROM y),
k AS (SELECT source, cell, cum, words, small FROM z QUALIFY cum > small AND row_number() OVER (PARTITION BY source, cum > small ORDER BY cell) = 1),
q AS (SELECT source, CASE WHEN abs(cum - words - small) <= abs(cum - small) THEN cell << {FINE} ELSE (cell + 1) << {FINE} END AS below_small FROM k)
SELECT doc_id, d.source, size, source_size, target,
  size * (passes + CASE WHEN d.h < below OR (d.h < coalesce(below_small, 1::BIGINT << {BITS}) AND size <= small) THEN 1 ELSE 0 END) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
