"""Retrieval metrics by page overlap, agreement, significance, run history and incremental manifests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

K_VALUES = (1, 3, 5, 10, 20)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def relevant(ranked: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, rank, book, page_start, page_end) with `rel`: whether any labelled range of the question overlaps."""
    c = contexts.select(F.col("qid").alias("_q"), F.col("book").alias("_b"), F.col("page_start").alias("_s"), F.col("page_end").alias("_e"))
    cond = (F.col("qid") == F.col("_q")) & (F.col("book") == F.col("_b")) & overlaps(F.col("page_start"), F.col("page_end"), F.col("_s"), F.col("_e"))
    hits = ranked.join(c, cond, "left_semi").select("qid", "rank").distinct().withColumn("rel", F.lit(1))
    return ranked.join(hits, ["qid", "rank"], "left").fillna(0, ["rel"])


def retrieval_metrics(ranked: DataFrame, contexts: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """qid -> recall@k (labelled ranges hit), precision@k (of what was returned), mrr, ndcg@10 (ideal of what was found)."""
    c = contexts.withColumn("range_id", F.xxhash64("qid", "book", "page_start", "page_end"))
    r = ranked.select(F.col("qid").alias("_q"), F.col("book").alias("_b"), F.col("page_start").alias("_s"), F.col("page_end").alias("_e"), "rank")
    cond = (F.col("qid") == F.col("_q")) & (F.col("book") == F.col("_b")) & overlaps(F.col("page_start"), F.col("page_end"), F.col("_s"), F.col("_e"))
    first = c.join(r, cond, "left").groupBy("qid", "range_id").agg(F.min("rank").alias("at"))
    recall = first.groupBy("qid").agg(*[F.avg((F.coalesce("at", F.lit(1 << 30)) <= k).cast("int")).alias(f"recall_{k}") for k in ks])
    flagged = relevant(ranked, contexts)
    ideal = F.row_number().over(Window.partitionBy("qid", "rel").orderBy("rank"))
    gain = lambda place: 1 / (F.log(place + 1.0) / math.log(2))
    scored = flagged.where("rank <= 10").withColumn("ideal", ideal)
    ndcg = scored.where("rel = 1").groupBy("qid").agg((F.sum(gain(F.col("rank"))) / F.sum(gain(F.col("ideal")))).alias("ndcg_10"))
    others = flagged.groupBy("qid").agg(*[F.avg(F.when(F.col("rank") <= k, F.col("rel"))).alias(f"precision_{k}") for k in ks], F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"))
    out = recall.join(others, "qid", "left").join(ndcg, "qid", "left")
    return out.fillna(0.0, [c for c in out.columns if c != "qid"])


def precision_ceiling(corpus: DataFrame, contexts: DataFrame, k: int) -> DataFrame:
    """(book, page_start, page_end) chunks -> qid, n_relevant in the corpus, ceiling of precision@k."""
    c = contexts.select("qid", F.col("book").alias("_b"), F.col("page_start").alias("_s"), F.col("page_end").alias("_e"))
    cond = (F.col("book") == F.col("_b")) & overlaps(F.col("page_start"), F.col("page_end"), F.col("_s"), F.col("_e"))
    hits = corpus.join(c, cond).select("qid", "chunk_id").distinct().groupBy("qid").agg(F.count("*").alias("n_relevant"))
    return contexts.select("qid").distinct().join(hits, "qid", "left").fillna(0, ["n_relevant"]).withColumn("ceiling", F.least(F.col("n_relevant"), F.lit(k)) / k)


def holding(docs: DataFrame, passages: DataFrame, words: int = 5) -> DataFrame:
    """docs (text and others) and the qid of every passage (qid, text) that a text contains.

    A text that contains a passage has the passage's words behind its first one in a row: where its second word stands,
    the `words` from there are compared, and `in` decides. Only passages of fewer than words + 2 words are sought in every
    text. Passages are a stated set and go to the tasks; texts are read once, and only those that hold one leave.
    """
    asked = [(r.qid, r.text) for r in passages.select("qid", "text").collect() if r.text is not None]
    starts, everywhere = {}, []
    for qid, passage in asked:
        found = passage.split()
        if len(found) >= words + 2:
            starts.setdefault(found[1], {}).setdefault(tuple(found[1 : words + 1]), []).append((qid, passage))
        else:
            everywhere.append((qid, passage))
    names, at = docs.columns, docs.columns.index("text")

    def held(text: str) -> list:
        seen, near = text.split(), set()
        for i, word in enumerate(seen):
            if word in starts and (key := tuple(seen[i : i + words])) in starts[word]:
                near.add(key)
        candidates = everywhere + [p for key in near for p in starts[key[0]][key]]
        return [qid for qid, passage in candidates if passage in text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, qid) for i, text in enumerate(batch.column(at)) if text.is_valid for qid in held(text.as_py())]
            rows = pa.array([i for i, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns] + [pa.array([qid for _, qid in pairs], kind)], names=[*names, "qid"])

    kind = to_arrow_type(passages.schema["qid"].dataType)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, passages.schema["qid"]]))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    return samples.groupBy(by).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.count(value).alias("n"))


def usable(refused: Column, should_refuse: Column, grounded: Column, leaked: Column, words: Column, most: int = 250) -> Column:
    return (refused & should_refuse) | (~should_refuse & ~refused & grounded & ~leaked & (words <= most))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labels: 1 if chance agreement is complete, null without pairs."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return total.join(F.broadcast(chance)).select(F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.when(pe == 1, F.lit(1.0)).otherwise(F.round((po - pe) / (1 - pe), 3)).alias("kappa"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided p of a fair coin, ties already dropped; 1 without decisions. Terms follow one from another.

    Up to 1,000 decisions a term is a plain number (whole multiples of 2**-n, so small samples have no rounding), beyond
    that its logarithm, as 2**-n would be too small for a double.
    """
    n, few = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    steps = F.when(few > 0, F.sequence(F.lit(1), few)).otherwise(F.array().cast("array<int>"))

    def tail(first: Column, following, value) -> Column:
        def add(s: Column, k: Column) -> Column:
            term = following(s["term"], (n - k + 1).cast("double"), k.cast("double"))
            return F.struct(term.alias("term"), (s["sum"] + value(term)).alias("sum"))

        return F.aggregate(steps, F.struct(first.alias("term"), value(first).alias("sum")), add, lambda s: s["sum"])

    plain = tail(F.pow(F.lit(2.0), -n), lambda t, left, k: t * left / k, lambda t: t)
    logs = tail(-n * math.log(2), lambda t, left, k: t + F.log(left) - F.log(k), F.exp)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.when(n <= 1000, plain).otherwise(logs)))


def paired(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Questions that both runs answered: key, a, b."""
    return a.select(key, F.col(metric).alias("a")).join(b.select(key, F.col(metric).alias("b")), key)


#: Numbers drawn at once by a bootstrap.
DRAWN = 1 << 20


def bootstrap(diff: np.ndarray, n_boot: int = 10_000, seed: int = 7) -> tuple[float, float, float, float]:
    """Mean difference, its 95 % interval and two-sided p over resampled questions, drawn in blocks of bounded size."""
    r, means = np.random.default_rng(seed), np.empty(n_boot)
    rows = max(1, DRAWN // len(diff))
    for at in range(0, n_boot, rows):
        block = means[at : at + rows]
        block[:] = diff[r.integers(0, len(diff), (len(block), len(diff)))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(diff.mean()), float(low), float(high), float(min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean())))


def significance(pairs: DataFrame, n_boot: int = 10_000, seed: int = 7) -> DataFrame:
    """(comparison, qid, a, b) -> one row a comparison: bootstrap of the mean difference and the sign test.

    A comparison is a question set, some hundreds of rows, gathered in one task; corrected by the number of comparisons.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        diff = (rows.sort_values("qid").a - rows.sort_values("qid").b).to_numpy(float)
        mean, low, high, p = bootstrap(diff, n_boot, seed)
        return pd.DataFrame([{"comparison": rows.comparison.iloc[0], "n": len(diff), "diff": mean, "low": low, "high": high, "p_boot": p, "wins": int((diff > 0).sum()), "losses": int((diff < 0).sum())}])

    found = pairs.groupBy("comparison").applyInPandas(one, "comparison string, n int, diff double, low double, high double, p_boot double, wins int, losses int")
    tested = found.withColumn("p_sign", sign_test(F.col("wins"), F.col("losses")))
    count = tested.agg(F.count("*").alias("n_pairs"))
    judged = tested.join(F.broadcast(count))
    outside = (F.col("low") > 0) | (F.col("high") < 0)
    judged = judged.withColumn("significant", outside & (F.greatest("p_boot", "p_sign") < 0.05 / F.col("n_pairs")))
    return judged.withColumn("verdict", verdict(F.col("low"), F.col("high"), F.col("p_boot"), F.col("p_sign"), F.col("n_pairs")))


def comparisons(scores: DataFrame) -> DataFrame:
    """(config, qid, value) -> comparison, qid, a, b: every unordered pair of configurations on the questions both have."""
    left = scores.select("qid", F.col("config").alias("_a"), F.col("value").alias("a"))
    right = scores.select("qid", F.col("config").alias("_b"), F.col("value").alias("b"))
    return left.join(right, "qid").where("_a < _b").select(F.concat_ws(" vs ", "_a", "_b").alias("comparison"), "qid", "a", "b")


def verdict(low: Column, high: Column, p_boot: Column, p_sign: Column, n_pairs: Column) -> Column:
    """What may be said of a difference: an interval over zero, few large wins only, lost to correction, or real."""
    return (
        F.when((low <= 0) & (high >= 0), "no_difference").when(p_sign > 0.05, "large_wins_only")
        .when(F.greatest(p_boot, p_sign) >= 0.05 / F.greatest(n_pairs, F.lit(1)), "lost_to_correction").otherwise("different")
    )


def regressions(runs: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(config, ts, id, value) -> config, latest, previous, delta, regressed by the last two runs."""
    order = Window.partitionBy("config").orderBy(F.col("ts").desc(), F.col("id").desc())
    last = runs.withColumn("place", F.row_number().over(order)).where("place <= 2")
    both = last.groupBy("config").agg(F.max(F.when(F.col("place") == 1, F.col("value"))).alias("latest"), F.max(F.when(F.col("place") == 2, F.col("value"))).alias("previous"))
    delta = F.col("latest") - F.col("previous")
    return both.withColumn("delta", delta).withColumn("regressed", F.coalesce(delta < -threshold, F.lit(False)))


def plan_ingest(disk: DataFrame, manifest: DataFrame, version: str) -> DataFrame:
    """Files on disk (hash, filename) against the manifest (hash, filename, version) -> filename, status.

    Known hash: unchanged, or stale if of another version. Else a known name: changed. Else new. Manifest rows whose
    hash and name are both gone: removed.
    """
    m = manifest.select("hash", F.col("version").alias("_v"), F.lit(True).alias("_known"))
    names = manifest.select("filename").distinct().withColumn("_named", F.lit(True))
    status = F.when(F.col("_known") & (F.col("_v") == version), "unchanged").when(F.col("_known"), "stale").when(F.col("_named"), "changed").otherwise("new")
    seen = disk.join(m, "hash", "left").join(names, "filename", "left").select("filename", status.alias("status"))
    gone = manifest.join(disk.select("hash"), "hash", "left_anti").join(disk.select("filename"), "filename", "left_anti").select("filename", F.lit("removed").alias("status"))
    return seen.unionByName(gone)


def merge_versions(old: Column, new: Column) -> Column:
    """Map union in which the new entries win."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def coverage(items: DataFrame, column: str, expected: list[str], thin: int = 3) -> DataFrame:
    """Counts by value of an enumeration, with the values that are missing or thin."""
    wanted = items.sparkSession.createDataFrame([(x,) for x in expected], f"{column} string")
    counted = items.groupBy(column).agg(F.count("*").alias("n"))
    joined = F.broadcast(wanted).join(counted, column, "left").fillna(0, ["n"])
    return joined.withColumn("state", F.when(F.col("n") == 0, "missing").when(F.col("n") < thin, "thin").otherwise("ok"))
