"""Lexical and dense retrieval, rank fusion and context packing. Every tie is broken by id."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.embedding import TOKEN

K1, B, EPSILON = 1.5, 0.75, 0.25
TOKENS = TOKEN.pattern
#: Questions are matched in blocks of so many, so that a block's vocabulary and scores stay small in a worker.
QUESTION_BLOCK = 500
#: Documents are scored so many at a time, however large a batch is.
PART = 1_000
#: A batch's vocabulary leaves a worker as soon as it has so many terms.
TERMS = 50_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (term, df, size) summed over TERMS terms or a task; the empty term counts the texts and their tokens."""

    def out() -> pa.RecordBatch:
        df[""] = texts
        return pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(df.values(), pa.int64()), pa.array([size if t == "" else 0 for t in df], pa.int64())], names=["term", "df", "size"])

    df: Counter = Counter()
    size = texts = 0
    for batch in batches:
        for text in batch.column(0):
            found = TOKEN.findall((text.as_py() or "").lower())
            size, texts = size + len(found), texts + 1
            df.update(set(found))
            if len(df) > TERMS:
                yield out()
                df, size, texts = Counter(), 0, 0
    if texts:
        yield out()


def bm25_statistics(docs: DataFrame) -> tuple[DataFrame, dict]:
    """(term, df, idf) of the vocabulary, and n, mean length and mean idf. Negative idfs become EPSILON x mean idf.

    One pass over the texts; the vocabulary it leaves is kept for the steps that follow.
    """
    counted = docs.select("text").mapInArrow(_vocabulary, "term string, df long, size long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).persist()
    whole = counted.where("term = ''").first()
    n, size = (whole.df, whole["size"]) if whole else (0, 0)
    raw = counted.where("term <> ''").withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))
    return idf, {"n": n, "mean": size / n if n else 0.0, "mean_idf": mean}


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as SQL does: halves go away from zero (numpy's round sends them to the even neighbour)."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, x) + 0.0


class Best:
    """The k best documents of each question so far, by score, then id: what a task keeps of all that it has scored."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of the questions from `at` on (rows) by documents (columns); minus infinity or nan: not scored."""
        n, m = scores.shape
        if np.isnan(scores).any():
            scores = np.where(np.isnan(scores), -np.inf, scores)
        kept, known = self.scores[at : at + n], self.ids[at : at + n]
        least = kept[:, -1:]
        if m > self.k:
            least = np.maximum(least, np.partition(scores, m - self.k, axis=1)[:, m - self.k, None])
        i, j = np.nonzero((scores >= least) & np.isfinite(scores))
        if not len(i):
            return
        touched = np.unique(i)
        q, value, doc = np.concatenate([i, np.repeat(touched, self.k)]), np.concatenate([scores[i, j], kept[touched].ravel()]), np.concatenate([ids[j], known[touched].ravel()])
        order = np.lexsort((doc, -value, q))
        q, value, doc = q[order], value[order], doc[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < self.k
        kept[q[first], place[first]], known[q[first], place[first]] = value[first], doc[first]

    def rows(self, qids) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(qids, "int64")[i]), pa.array(self.ids[i, j]), pa.array(self.scores[i, j])], names=["qid", "doc_id", "score"])


def vectors_in(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _searched(docs: DataFrame, scorers: Callable[[], list[tuple[list, Callable[[pa.Array], np.ndarray]]]], k: int) -> DataFrame:
    """Scores documents (doc_id and what is scored) against all blocks of questions, PART rows at a time; then the best k.

    The documents are read once, however many blocks there are. A task keeps k rows a question and sends them at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = scorers()
        best = [Best(len(qids), k) for qids, _ in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                ids, given = batch.column(0).slice(at, PART).to_numpy(zero_copy_only=False), batch.column(1).slice(at, PART)
                for kept, (_, score) in zip(best, blocks):
                    kept.add(0, np.ascontiguousarray(rounded(score(given)).T), ids)
        for kept, (qids, _) in zip(best, blocks):
            yield kept.rows(qids)

    return _ranked(docs.mapInArrow(run, "qid long, doc_id long, score double"), k)


def bm25_search(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) x (qid, text) -> qid, doc_id, score, rank for the k best documents, zero scores included.

    Corpus statistics are one aggregation over the vocabulary. Postings are never shuffled: a batch of documents is
    tokenised once and scored against blocks of questions as matrix products, and only its best k a question leave.
    """
    idf, stats = bm25_statistics(docs)
    asked = questions.select("qid", "text").orderBy("qid").collect()  # a stated question set
    asked = [(r.qid, TOKEN.findall((r.text or "").lower())) for r in asked]
    wanted = docs.sparkSession.createDataFrame([(t,) for t in sorted({t for _, ts in asked for t in ts})] or [("",)], "term string")
    weight = {r.term: r.idf for r in idf.join(wanted, "term").collect()}
    terms = {t: i for i, t in enumerate(sorted(weight))}
    mean = stats["mean"] or 1.0
    blocks = []
    for at in range(0, len(asked), QUESTION_BLOCK):
        block = asked[at : at + QUESTION_BLOCK]
        used = sorted({terms[t] for _, ts in block for t in ts if t in terms})
        row = {i: k for k, i in enumerate(used)}
        table = np.zeros((len(used), len(block)))
        for q, (_, ts) in enumerate(block):
            for t in ts:
                if t in terms:
                    table[row[terms[t]], q] += weight[t]
        blocks.append(([qid for qid, _ in block], np.array(used, np.int64), table))

    def scorers() -> list:
        last: list = [None, None]

        def weights(batch: pa.Array) -> list:
            if last[0] is not batch:  # the blocks share the tokens
                rows = []
                for text in batch:
                    found = TOKEN.findall((text.as_py() or "").lower())
                    some = sorted((terms[t], n) for t, n in Counter(found).items() if t in terms)
                    at, tf = np.array(some, np.int64).reshape(-1, 2).T
                    rows.append((at, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / mean))))
                last[:] = batch, rows
            return last[1]

        def scorer(used: np.ndarray, table: np.ndarray):
            def score(batch: pa.Array) -> np.ndarray:
                total = np.zeros((len(batch), table.shape[1]))
                for i, (at, values) in enumerate(weights(batch)):
                    place = np.searchsorted(used, at)
                    hit = (place < len(used)) & (used[np.minimum(place, len(used) - 1)] == at) if len(used) else np.zeros(len(at), bool)
                    total[i] = values[hit] @ table[place[hit]]
                return total

            return score

        return [(qids, scorer(used, table)) for qids, used, table in blocks]

    if not blocks:
        return docs.sparkSession.createDataFrame([], "qid long, doc_id long, score double, rank int")
    return _searched(docs.select("doc_id", "text"), scorers, k)


def dense_search(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(doc_id, vector) x (qid, vector) -> the k largest inner products a question, exact."""
    asked = questions.select("qid", "vector").orderBy("qid").toArrow()  # a stated question set
    if not asked.num_rows:
        return vectors.sparkSession.createDataFrame([], "qid long, doc_id long, score double, rank int")
    qids, matrix = asked.column("qid").to_pylist(), np.array(asked.column("vector").to_pylist(), float).T
    starts = range(0, len(qids), QUESTION_BLOCK)
    blocks = [(qids[at : at + QUESTION_BLOCK], np.ascontiguousarray(matrix[:, at : at + QUESTION_BLOCK])) for at in starts]

    def scorers() -> list:
        def scorer(m: np.ndarray):
            return lambda batch: vectors_in(batch) @ m

        return [(q, scorer(m)) for q, m in blocks]

    return _searched(vectors.select("doc_id", "vector"), scorers, k)


def reciprocal_rank_fusion(arms: list[DataFrame], k: int = 60, top: int = 10) -> DataFrame:
    """Rank lists (qid, doc_id, rank) -> qid, doc_id, score, rank: the sum of 1 / (k + rank). No outer join is needed.

    The lists are dealt out together, by both columns: a union of arms that are each partitioned by question passes for
    one partitioned so (and a repartition by question is then left out), but is not once adaptive execution has merged
    the arms' partitions differently.
    """
    every = arms[0].select("qid", "doc_id", "rank")
    for arm in arms[1:]:
        every = every.unionByName(arm.select("qid", "doc_id", "rank"))
    return _ranked(every.repartition("qid", "doc_id").groupBy("qid", "doc_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12).alias("score")), top)


def weighted_fusion(arms: dict[float, DataFrame] | list[tuple[float, DataFrame]], top: int = 10) -> DataFrame:
    """Score lists -> weighted sum of scores scaled to 0..1 a list; a constant list scales to 1, a missing score is 0.

    Dealt out together, as in reciprocal_rank_fusion.
    """
    pairs = arms.items() if isinstance(arms, dict) else arms
    every = None
    for weight, arm in pairs:
        each = Window.partitionBy("qid")
        lo, hi = F.min("score").over(each), F.max("score").over(each)
        unit = F.when(hi - lo < 1e-12, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo))
        part = arm.select("qid", "doc_id", (F.lit(weight) * unit).alias("score"))
        every = part if every is None else every.unionByName(part)
    return _ranked(every.repartition("qid", "doc_id").groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 9).alias("score")), top)


def hybrid(docs: DataFrame, questions: DataFrame, embedded: Callable[[Column], Column], k: int = 20, mode: str = "hybrid_rrf", rrf_k: int = 60, weight: float = 0.5) -> DataFrame:
    """One plan for all questions; each arm fetches three times k before fusion."""
    if mode not in ("dense", "bm25", "hybrid_rrf", "hybrid_weighted"):
        raise KeyError(mode)
    arms = {}
    if mode != "dense":
        arms["bm25"] = bm25_search(docs, questions, k if mode == "bm25" else 3 * k)
    if mode != "bm25":
        vectors = docs.select("doc_id", embedded(F.col("text")).alias("vector"))
        arms["dense"] = dense_search(vectors, questions.select("qid", embedded(F.col("text")).alias("vector")), k if mode == "dense" else 3 * k)
    if len(arms) == 1:
        return next(iter(arms.values()))
    if mode == "hybrid_rrf":
        return reciprocal_rank_fusion(list(arms.values()), rrf_k, k)
    return weighted_fusion([(weight, arms["dense"]), (1 - weight, arms["bm25"])], k)


def rerank(ranked: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], top: int) -> DataFrame:
    """(qid, question, doc_id, text, rank) -> the top by a pair scorer, ties by the first stage's rank."""
    scorer = F.pandas_udf(score, "double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank"))
    return ranked.withColumn("score", scorer("question", "text")).withColumn("place", place).where(F.col("place") <= top)


def to_parents(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """(qid, parent_id, rank) -> each known parent once, in order of its best child."""
    best = ranked.groupBy("qid", "parent_id").agg(F.min("rank").alias("best")).join(parents, "parent_id")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("best", "parent_id"))).drop("best")


def pack(ranked: DataFrame, top: int = 6, budget: int = 3000) -> DataFrame:
    """(qid, rank, doc_id, n_tokens) -> qid, sources [(sid, doc_id, n_tokens)], n_tokens, dropped.

    Greedy in rank order among the first `top`: what would overflow the budget is skipped, and smaller ones may follow.
    """
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<sid:string,doc_id:bigint,n_tokens:bigint>>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        n = x["n_tokens"].cast("long")
        source = F.struct(F.concat(F.lit("S"), F.size(state["kept"]) + 1).alias("sid"), x["doc_id"].cast("long").alias("doc_id"), n.alias("n_tokens"))
        return F.when(state["used"] + n <= budget, F.struct((state["used"] + n).alias("used"), F.concat(state["kept"], F.array(source)).alias("kept"))).otherwise(state)

    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc_id"))
    first = ranked.withColumn("_place", place).where(F.col("_place") <= top).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "n_tokens"))).alias("all"))
    packed = first.withColumn("p", F.aggregate("all", zero, step)).join(ranked.groupBy("qid").agg(F.count("*").alias("total")), "qid")
    return packed.select("qid", F.col("p.kept").alias("sources"), F.col("p.used").alias("n_tokens"), (F.col("total") - F.size("p.kept")).cast("int").alias("dropped"))
