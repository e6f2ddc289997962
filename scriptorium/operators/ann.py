"""Approximate search over vectors: inverted lists around centroids, plain or with product-quantised residues."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.retrieval import QUESTION_BLOCK, Best, _ranked, dense_search, rounded, vectors_in

#: Centroids and codes are learned on a hash sample of about so many vectors; every vector is indexed.
SAMPLE = 20_000
#: Lists are probed until sampled questions find this share of their exact neighbours, so many of each are checked.
RECALL, CHECKED, NEIGHBOURS = 0.95, 200, 10
#: With codes, so many times k candidates a part are scored again on their vectors. Parts of a batch are scored by block of questions.
RESCORED, PART = 8, 4_000


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        for c in range(k):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Inverted:
    """nlist = min(256, n / 39) lists; with `parts`, residues of vectors are kept as 8-bit codes a part.

    How many lists a question probes is measured on the sample: the fewest that reach `recall` there.
    """

    def __init__(self, vectors: DataFrame, parts: int = 0, recall: float = RECALL):
        n = vectors.count()
        share = min(1.0, SAMPLE / max(n, 1))
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
        drawn = vectors.where(draw < share).select("doc_id", "vector").orderBy("doc_id").toArrow()
        sample = np.array(drawn.column("vector").to_pylist(), float)
        self.nlist = max(1, min(256, len(sample) // 39))
        self.centres = _kmeans(sample, self.nlist)
        self.nprobe = self._probes(sample, recall)
        self.books = None
        if parts:
            while sample.shape[1] % parts:
                parts -= 1
            size = min(256, len(sample))
            residues = sample - self.centres[_nearest(sample, self.centres)]
            self.books = [_kmeans(p, size) for p in np.split(residues, parts, axis=1)]
        self.vectors = vectors

    def _order(self, q: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) - 2 * q @ self.centres.T).argsort(1)

    def _probes(self, sample: np.ndarray, recall: float) -> int:
        q = sample[:: max(1, len(sample) // CHECKED)]
        exact = np.argsort(-(q @ sample.T), axis=1, kind="stable")[:, :NEIGHBOURS]
        place = np.argsort(self._order(q), axis=1)  # of each list in a question's order
        needed = np.sort(np.take_along_axis(place, _nearest(sample, self.centres)[exact], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def cells(self, vectors: DataFrame) -> DataFrame:
        """Adds the list of every vector: what write() stores by."""
        centres = self.centres

        @F.pandas_udf("int")
        def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                yield pd.Series(_nearest(np.array(v.tolist(), float).reshape(len(v), -1), centres))

        return vectors.withColumn("cell", cell("vector"))

    def write(self, path: str) -> Inverted:
        """Store the vectors by list; searches then read only the lists that some question probes."""
        self.cells(self.vectors.select("doc_id", "vector")).repartition("cell").write.partitionBy("cell").parquet(path)
        self.vectors = self.vectors.sparkSession.read.parquet(path)
        return self

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, vector) -> qid, doc_id, score, rank among the lists nearest to each question."""
        asked = questions.select("qid", "vector").orderBy("qid").toArrow()  # a stated question set
        if not asked.num_rows:
            return self.vectors.sparkSession.createDataFrame([], "qid long, doc_id long, score double, rank int")
        q, qids = np.array(asked.column("vector").to_pylist(), float), asked.column("qid").to_numpy()
        probed = np.zeros((len(q), self.nlist), bool)
        np.put_along_axis(probed, self._order(q)[:, : self.nprobe], True, axis=1)
        vectors = self.vectors if "cell" in self.vectors.columns else self.cells(self.vectors)
        vectors = vectors.where(F.col("cell").isin(np.flatnonzero(probed.any(0)).tolist()))
        centres, books = self.centres, self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(q), k)
            for batch in batches:
                for at in range(0, batch.num_rows, PART):
                    part = batch.slice(at, PART)
                    x, ids, cell = vectors_in(part.column(1)), part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                    codes = None if books is None else [(_nearest(r, b), b) for b, r in zip(books, np.split(x - centres[cell], len(books), axis=1))]
                    for block in range(0, len(q), QUESTION_BLOCK):
                        some = q[block : block + QUESTION_BLOCK]
                        best.add(block, scored(some, probed[block : block + QUESTION_BLOCK][:, cell], x, cell, codes), ids)
            yield best.rows(qids)

        def scored(some: np.ndarray, near: np.ndarray, x: np.ndarray, cell: np.ndarray, codes: list | None) -> np.ndarray:
            if codes is None:
                return np.where(near, rounded(some @ x.T), -np.inf)
            coded = (some @ centres.T)[:, cell]
            for p, (code, b) in zip(np.split(some, len(codes), axis=1), codes):
                coded += (p @ b.T)[:, code]
            coded[~near] = -np.inf
            if (rest := len(x) - RESCORED * k) > 0:
                np.put_along_axis(coded, np.argpartition(coded, rest, axis=1)[:, :rest], -np.inf, axis=1)
            scores = np.full(coded.shape, -np.inf)
            i, j = np.nonzero(np.isfinite(coded))
            scores[i, j] = rounded((some[i] * x[j]).sum(1))
            return scores

        return _ranked(vectors.select("doc_id", "vector", "cell").mapInArrow(run, "qid long, doc_id long, score double"), k)


def build_index(kind: str, vectors: DataFrame):
    """search(questions, k) of an index: flat, ivf or ivfpq. A graph index (hnsw) has no distributed form."""
    if kind == "flat":
        return lambda questions, k: dense_search(vectors, questions, k)
    if kind == "ivf":
        return Inverted(vectors).search
    if kind == "ivfpq":
        return Inverted(vectors, 8).search
    raise KeyError(kind)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean share of the exact top k that the index found."""
    hit = exact.select("qid", "doc_id").join(found.select("qid", "doc_id").withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("r")).agg(F.round(F.avg("r"), 6).alias("recall"), F.count("*").alias("n_questions"))


def compare_indexes(kinds: list[str], vectors: DataFrame, questions: DataFrame, k: int) -> list[dict]:
    """One row a kind: recall against exact search, seconds to build, milliseconds a question, and bytes of what it holds."""
    exact, out = dense_search(vectors, questions, k).persist(), []
    n, asked = vectors.count(), max(questions.count(), 1)
    width = len(vectors.select("vector").first().vector)
    exact.count()
    for kind in kinds:
        began = time.perf_counter()
        search = build_index(kind, vectors)
        built = time.perf_counter()
        found = search(questions, k).persist()
        found.count()
        ended = time.perf_counter()
        bytes_ = n * (16 if kind == "ivfpq" else 4 * width) + (n * 4 if kind != "flat" else 0)
        out.append({"kind": kind, "recall": recall(found, exact, k).first().recall, "build_s": built - began, "ms_per_question": 1000 * (ended - built) / asked, "bytes": bytes_})
        found.unpersist()
    exact.unpersist()
    return out
