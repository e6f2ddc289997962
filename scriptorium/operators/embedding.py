"""Embedders behind one interface, and an offline stand-in that SQL can reproduce."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


class HashEmbedder:
    """Signed feature hashing of tokens by MD5 into unit vectors; texts without a token are zero vectors."""

    name, max_context = "hash", 1 << 20

    def __init__(self, dim: int = 64, document_prefix: str = "", query_prefix: str = ""):
        self.dim, self.document_prefix, self.query_prefix = dim, document_prefix, query_prefix
        self._known: dict[str, tuple[int, float]] = {}

    def _place(self, token: str) -> tuple[int, float]:
        if token not in self._known:
            if len(self._known) > 500_000:
                self._known.clear()
            digest = hashlib.md5(token.encode()).hexdigest()
            self._known[token] = int(digest[:8], 16) % self.dim, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0
        return self._known[token]

    def embed(self, texts: list[str], prefix: str = "") -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            row = [0.0] * self.dim
            for token in TOKEN.findall((prefix + (text or "")).lower()):
                k, sign = self._place(token)
                row[k] += sign
            out[i] = row
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return self.embed(texts, self.document_prefix)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed([text], self.query_prefix)[0]


#: Embedders by name: what makes one, and what it is to be made with.
SPECS: dict[str, tuple[Callable, dict]] = {"hash": (HashEmbedder, {"dim": 64})}


def register_embedder(name: str, make: Callable, **options) -> None:
    """Adds a specification: dimensions, prefixes of documents and queries, and whatever else the maker takes."""
    SPECS[name] = make, options


def load_spec(name: str) -> dict:
    if name not in SPECS:
        raise KeyError(f"unknown embedder {name!r}; known: {sorted(SPECS)}")
    return dict(SPECS[name][1])


def get_embedder(name: str):
    options = load_spec(name)
    return SPECS[name][0](**options)


def beyond_context(texts: DataFrame, most: int, units: Column) -> DataFrame:
    """Rows whose text is longer than an embedder reads: it would be cut without a word."""
    return texts.where(units > most)


def write_vectors(rows: DataFrame, path: str, embedder: str, strategy: str) -> None:
    """(hash, text) -> the store of an embedder and strategy: vectors of texts that it lacks are appended, once a hash."""
    spark, make = rows.sparkSession, lambda: get_embedder(embedder)
    wanted = rows.select("hash", "text").dropDuplicates(["hash"])
    if _stored(spark, path, embedder, strategy):
        wanted = missing_vectors(wanted, read_vectors(spark, path, embedder, strategy))
    made = wanted.select("hash", document_vectors(F.col("text"), make).alias("vector"), F.lit(embedder).alias("embedder"), F.lit(strategy).alias("strategy"))
    made.write.mode("append").partitionBy("embedder", "strategy").parquet(path)


def _stored(spark: SparkSession, path: str, embedder: str, strategy: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/embedder={embedder}/strategy={strategy}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_vectors(spark: SparkSession, path: str, embedder: str, strategy: str) -> DataFrame:
    """hash, vector of one embedder and strategy; other partitions are not read."""
    stored = spark.read.schema("hash string, vector array<double>, embedder string, strategy string").parquet(path)
    return stored.where((F.col("embedder") == embedder) & (F.col("strategy") == strategy)).select("hash", "vector")


def document_vectors(text: Column, make=HashEmbedder) -> Column:
    """array<double> of each text. `make` builds the embedder once a task."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model.embed_documents(list(texts))))

    return run(text)


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda x: x / norm))


def missing_vectors(texts, vectors):
    """Texts (key, hash) that the store (hash, vector) lacks; a store is valid if there are none."""
    return texts.join(vectors, "hash", "left_anti")


def require_vectors(texts, vectors):
    """Joins stored vectors by content hash and fails if any is missing."""
    if missing_vectors(texts, vectors).limit(1).count():
        raise LookupError("texts without a stored vector")
    return texts.join(vectors, "hash")
