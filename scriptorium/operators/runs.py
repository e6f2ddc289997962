"""The append-only run store, report tables and verified imports."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "id long, ts double, experiment string, config_name string, config_hash string, git_sha string, dataset_ver string, n_scored long, metrics map<string,double>, pinned string"


def config_hash(config: dict, digits: int = 12) -> str:
    """Hash of a configuration that does not depend on the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:digits]


def git_sha(folder: str = ".") -> str:
    """Short commit, with `dirty-` before it if files changed; `nogit` outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return ("dirty-" if git("status", "--porcelain") else "") + git("rev-parse", "--short", "HEAD")
    except (OSError, subprocess.CalledProcessError):
        return "nogit"


def dataset_version(df: DataFrame, digits: int = 12) -> str:
    """Hash of a table's rows in any order: each row is hashed where it lies, the hashes are summed."""
    row = F.xxhash64(*[F.to_json(F.struct(*df.columns))])
    got = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{got.n}:{got.s}".encode()).hexdigest()[:digits]


def record(spark: SparkSession, path: str, experiment: str, config_name: str, metrics: dict[str, float], *, config: dict | None = None, pinned: dict | None = None, n_scored: int = 0, dataset: str = "", folder: str = ".") -> None:
    """Appends one run."""
    now = time.time()
    row = (time.time_ns(), now, experiment, config_name, config_hash(config or {}), git_sha(folder), dataset, n_scored, {k: float(v) for k, v in metrics.items()}, json.dumps(pinned or {}, sort_keys=True))
    spark.createDataFrame([row], RUNS).write.mode("append").partitionBy("experiment").parquet(path)


def history(spark: SparkSession, path: str, experiment: str, config_name: str | None = None, limit: int = 20) -> DataFrame:
    """The experiment's latest runs; the partition filter reaches the scan, the limit is a top-k."""
    runs = spark.read.schema(RUNS).parquet(path).where(F.col("experiment") == experiment)
    runs = runs.where(F.col("config_name") == config_name) if config_name else runs
    return runs.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def combine(tables: list[DataFrame]) -> DataFrame:
    """Rows of experiments that measured different things: the columns of all, null where one lacks them."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def markdown(rows: DataFrame, sort: str) -> str:
    """A small result table as Markdown, best first, missing values last."""
    names = rows.columns
    shown = lambda v: "—" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    body = [" | ".join(shown(r[c]) for c in names) for r in rows.orderBy(F.col(sort).desc_nulls_last()).collect()]
    return "\n".join(f"| {x} |" for x in [" | ".join(names), " | ".join("---" for _ in names), *body])


def write_report(path: str, title: str, table: str, default: str = "_fill in_") -> None:
    """Writes a report anew but keeps a decision that someone has written into the old one."""
    decision = default
    if os.path.exists(path):
        kept = open(path, encoding="utf-8").read().partition("## Decision\n")[2].strip()
        decision = kept if kept and "_fill in_" not in kept else default
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n\n{table}\n\n## Decision\n{decision}\n")


def verify_import(vectors: DataFrame, required: DataFrame, dim: int) -> list[str]:
    """What is wrong with delivered vectors (key, vector) for the required keys; nothing may be written unless empty."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    got = vectors.agg(F.count_if(F.size("vector") != dim).alias("dims"), F.count_if(F.isnan(norm) | (norm == float("inf"))).alias("finite"), F.count_if(F.abs(norm - 1) > 1e-3).alias("unit")).first()
    missing, extra = required.join(vectors, "key", "left_anti").count(), vectors.join(required, "key", "left_anti").count()
    found = {"wrong dimension": got.dims, "not finite": got.finite, "not of unit length": got.unit, "keys without a vector": missing, "vectors without a key": extra}
    return [f"{n} {what}" for what, n in found.items() if n]


def same_vectors(a: DataFrame, b: DataFrame, first: int = 50) -> bool:
    """Whether two models' first rows agree, which means that one was delivered twice."""
    both = a.orderBy("key").limit(first).join(b.withColumnRenamed("vector", "other"), "key")
    apart = F.aggregate(F.zip_with("vector", "other", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x.cast("double")))
    worst = both.agg(F.max(apart)).first()[0]
    return worst is not None and worst <= 1e-6
