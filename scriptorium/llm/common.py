"""What several training-data operators share: words, written tables, batch bounds and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
WORD_RE = re.compile(WORD)

#: Rows that may be broadcast, and bytes that they may have as a written table.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20

_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a compressed table in the cluster's shared checkpoint folder and forget how it was made.

    The table is deleted by discard(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of cut() frames that nothing will read again."""
    for df in frames:
        fs, at = _file_system(df.sparkSession, df.table_path)
        fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a single machine, as in tests, may name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scriptorium-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    if int(spark.conf.get(_batch)) > rows:
        spark.conf.set(_batch, str(rows))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the frame, written as by cut(), is small in rows and bytes; else leave the join to Spark."""
    df = df if "table_path" in vars(df) else cut(df)
    fs, at = _file_system(df.sparkSession, df.table_path)
    small = fs.getContentSummary(at).getLength() <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many _ behind it as it takes to be no column of the frame."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
