"""A corpus from raw documents: language, near duplicates, benchmark leaks, secrets, mix.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last have the columns of documents. The driver
writes each stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, language_id, mixing, near_dedup, secret_scan
from scriptorium.llm.common import broadcast_if_small, cut, discard, free_name, table
from scriptorium.llm.queries import vocabulary

#: A document whose best language is less likely than this (or that has no letter) is rejected.
LEAST_SURE = 0.5


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of id and text, by which stages decide (an id may have several texts, or be null), and its name."""
    row = free_name(docs, "_row")
    return docs.withColumn(row, F.xxhash64("doc_id", "text")), row


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those that are `und` or too unsure go. Learns from the documents' own lang.

    Null, empty and letterless texts are `und`, so they go; without any lang to learn from, all do. Null ids and repeated
    rows are judged like others, long texts whole; an empty table gives an empty one.
    """
    scorer = language_id.train(docs.where(~language_id.held_out("doc_id")), vocabulary("piece_bpe_32k.model"))
    name = free_name(docs, "_language")
    judged = docs.withColumn(name, language_id.identify(docs, scorer))
    return judged.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SURE)).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id; of rows with its id and text, one.

    Rows with a null doc_id all stay. Null and empty texts are one class. Of one id's different texts each is a document.
    """
    known, row = _rows(docs.where("doc_id is not null"))
    slim = known.select(F.col(row).alias("_row"), "doc_id", "text")
    classes = cut(near_dedup.near_duplicates(slim.select("_row", "text"), key="_row"))
    ids = cut(slim.select("_row", "doc_id").join(classes.distinct(), "_row"))
    firsts = ids.groupBy("class_id").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    others = cut(ids.join(firsts, "class_id").where("_row != first._row").select(F.col("_row").alias(row)).distinct())
    kept = known.join(broadcast_if_small(others), row, "left_anti")
    if classes.groupBy("_row").count().where("count > 1").limit(1).count():  # else there is nothing to drop
        kept = kept.dropDuplicates([row])
    discard(classes, ids)
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; null ids and repeated rows are judged like others."""
    rows, row = _rows(docs)
    leaks = decontaminate.leaks(rows.select(row, "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), key=row)
    return rows.join(broadcast_if_small(cut(leaks.select(row).distinct())), row, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts and n_chars counted anew. A null text stays null, as does its n_chars."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often it takes each. Texts without a word are not taken; a null source is one more source."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]

#: Language scores and secret layers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
