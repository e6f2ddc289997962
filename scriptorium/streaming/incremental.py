"""Streams: incremental ingestion by content hash, and sessions that remember their last messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.flow import CHARACTERS, MESSAGES


def ingest_stream(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, ingest: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Rows (key, text, …) of new files whose content the store lacks are ingested and appended to it."""

    def step(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("hash", F.sha2("text", 256)).dropDuplicates(["hash"])
        try:
            known = batch.sparkSession.read.parquet(store).select("hash")
            hashed = hashed.join(known, "hash", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        ingest(hashed).write.mode("append").parquet(store)

    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


TURN = "conv_id long, turn long, role string, text string, history string"


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    said = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches)).sort_values("turn")
    history = []
    for r in rows.itertuples():
        history.append("\n".join(said) if said else None)
        said = [*said, f"{r.role}: {(r.text or '')[:CHARACTERS]}"][-MESSAGES:]
    state.update((said,))
    yield rows[["conv_id", "turn", "role", "text"]].assign(history=history)


def session_histories(turns: DataFrame) -> DataFrame:
    """A stream of turns with what their sessions said before, across batches; turns of a batch are taken in order."""
    return turns.groupBy("conv_id").applyInPandasWithState(_remember, TURN, "said array<string>", "append", "NoTimeout")


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events an hour and type, for events that come up to `late` behind the newest."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
