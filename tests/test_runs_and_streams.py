"""Run store, reports, imports and streams."""

from pyspark.sql import functions as F

from scriptorium.operators import flow, runs
from scriptorium.streaming import incremental


def test_runs(spark, tmp_path):
    path = f"{tmp_path}/runs"
    for v in (0.5, 0.6):
        runs.record(spark, path, "retrieval", "bm25", {"mrr": v}, config={"b": 1, "a": 2}, folder=str(tmp_path))
    got = runs.history(spark, path, "retrieval", "bm25").collect()
    assert [r.metrics["mrr"] for r in got] == [0.6, 0.5] and got[0].git_sha == "nogit"
    assert runs.config_hash({"a": 1, "b": 2}) == runs.config_hash({"b": 2, "a": 1})
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, 0.5)], "k int, w double")
    both = runs.combine([a, b])
    assert both.columns == ["k", "v", "w"] and runs.dataset_version(both) == runs.dataset_version(both.orderBy(F.desc("k")))
    report = tmp_path / "r.md"
    runs.write_report(str(report), "T", runs.markdown(both, "w"))
    report.write_text(report.read_text().replace("_fill in_", "Keep it."))
    runs.write_report(str(report), "T2", "x")
    assert "Keep it." in report.read_text() and "# T2" in report.read_text()


def test_imports(spark):
    good = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "key string, vector array<double>")
    need = good.select("key")
    assert runs.verify_import(good, need, 2) == []
    assert runs.verify_import(good.where("key = 'a'").withColumn("vector", F.array(F.lit(2.0))), need, 2) == ["1 wrong dimension", "1 not of unit length", "1 keys without a vector"]
    assert runs.same_vectors(good, good) and not runs.same_vectors(good, good.withColumn("vector", F.reverse("vector")))


def test_ingest_stream(spark, tmp_path):
    go = lambda: incremental.ingest_stream(spark, f"{tmp_path}/in", "key string, text string", f"{tmp_path}/store", f"{tmp_path}/cp", lambda df: df).awaitTermination()
    spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string").write.parquet(f"{tmp_path}/in", mode="append")
    go()
    spark.createDataFrame([("c", "x"), ("d", "z")], "key string, text string").write.parquet(f"{tmp_path}/in", mode="append")
    go()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/store").collect()) == ["x", "y", "z"]


def test_session_stream(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns.write.parquet(f"{tmp_path}/in")
    stream = incremental.session_histories(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r.conv_id, r.turn): r.history for r in spark.table("sessions").collect()}
    assert got == {(r.conv_id, r.turn): r.history for r in flow.history(turns).collect()}


def test_event_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    counts = incremental.hourly_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    counts.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == events.count()
