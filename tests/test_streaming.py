import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prefixspark.operators import cache, vector
from prefixspark.plans.entries import cache_ops
from prefixspark.sources.catalog import Catalog
from prefixspark.streaming import jobs

SF = "/root/testdata/sf0.001"


def drain(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_hourly_rates_and_sessions(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/events.parquet")
    part = F.ntile(3).over(Window.orderBy("ts", "event_id"))
    for i in (1, 2, 3):  # one file after the other, in order of time: a stream takes files by their time of writing
        whole.withColumn("part", part).where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = drain(jobs.hourly_rates(stream()), spark, "rates", tmp_path, "complete")
    want = whole.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").count()
    assert sorted((str(r["window"]["start"]), r["event_type"], r["n"]) for r in got.collect()) == sorted((str(r["h"]), r["event_type"], r["count"]) for r in want.collect())
    assert drain(jobs.sessions(stream()), spark, "sessions", tmp_path, "complete").agg(F.sum("n")).first()[0] == whole.count()


def test_late_rows(spark, tmp_path):
    """A row behind the watermark is dropped, one within it counts. Rows are held against the watermark that the batch before had."""
    at = lambda rows: spark.createDataFrame(rows, "ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1)
    files = [[("2024-01-01 10:00:00", 1, "a")], [("2024-01-01 12:00:00", 1, "a")], [("2024-01-01 12:01:00", 4, "a")], [("2024-01-01 10:05:00", 1, "a"), ("2024-01-01 11:55:00", 2, "a")], [("2024-01-01 20:00:00", 3, "a")], [("2024-01-01 20:01:00", 3, "a")]]
    for rows in files:
        at(rows).write.mode("append").parquet(f"file://{tmp_path}/files")
    stream = spark.readStream.schema(at(files[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/files")
    got = drain(jobs.hourly_rates(stream), spark, "late", tmp_path)
    assert sorted((r["window"]["start"].hour, r["n"]) for r in got.collect()) == [(10, 1), (11, 1), (12, 2)]


def test_clock_stream_equals_batch(spark, tmp_path):
    ops = cache_ops(spark, SF)
    want = sorted(map(str, cache.replay(ops, 4096).collect()))
    files = ops.withColumn("part", F.ntile(3).over(Window.orderBy("seq")))
    for i in (1, 2, 3):
        files.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/ops")
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/ops")
    assert sorted(map(str, drain(jobs.clock(stream, 4096), spark, "clock", tmp_path).collect())) == want


def test_vector_appends_are_idempotent(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = vector.IvfIndex(spark, vector.IvfConfig(64, 2, 2, 5), Catalog(spark, f"file://{tmp_path}/index"))
    index.train(vectors)
    vectors.limit(100).write.parquet(f"file://{tmp_path}/vec")
    for name in ("one", "two"):  # the second query reads the same files again
        stream = spark.readStream.schema(vectors.schema).parquet(f"file://{tmp_path}/vec")
        jobs.append_vectors(stream, index, str(tmp_path / name)).awaitTermination(120)
    assert index.vector_count() == 100 and index.catalog.postings(1).count() == 100


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
