import pytest
from pyspark.sql import functions as F

from prefixspark import api
from prefixspark.errors import InvalidNodeType, VectorDimensionMismatch
from prefixspark.operators import arena, vector, wal
from prefixspark.schemas import FRAMES
from prefixspark.sources.log_sink import LogSink


def vectors(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x)] * 4) for i, x in enumerate(rows)], f"{name} BIGINT, vec ARRAY<FLOAT>")


def test_index_functions(spark, tmp_path):
    assert api.version() == (0, api.VERSION)
    assert api.index_create(spark, None, 4, 2, 2, 1) == (100, None)
    assert api.index_create(spark, "x", 4, 2, 3, 1) == (10, None)
    status, h = api.index_create(spark, f"file://{tmp_path}", 4, 2, 2, 1)
    assert status == 0 and api.index_is_trained(h) == (0, False) and api.index_vector_count(h) == (10, None)
    assert api.index_recluster(h) == (0, None)
    assert api.index_train(h, vectors(spark, [10 * (-1) ** i for i in range(300)])) == (0, 1)
    assert api.index_insert(h, vectors(spark, [9, 10, 11]).select("vec")) == (0, None) and api.index_vector_count(h) == (0, 3)
    status, hits = api.index_search(h, vectors(spark, [10], "query_id"), 2)
    assert status == 0 and hits.count() == 2
    short = spark.createDataFrame([(0, [1.0])], "query_id BIGINT, vec ARRAY<FLOAT>")
    assert api.index_search(h, short, 2) == (9, None) and api.index_search(h, None, 2) == (100, None)
    assert api.index_destroy(h) == (0, None) and api.index_vector_count(h) == (10, None)


def test_cache_functions():
    assert api.kv_create(100) == (10, None)
    _, h = api.kv_create(4096)
    assert api.kv_insert(h, [1, 2], 5) == (0, None) and api.kv_insert(h, [], 5) == (10, None)
    assert api.kv_match(h, [1, 2, 3]) == (0, (2, 5)) and api.kv_match(h, [9]) == (0, None)
    assert api.kv_evict(h, 512) == (0, 0) and api.kv_evict(h, 512) == (0, 1) and api.kv_evict(h, None) == (100, None)
    assert api.index_train(h, 1) == (10, None)  # a handle of the other kind
    assert api.kv_destroy(h) == (0, None)


def test_log_sink(spark, tmp_path):
    sink = LogSink(spark, f"file://{tmp_path}/log")
    assert sink.is_empty() and sink.flush_count() == 0
    update = wal.opcode_of("Update")
    tx = lambda i, b: spark.createDataFrame([(i, 0, True, 0, update, 0x10, bytearray(b)), (i, 1, False, 1, 0, 0x10, bytearray(4))], FRAMES)
    assert [sink.flush(tx(0, b"\x01\x02")), sink.flush(tx(1, b"\x03"))] == [0, 1]
    sink.flush(tx(1, b"\x09"), flush=1)  # a repeated batch
    assert sink.flush_count() == 2 and sink.size() == 2 * 14 + 2 + 2 * 14 + 1 + 8
    assert {r["address"]: r["byte"] for r in sink.recover().collect()} == {0x10: 3, 0x11: 2}
    assert [r["opcode"] for r in sink.frames().orderBy("order").collect()] == [0, update, 0, update]


def test_checks(spark):
    assert arena.node_type_of(5) == "Node256"
    for bad in (6, 7, -1):
        with pytest.raises(InvalidNodeType):
            arena.node_type_of(bad)
    assert vector.codebook_of(range(2 * 256 * 2), 4, 2)[1, 0].tolist() == [512, 513]
    with pytest.raises(VectorDimensionMismatch):
        vector.codebook_of([1.0], 4, 2)
    df = spark.createDataFrame([(0, 8, 8, True), (4, 8, 8, False), (56, 8, 8, True), (64, 8, 8, False)], "o INT, s INT, a INT, want BOOLEAN")
    assert df.where(arena.in_bounds(F.col("o"), F.col("s"), F.col("a"), F.lit(64)) != F.col("want")).count() == 0
