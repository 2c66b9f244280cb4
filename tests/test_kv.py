from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prefixspark.operators import kv, radix
from prefixspark.schemas import KV_OPS, KV_STATE


def log(spark, ops):
    return spark.createDataFrame([(i, op, bytearray(k), None if v is None else Decimal(v)) for i, (op, k, v) in enumerate(ops)], KV_OPS)


def state(spark, entries):
    return spark.createDataFrame([(bytearray(k), Decimal(v)) for k, v in entries.items()], KV_STATE)


def match(spark, entries, queries):
    probes = spark.createDataFrame([(i, bytearray(q)) for i, q in enumerate(queries)], "i INT, query BINARY")
    rows = kv.longest_prefix(state(spark, entries), probes).orderBy("i").collect()
    return [None if r["matched_bytes"] is None else (r["matched_bytes"], int(r["value"])) for r in rows]


def test_every_key_comes_back(spark):
    keys = [b"hello", b"world", b"hell", b"hellfire", b"", b"\0\0", b"\xff\xff\xff", b"a rather long sentence, as keys go"]
    current = kv.current(log(spark, [("put", k, i * 7 + 1) for i, k in enumerate(keys)]))
    probes = spark.createDataFrame([(bytearray(k),) for k in [*keys, b"absent"]], "key BINARY")
    got = {bytes(r["key"]): r["value"] for r in kv.get(current, probes).collect()}
    assert got == {**{k: i * 7 + 1 for i, k in enumerate(keys)}, b"absent": None}


def test_previous_values_and_deletes(spark):
    ops = [("put", b"k", 1), ("put", b"k", 2), ("put", b"k", 3), ("del", b"k", None), ("del", b"k", None), ("del", b"x", None), ("put", b"k", 4)]
    rows = kv.history(log(spark, ops)).orderBy("seq").collect()
    assert [r["previous"] for r in rows] == [None, 1, 2, 3, None, None, None]
    assert [r["existed"] for r in rows] == [False, True, True, True, False, False, False]
    assert [int(r["value"]) for r in kv.current(log(spark, ops)).collect()] == [4]
    assert kv.current(log(spark, ops[:4])).count() == 0


def test_nested_prefixes(spark):
    assert match(spark, {b"ab": 1, b"abcd": 2, b"abcdef": 3}, [b"abcdefgh", b"abcde", b"abc", b"ab", b"a", b"xyz"]) == [(6, 3), (4, 2), (2, 1), (2, 1), None, None]


def test_empty_key_is_a_prefix_of_all(spark):
    assert match(spark, {b"": 5, b"ab": 9}, [b"ab", b"ac", b""]) == [(2, 9), (0, 5), (0, 5)]
    assert match(spark, {}, [b"ab"]) == [None]


def test_deleted_keys_are_skipped(spark):
    ops = [("put", b"ab", 2), ("put", b"abcd", 2), ("del", b"ab", None)]
    probes = spark.createDataFrame([(0, bytearray(b"abc")), (1, bytearray(b"abcd"))], "i INT, query BINARY")
    found = lambda o: [r["matched_bytes"] for r in kv.longest_prefix(kv.current(log(spark, o)), probes).orderBy("i").collect()]
    assert found(ops) == [None, 4]
    assert found([*ops, ("put", b"ab", 7)]) == [2, 4]


def test_values_up_to_64_bits(spark):
    values = [1 << 56, (1 << 64) - 1, (1 << 56) + 5, 3]
    current = radix.leaves(kv.current(log(spark, [("put", bytes([i]), v) for i, v in enumerate(values)])))
    assert {int(r["value"]): r["leaf"] for r in current.collect()} == {1 << 56: "LeafOffset", (1 << 64) - 1: "LeafOffset", (1 << 56) + 5: "LeafOffset", 3: "LeafInlined"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.binary(max_size=5), st.integers(0, 2**63), max_size=12), st.lists(st.binary(max_size=7), min_size=1, max_size=8))
def test_longest_prefix_is_stored_and_maximal(spark, entries, queries):
    want = []
    for q in queries:
        k = max((k for k in entries if q.startswith(k)), key=len, default=None)
        want.append(None if k is None else (len(k), entries[k]))
    assert match(spark, entries, queries) == want


def test_radix_nodes(spark):
    keys = spark.createDataFrame([(bytearray([0x60 + i]),) for i in range(16)], "key BINARY")
    rows = {(r["depth"], r["path"]): r for r in radix.nodes(keys).collect()}
    assert len(rows) == 1 + 1 + 16
    assert (rows[0, ""]["n_children"], rows[0, ""]["family"], rows[0, ""]["has_leaf"]) == (1, "Node4", False)
    assert (rows[1, "6"]["bitmap"], rows[1, "6"]["family"]) == (0xFFFF, "Node16")
    assert rows[2, "6A"]["has_leaf"] and rows[2, "6A"]["n_children"] == 0


@pytest.mark.parametrize(("key", "want"), [(b"\x12\x34", [1, 2, 3, 4]), (b"\xff", [15, 15]), (b"", [])])
def test_nibbles(spark, key, want):
    df = spark.createDataFrame([(bytearray(key),)], "key BINARY")
    assert [r["nibble"] for r in radix.key_nibbles(df).orderBy("position").collect()] == want


def test_names_that_clash(spark):
    names = ["query", "q", "best", "k", "key", "lengths", "_q", "_best"]
    probes = spark.createDataFrame([(bytearray(b"abc"), 1, 2, 3, 4, 5, 6, 7)], "query BINARY, " + ", ".join(f"{n} INT" for n in names[1:]))
    found = kv.longest_prefix(state(spark, {b"ab": 9}), probes)
    assert found.columns == [*names, "matched_bytes", "value"] and tuple(found.first())[1:] == (1, 2, 3, 4, 5, 6, 7, 2, 9)
