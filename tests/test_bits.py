import pytest
from pyspark.sql import functions as F

from prefixspark import errors
from prefixspark.functions import bits, hashing, text
from prefixspark.functions.rng import MULTIPLIER, Xorshift64Star


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


@pytest.mark.parametrize("node_type", range(6))
@pytest.mark.parametrize("arena", [0, 15])
@pytest.mark.parametrize("tombstone", [False, True])
def test_pointer_round_trip(spark, node_type, arena, tombstone):
    word = bits.pack_pointer(F.lit(node_type), F.lit((1 << 40) - 1), F.lit(arena), F.lit(tombstone), F.lit(0xABCD))
    got = one(spark, **bits.unpack_pointer(word), w=word)
    assert got.pop("w") < 0  # the polymorphic field reaches the sign
    assert got == {"node_type": node_type, "offset": (1 << 40) - 1, "arena": arena, "tombstone": tombstone, "poly": 0xABCD}


def test_corrupt_type_reads_as_inlined_leaf(spark):
    assert one(spark, **bits.unpack_pointer(F.lit(7).cast("long")))["node_type"] == 0


@pytest.mark.parametrize("tombstone", [False, True])
def test_inline_payload(spark, tombstone):
    word = bits.pack_inline(F.lit((1 << 56) - 1), F.lit(tombstone))
    got = one(spark, **bits.unpack_inline(word), w=word, marked=bits.mark_tombstone(word))
    assert got["payload"] == (1 << 56) - 1 and got["tombstone"] is tombstone
    assert got["w"] >> 60 == 0 and got["w"] >> 47 & 1 == tombstone and got["marked"] == got["w"] | 1 << 47


def test_child_rank(spark):
    mask = F.lit(0b1000_0000_0000_1110)
    ranks = {f"n{n}": bits.child_rank(mask, F.lit(n)) for n in (1, 2, 3, 15, 4)}
    assert list(one(spark, **ranks, dead=bits.child_rank(mask, F.lit(1), True)).values()) == [0, 1, 2, 3, None, None]


def test_event_words(spark):
    for number, kind in enumerate(bits.EVENT_KINDS):
        got = one(spark, **bits.decode_event(bits.encode_event(F.lit(number), F.lit((1 << 28) + 7), F.lit(5))))
        assert got == {"kind": kind, "a": 7, "b": 5}
    got = one(spark, **bits.decode_event(bits.encode_event(F.lit(77), F.lit(0), F.lit(0))))
    assert got["kind"] == "ClockEvict" and one(spark, t=bits.event_text(F.lit("KvMatch"), F.lit(1), F.lit(2)))["t"] == "KvMatch a=1 b=2"


def test_families(spark):
    assert list(one(spark, **{f"n{n}": bits.node_family(F.lit(n)) for n in (0, 4, 5, 16, 17, 64, 65)}).values()) == ["Node4", "Node4", "Node16", "Node16", "Node64", "Node64", "Node256"]


def test_sizes_and_shares(spark):
    parsed = {s: text.parse_size(F.lit(s)) for s in ("4KB", "64MB", "1GB", "1024", "nope", "1XB", "99999999999999999999")}
    assert list(one(spark, **parsed).values()) == [4096, 1 << 26, 1 << 30, 1024, None, None, None]
    shown = {f"b{n}": text.format_bytes(F.lit(n)) for n in (0, 1023, 1024, 1 << 20, 3 << 29)}
    assert list(one(spark, **shown).values()) == ["0 B", "1023 B", "1.0 KiB", "1.0 MiB", "1.5 GiB"]
    assert one(spark, p=text.percent(F.lit(0.256)), q=text.percent(F.lit(1.0))) == {"p": "25.6%", "q": "100.0%"}
    bars = one(spark, a=text.bar(F.lit(0.5), 12), b=text.bar(F.lit(2.0), 8), c=text.bar(F.lit(-1.0), 8))
    assert bars == {"a": "[" + "▓" * 5 + "░" * 5 + "]", "b": "[" + "▓" * 6 + "]", "c": "[" + "░" * 6 + "]"}


def test_generator():
    assert Xorshift64Star(6).state == Xorshift64Star(7).state == 7
    x = 7
    x ^= x >> 12
    x = (x ^ (x << 25)) % 2**64
    x ^= x >> 27
    rng = Xorshift64Star(6)
    assert rng.next_u64() == x * MULTIPLIER % 2**64
    assert all(0 <= rng.next_f32() < 1 for _ in range(1000))
    assert sorted(rng.distinct(20, 20)) == list(range(20))


def test_fnv(spark):
    def plain(b):
        h = hashing.BASIS
        for x in b:
            h = (h ^ x) * hashing.PRIME % 2**64
        return h % 2**56

    keys = [b"", b"a", b"storm:00000000002a", bytes(range(256))]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k BINARY").coalesce(1)
    assert [r["h"] for r in df.select(hashing.fnv1a56("k").alias("h")).collect()] == [plain(k) for k in keys]


def test_status_codes():
    order = ["ArenaBoundsExceeded", "ArenaCapacityExceeded", "AllocationFailed", "InvalidNodeType", "WalFrameMalformed", "WalFrameTooLarge", "UnknownPinnedPointer", "TreeInvariantViolation", "VectorDimensionMismatch", "InvalidParameter", "CacheCapacityExceeded", "GpuDriverUnavailable"]
    assert [getattr(errors, n).status for n in order] == list(range(1, 13)) and errors.NULL_ARGUMENT == 100
