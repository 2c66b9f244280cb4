import pytest
from pyspark.sql import functions as F

from prefixspark.errors import WalFrameMalformed, WalFrameTooLarge
from prefixspark.operators import audit
from prefixspark.operators import wal as W
from prefixspark.schemas import FRAMES

ALLOC, FREE, UPDATE = map(W.opcode_of, W.OPCODES)


def frames(spark, rows):
    """rows: (tx_id, pos, is_parent, opcode, offset, payload); the log's order is theirs."""
    return spark.createDataFrame([(tx, pos, parent, i, op, offset, bytearray(p)) for i, (tx, pos, parent, op, offset, p) in enumerate(rows)], FRAMES).withColumn("log_id", F.lit(0).cast("bigint"))


def log_bytes(spark, rows):
    return bytes(W.encode_logs(W.commit_order(frames(spark, rows))).first()["bytes"])


THREE = [(0, 0, False, ALLOC, 0x10, (48).to_bytes(4, "big")), (0, 1, False, FREE, 0x10, (48).to_bytes(4, "big")), (0, 2, True, UPDATE, 0, b"\x01\x02\x03")]


def test_layout_and_round_trip(spark):
    raw = log_bytes(spark, THREE)
    assert raw[-17:] == b"\x00\x00\x00\x0d\x02\x00\x00\x00\x00\x00\x00\x00\x00\x03\x01\x02\x03"
    assert W.parse_frames(raw) == [(op, offset, p) for _, _, _, op, offset, p in THREE]
    logs = spark.createDataFrame([(7, bytearray(raw)), (8, None)], "log_id BIGINT, bytes BINARY")
    assert [(r["lsn"], r["opcode"], r["offset"], bytes(r["payload"])) for r in W.parse_logs(logs).orderBy("lsn").collect()] == [(i, op, offset, p) for i, (_, _, _, op, offset, p) in enumerate(THREE)]


@pytest.mark.parametrize("cut", [1, 3, 10, 16])
def test_torn_tail(spark, cut):
    raw = log_bytes(spark, THREE)
    with pytest.raises(WalFrameMalformed):
        W.parse_frames(raw[:-cut])
    assert len(W.parse_frames(raw[:-cut], tolerant=True)) == 2


def test_wrong_frames():
    good = b"\x00\x00\x00\x0b\x02" + bytes(5) + b"\x00\x00\x00\x01x"
    assert W.parse_frames(good) == [(2, 0, b"x")]
    for bad in (good[:3] + b"\x0c" + good[4:], good[:4] + b"\x03" + good[5:], b"\x00\x00\x00\x05\x00"):
        with pytest.raises(WalFrameMalformed):
            W.parse_frames(bad)
    with pytest.raises(WalFrameTooLarge):
        W.parse_frames(b"\x00\x20\x00\x00" + bytes(20))
    with pytest.raises(WalFrameTooLarge):
        W.parse_frames(good * 3, most=2)
    with pytest.raises(WalFrameMalformed):
        W.opcode_of("Grow")


def test_payload_limit(spark):
    fits = spark.range(1).select(W.encode_frame(F.lit(2), F.lit(0), F.expr(f"cast(repeat('x', {W.MOST_PAYLOAD}) as binary)")).alias("f"))
    assert len(fits.first()["f"]) == W.MOST_PAYLOAD + W.HEADER
    over = spark.range(1).select(W.encode_frame(F.lit(2), F.lit(0), F.expr(f"cast(repeat('x', {W.MOST_PAYLOAD + 1}) as binary)")).alias("f"))
    with pytest.raises(Exception, match="payload above the limit"):
        over.collect()


def test_children_come_before_the_parent(spark):
    rows = [(1, 0, True, UPDATE, 0, b"p"), (1, 1, False, ALLOC, 8, b"\0\0\0\x08"), (0, 0, True, UPDATE, 0, b""), (2, 0, True, UPDATE, 4, b"q")]
    ordered = W.commit_order(frames(spark, rows)).orderBy("order").collect()
    assert [(r["tx_id"], r["is_parent"]) for r in ordered] == [(1, False), (1, True), (2, True)]  # an empty transaction writes nothing


def test_replay_and_high_water(spark):
    f = frames(spark, [(0, 0, False, ALLOC, 0x100, (48).to_bytes(4, "big")), (0, 1, True, UPDATE, 0x100, b"\x11\x22\x33\x44"), (1, 0, True, UPDATE, 0x102, b"\xff"), (2, 0, True, UPDATE, 0x200, b"")])
    image = {r["address"]: r["byte"] for r in W.replay(f).collect()}
    assert image == {0x100: 0x11, 0x101: 0x22, 0x102: 0xFF, 0x103: 0x44}
    assert W.high_water(f.where("tx_id < 2")).first()["high_water"] == 0x104
    assert {r["address"]: r["byte"] for r in W.replay(f.union(f.withColumn("lsn", F.col("lsn") + 10))).collect()} == image


def test_crash_keeps_the_first_transactions(spark):
    rows = [(i, 0, True, UPDATE, 8 * i, (i + 1).to_bytes(8, "little")) for i in range(64)]
    image = audit.crash_audit(frames(spark, rows), 40).where("address % 8 = 0").collect()
    assert {r["address"] // 8: r["byte"] for r in image} == {i: i + 1 for i in range(40)}
