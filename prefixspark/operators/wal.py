"""Write-ahead log: frame codec, commit order, parsing, replay to a byte image.

A frame is: 4 bytes length of what follows the length and its own 4 payload-length bytes (10 + payload), 1 byte operation, 5 bytes
offset, 4 bytes payload length, payload; numbers are big-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WalFrameMalformed, WalFrameTooLarge, require

# Operations by number, the frame's overhead, and the limits.
OPCODES = ("Alloc", "Free", "Update")
LENGTH_OVERHEAD, HEADER = 10, 14
MOST_PAYLOAD, MOST_FRAMES = 1 << 20, 1 << 22


def opcode_of(name: str) -> int:
    require(name in OPCODES, f"unknown operation {name}", WalFrameMalformed)
    return OPCODES.index(name)


def _big_endian(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def encode_frame(opcode: Column, offset: Column, payload: Column) -> Column:
    """The frame's bytes; a payload above the limit is an error."""
    n = F.octet_length(payload)
    body = F.concat(_big_endian(n + LENGTH_OVERHEAD, 4), _big_endian(opcode, 1), _big_endian(offset, 5), _big_endian(n, 4), payload)
    return F.when(n <= MOST_PAYLOAD, body).otherwise(F.raise_error(F.lit("payload above the limit")).cast("binary"))


def encoded_length(payload: Column) -> Column:
    """A frame's declared length: its payload and ten bytes more."""
    return F.octet_length(payload) + LENGTH_OVERHEAD


def region_payload(length: Column) -> Column:
    """The payload of an allocation or a release: the region's length."""
    return _big_endian(length, 4)


def commit_order(frames: DataFrame) -> DataFrame:
    """``frames`` with ``order`` (transaction, children before parent, place). Transactions of an empty parent and no children go."""
    counted = frames.groupBy("tx_id").agg(F.count("*").alias("_n"), F.max(F.octet_length("payload")).alias("_longest"))
    real = counted.where((F.col("_n") > 1) | (F.col("_longest") > 0)).select("tx_id")
    return frames.join(real, "tx_id", "left_semi").withColumn("order", F.struct("tx_id", "is_parent", "pos"))


def encode_logs(frames: DataFrame, log: str = "log_id") -> DataFrame:
    """(log, bytes): the frames of each log in ``order``. A log is what one flush holds."""
    one = F.struct("order", F.hex(encode_frame(F.col("opcode"), F.col("offset"), F.col("payload"))).alias("h"))
    ordered = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["h"])
    return frames.groupBy(log).agg(F.unhex(F.array_join(ordered, "")).alias("bytes"))


def parse_frames(raw: bytes, tolerant: bool = False, most: int = MOST_FRAMES) -> list[tuple[int, int, bytes]]:
    """(opcode, offset, payload) of each frame. A torn or wrong frame is an error, or the end of the log if ``tolerant``."""
    out, at = [], 0
    while at < len(raw):
        length = int.from_bytes(raw[at : at + 4], "big")
        size = int.from_bytes(raw[at + 10 : at + HEADER], "big")
        whole = at + HEADER <= len(raw) and length == size + LENGTH_OVERHEAD and at + HEADER + size <= len(raw) and raw[at + 4] < len(OPCODES)
        if not whole or len(out) >= most or length > MOST_PAYLOAD:
            if tolerant:
                break
            if whole or (at + 4 <= len(raw) and length > MOST_PAYLOAD):
                raise WalFrameTooLarge(f"at byte {at}")
            raise WalFrameMalformed(f"at byte {at}")
        out.append((raw[at + 4], int.from_bytes(raw[at + 5 : at + 10], "big"), raw[at + HEADER : at + HEADER + size]))
        at += HEADER + size
    return out


def parse_logs(logs: DataFrame, log: str = "log_id", tolerant: bool = False) -> DataFrame:
    """(log, lsn, opcode, offset, payload) of each frame, lsn from 0. Strict: one bad frame fails the log, with nothing applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames = parse_frames(raw or b"", tolerant)
                columns = list(zip(*frames, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(frames), pa.int64()), pa.array(range(len(frames)), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int8(), pa.int64(), pa.binary()), strict=True))], names=[log, "lsn", "opcode", "offset", "payload"])

    return logs.select(F.col(log).cast("bigint"), "bytes").mapInArrow(run, f"{log} BIGINT, lsn BIGINT, opcode TINYINT, offset BIGINT, payload BINARY")


def replay(frames: DataFrame, order: str = "lsn") -> DataFrame:
    """(address, byte): the image after all updates, the last writer of each byte winning."""
    writes = frames.where(F.col("opcode") == opcode_of("Update")).select(order, "offset", "payload")
    each = writes.select(order, "offset", F.posexplode(F.split(F.regexp_replace(F.hex("payload"), "(..)(?=.)", "$1 "), " ")).alias("i", "h"))
    each = each.where("h <> ''").select(order, (F.col("offset") + F.col("i")).alias("address"), F.conv("h", 16, 10).cast("smallint").alias("byte"))
    return each.groupBy("address").agg(F.max_by("byte", order).alias("byte"))


def high_water(frames: DataFrame) -> DataFrame:
    """One row: the largest end of any frame's payload."""
    return frames.agg(F.max(F.col("offset") + F.octet_length("payload")).alias("high_water"))
