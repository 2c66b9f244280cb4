"""Removal of byte strings that repeat, in this document or any other.

The result is defined on all strings of ``length`` bytes ("windows"). A window's anchor is its 64-byte gram of the
least hash, the first of equals; equal windows have equal anchors at equal places. So the windows of a text fall
into runs with one anchor each, and only runs with equal anchor grams need be compared:

1. every text gives its runs (gram, place of the anchor, range of starts, hash of all the run's bytes), no text;
2. counts by (gram, run hash) settle most: a gram that occurs once has no repeated window, a run whose whole bytes
   occur twice has only repeated ones;
3. the bytes of the other runs, and one copy of each run they may repeat, go to the task of their gram as the documents
   of a collection, with the anchor in one column. ``bwt_columns`` inserts one symbol of each per round and keeps the
   collection's transform and common prefixes: a window is repeated if the suffix before or after its own in the order has
   the window's length in common. A gram with very many different runs is not sent to one task: its windows go as rows to a
   distributed count by (gram, anchor's place in the window, 128 bits of hash);
4. the repeated windows of each text, merged to spans, meet the text again.

Equal windows always share their anchor and so their column, which is why the transform is needed by column only. Over
whole texts it would take a round for each symbol of the longest text, each over all suffixes so far; README has figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bwt_columns import repeated_windows
from .common import BROADCAST_ROWS, drop_scratch, materialise, scratch_mark, text_of

GRAM = 64
#: Different runs of a gram that one task compares; the windows of a gram with more are counted as rows.
HOT_RUNS = 8_000
#: A run with so many copies, or more in large tables, meets its copies by broadcast.
HOT_COPIES = 1_000
#: Runs that a task holds before it looks for repeats (at the next gram).
HELD_RUNS = 4_000
#: Starts that are handled at once, so that an anchor's place fits 20 bits.
PIECE = (1 << 20) - (1 << 12)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each 64-byte string, by doubling."""
    with np.errstate(over="ignore"):
        h, base, n = b.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while n < GRAM:
            h = h[:-n] * base + h[n:]
            base, n = base * base, 2 * n
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def runs_of(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor's place, first start, last start) of each run of windows, whatever the text's size."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(len(raw) - length + 1, 0), PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE + length - 1, len(raw) - at), at)
        h, low, m = gram_hashes(b), np.uint64((1 << 20) - 1), length - GRAM + 1
        k, s = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * s <= m:
            k, s = np.minimum(k[:-s], k[s:]), 2 * s
        if s < m:
            k = np.minimum(k[: s - m], k[m - s :])
        p = (k & low).astype(np.int64)
        cut = np.flatnonzero(np.diff(p)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(p) - 1]])
        for column, values in zip(out, (h[p[lo]].view(np.int64), p[lo] + at, lo + at, hi + at), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)  # type: ignore[return-value]


def _hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _emit_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found, whole = [], [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                g, p, lo, hi = runs_of(raw, length)
                which.append(np.full(len(g), i))
                found.append((g, p, lo, hi))
                whole += [_hash(raw[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            if not whole:
                continue
            at = pa.array(np.concatenate(which))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *(pa.array(c, pa.int64()) for c in columns), pa.array(whole, pa.int64())], names=["id", "t1", "t2", "gram", "p", "lo", "hi", "whole"])

    return run


def _emit_bytes(length: int):
    """The bytes of the wanted runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (raw, want) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for w in want:
                    at.append(i)
                    rows.append((w["gram"], w["lo"], w["p"], w["n"], w["hot"], raw[w["lo"] : w["hi"] + length]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True))], names=["t1", "t2", "gram", "lo", "p", "n", "hot", "bytes"])

    return run


_SPAN = "t1 long, t2 long, a long, b long"


def _spans(t1: list[int], t2: list[int], starts: list[np.ndarray], length: int) -> pa.RecordBatch:
    """Spans that the repeated windows at ``starts`` (ascending) cover, by text; windows up to ``length`` apart touch."""
    columns: list[list[int]] = [[], [], [], []]
    for x, y, s in zip(t1, t2, starts, strict=True):
        if len(s):
            cut = np.flatnonzero(np.diff(s) > length) + 1
            for part in np.split(s, cut):
                for column, v in zip(columns, (x, y, int(part[0]), int(part[-1]) + length), strict=True):
                    column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t1", "t2", "a", "b"])


def window_hashes(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of 128 bits of hash of each window."""
    h = [xxhash.xxh3_128_intdigest(raw[i : i + length]) for i in range(len(raw) - length + 1)]
    return np.array([x >> 64 for x in h], np.uint64).view(np.int64), np.array([x & ((1 << 64) - 1) for x in h], np.uint64).view(np.int64)


def _compare(length: int):
    """Runs sorted by gram; the repeated windows of those that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            t1, t2, gram, lo, p, n, raw = zip(*rows, strict=True)
            starts = repeated_windows(list(raw), np.array(gram), np.array(lo) - np.array(p) + length - GRAM, length)
            once = [i for i, k in enumerate(n) if k == 1]
            return _spans([t1[i] for i in once], [t2[i] for i in once], [starts[i] + lo[i] for i in once], length)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if len(rows) > HELD_RUNS and row[2] != rows[-1][2]:
                    yield flush()
                    rows = []
                rows.append(row)
        if rows:
            yield flush()

    return run


def _emit_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, gram, lo, p, n, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                h, g = window_hashes(raw, length)
                a = np.arange(lo, lo + len(h))
                columns = (*(np.full(len(h), x) for x in (t1, t2, gram, n)), a, p - a, h, g)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t1", "t2", "gram", "n", "a", "place", "h", "g"])

    return run


def merge_spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of the union of [a, b); spans that touch are one run."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[first], reach[np.append(first[1:], True)]


def kept_bytes(raw: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    return b"".join(raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        spans = batch.column(2)
        a, b = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = spans.offsets.to_numpy()
        for i, raw in enumerate(batch.column(1)):
            raw = raw.as_py()
            lo, hi = merge_spans(a[edges[i] : edges[i + 1]], b[edges[i] : edges[i + 1]])
            for column, v in zip(out, (len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(kept_bytes(raw, lo, hi)).hexdigest()), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def text_key(text: Column) -> list[Column]:
    """128 bits of hash, from two seeds."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(t1, t2, spans) for each text (by its 128-bit key) with repeated windows: spans are byte ranges, not yet merged."""
    text = text_of(text_col)
    raw = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), *text_key(text), text.cast("binary").alias("bytes")).where(F.length("bytes") >= length)
    key = "id long, t1 long, t2 long"
    runs = materialise(raw.mapInArrow(_emit_runs(length), f"{key}, gram long, p long, lo long, hi long, whole long"), "suffix-runs")
    counted = runs.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "t1", "t2", "lo", "hi", "p")).alias("one"))
    counted = materialise(counted, "suffix-counts")
    grams = counted.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("gram", (F.col("kinds") > hot_runs).alias("hot"))
    # one copy of each run to compare, by the text it is taken from
    wanted = counted.join(grams, "gram").select("one.*", F.struct("gram", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), F.col("one.p").alias("p"), "n", "hot").alias("w"))
    wanted = wanted.groupBy("id", "t1", "t2").agg(F.collect_list("w").alias("want"))
    sent = raw.join(wanted, ["id", "t1", "t2"]).select("t1", "t2", "bytes", "want").mapInArrow(_emit_bytes(length), "t1 long, t2 long, gram long, lo long, p long, n long, hot boolean, bytes binary")
    sent = materialise(sent, "suffix-edges")
    usual = sent.where(~F.col("hot")).repartition("gram").sortWithinPartitions("gram").select("t1", "t2", "gram", "lo", "p", "n", "bytes").mapInArrow(_compare(length), _SPAN)
    windows = sent.where("hot").select("t1", "t2", "gram", "lo", "p", "n", "bytes").mapInArrow(_emit_windows(length), "t1 long, t2 long, gram long, n long, a long, place long, h long, g long")
    key = ["gram", "place", "h", "g"]
    twice = windows.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key)
    hot = windows.where("n = 1").join(twice, key).select("t1", "t2", "a", (F.col("a") + length).alias("b"))
    # runs with very many copies meet their count by broadcast: at most BROADCAST_ROWS runs can have that many
    often = F.col("n") >= max(HOT_COPIES, -(-runs.count() // BROADCAST_ROWS))
    copied = counted.where("n > 1").select("gram", "whole", often.alias("often"))
    common = F.broadcast(copied.where("often").select("gram", "whole"))
    met = runs.join(common, ["gram", "whole"]).unionByName(runs.join(common, ["gram", "whole"], "left_anti").join(copied.where("NOT often").select("gram", "whole"), ["gram", "whole"]))
    whole = met.select("t1", "t2", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    # texts that are copies give equal spans: they are merged before anything is gathered by text
    spans = whole.unionByName(usual).unionByName(hot).distinct()
    return spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if any string of ``length`` bytes over it also starts elsewhere, in this text or another; strings are
    judged on the input. Null texts count as empty; texts below ``length`` stay whole, very long ones are read in pieces that
    overlap. Rows that repeat are separate texts and repeat each other. An empty table gives an empty table. Other columns are
    not read. Windows are compared byte by byte, but for whole runs (64 bits of hash, within equal grams) and the windows of hot
    grams (128 bits, within equal grams and places).
    """
    text, since = text_of(text_col), scratch_mark()
    spans = materialise(repeated_spans(docs, id_col, text_col, length, hot_runs), "suffix-spans")
    drop_scratch(docs.sparkSession, since, keep="suffix-spans")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text), text.cast("binary").alias("bytes"))
    none = F.array().cast("array<struct<a:long,b:long>>")
    return whole.join(spans, ["t1", "t2"], "left").select("doc_id", "bytes", F.coalesce("spans", none).alias("spans")).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
