"""Packing by optimal length buckets.

Texts are tokenised; texts longer than ``max_len`` are cut into pieces of that length and a rest, so the global
histogram has at most ``max_len`` lengths. Dynamic programming over it chooses the bucket bounds that need least
padding. Inside a bucket, batches of ``token_budget`` padded tokens form by the piece's global position, which
comes from counts by (bucket, shard) and the position in its shard: no task sees a whole bucket. Shards are dealt by row, so
copies of one row spread like all others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ROWS = 50_000


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(1)
def encoding(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str) -> tiktoken.Encoding:
    return encoding(vocabulary(path))


def _tokens(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(sent.value).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "shard_hash", "total"])

    return run


def choose_bounds(lengths: np.ndarray, counts: np.ndarray, k: int) -> tuple[list[int], int]:
    """The at most k upper bounds, from ascending lengths and their counts, with the least total padding, and that padding."""
    m = len(lengths)
    if not m:
        return [], 0
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(k, m)):
        new, came = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            new[j], came[j] = cost[i], i
        back.append(came)
        best = new
    bounds, j = [], m
    for came in reversed(back):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(came[j])
    return bounds[::-1], int(best[m])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = TOKENIZER, max_len: int = 4096, n_buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, bound, batch, slot, padding; (bucket, batch) names a batch.

    Null and empty texts have one row of no tokens, in no bucket (nulls). Very long texts are tokenised whole. Rows that repeat
    are packed each; which of equal rows takes which slot is open. Of bounds that tie for the least padding the lower ones win.
    An empty table gives an empty table. Other columns are not read. The vocabulary is read on the driver and sent out (it has a
    fixed size), so executors need no file.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("shard_hash"), text.alias("text"))
    sent = spark.sparkContext.broadcast(vocabulary(tokenizer_path))
    counted = picked.mapInArrow(_tokens(sent), "doc_id long, shard_hash long, total long")
    last = F.greatest(F.ceil(F.col("total") / max_len) - 1, F.lit(0)).cast("int")
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece")).withColumn("start", F.col("piece").cast("long") * max_len)
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())  # written with the piece, so it holds
    pieces = materialise(pieces.select("doc_id", "shard_hash", "row", "piece", "start", F.least(F.col("total") - F.col("start"), F.lit(max_len)).alias("n_tokens")), "packing")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(histogram), np.int64)
    bounds, _ = choose_bounds(lengths, np.array([histogram[n] for n in lengths.tolist()], np.int64), n_buckets)
    lows = [0, *bounds]
    table = F.broadcast(spark.createDataFrame([(n, b, bounds[b], max(1, token_budget // bounds[b])) for n in lengths.tolist() for b in [int(np.searchsorted(bounds, n))]] if lows[1:] else [], "n_tokens long, bucket int, bound long, per_batch long"))
    shards = max(1, -(-sum(histogram.values()) // SHARD_ROWS))
    dealt = pieces.join(table, "n_tokens", "left").withColumn("shard", F.pmod(F.xxhash64("shard_hash", "row"), F.lit(shards)))
    sizes = dealt.where("bucket IS NOT NULL").groupBy("bucket", "shard").agg(F.count("*").alias("n"))  # buckets x shards rows
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("shard_hash", "piece", "doc_id", "row")) - 1
    placed = dealt.withColumn("place", place).join(offsets, ["bucket", "shard"], "left").withColumn("at", F.col("offset") + F.col("place"))
    return placed.select("doc_id", "piece", "start", "n_tokens", "bucket", "bound", F.floor(F.col("at") / F.col("per_batch")).alias("batch"), (F.col("at") % F.col("per_batch")).alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding"))
