"""Quality rules by host: rule failures are summed by host, the rates shrunk with an empirical beta prior, and the
host's verdict goes back to its documents.

A document fails its own base rules if it has under 10 words, or if words in repeated 5-word windows exceed a fifth
of its words. Its soft rules are: symbols above a tenth of its word characters, and repeated lines above three
tenths of its lines with words. A host is bad if the lower bound of its shrunken failure rate exceeds
``host_limit``. From a bad host a document stays only if it fails no rule; from any other host it stays unless it
fails a base rule. So a document that fails nothing always stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, text_of

# Rule limits and the symbol characters.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SYMBOL_PERCENT, LINE_PERCENT = 10, 30
SALTS = 64


def features(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of one whole text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_repeat = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    n_repeat += i + WINDOW - max(covered, i)
                    covered = i + WINDOW
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), n_repeat


_FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*map(features, batch.column(2).to_pylist()), strict=True)) or [()] * len(_FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "host", *_FEATURES])


def host_of(column: Column) -> Column:
    """The domain of a URL, in lower case and without a leading "www."; anything else is a host as it stands."""
    domain = F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(domain != "", F.regexp_replace(domain, r"^www\.", "")).otherwise(column)


def host_rates(measured: DataFrame, prior_docs: float = 20.0, host_limit: float = 0.5, z: float = 1.64) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunken), lower, bad. The prior's mean and weight come from the hosts' own rates by
    moments; where they don't vary more than chance, the weight is ``prior_docs``."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_pop(raw).alias("var"), F.avg(1 / F.col("n_docs")).alias("noise"))
    spread = F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("noise")
    weight = F.when(spread > 1e-9, F.greatest(F.col("mean") * (1 - F.col("mean")) / spread - 1, F.lit(1.0))).otherwise(F.lit(prior_docs))
    prior = prior.select("mean", weight.alias("weight"))  # one row
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    out = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", rate)
    out = out.withColumn("lower", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.col("weight") + 1)))
    return out.withColumn("bad", F.col("lower") > host_limit).drop("mean", "weight")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, host, the counts, base_failed, soft_failed, host_rate, host_bad, kept.

    ``host_col`` may hold URLs: their domain is the host. Null texts count as empty (and fail), a null host is a host of its own.
    Very long texts are measured whole. Rows that repeat count each. A limit that is just met is not exceeded. An empty table
    gives an empty table. Other columns are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), host_of(F.col(host_col).cast("string")).alias("host"), text_of(text_col).alias("text"))
    measured = picked.mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _FEATURES))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"))
    measured = measured.withColumn("base_failed", base).withColumn("soft_failed", soft).withColumn("failed", base | soft)
    measured = materialise(measured, "quality")
    hosts = host_rates(measured, host_limit=host_limit).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), F.col("bad").alias("host_bad"))
    hosts = materialise(hosts, "quality-hosts")
    if hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(hosts), F.col("host").eqNullSafe(F.col("h")), "left")
    else:  # a hot host's documents go to SALTS partitions
        left = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        right = hosts.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = left.join(right, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left").drop("salt", "s")
    kept = ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed"))
    return joined.withColumn("kept", kept).drop("h", "failed")
