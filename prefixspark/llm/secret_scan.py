"""Secret scan: fixed patterns, and a randomness battery over long unbroken strings.

A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_-]``. Its encoding is the smallest known
alphabet that holds it. The null hypothesis is "like this corpus's own text": how often two symbols are equal, how often
neighbours change side of the alphabet's median, and how they correlate, are counted over the adjacent characters of all texts,
by encoding (``fitted``); general values count as PRIOR_PAIRS pairs, so that a small corpus has a null too. Three one-sided tests
look for the opposite:

* chi-squared uniformity, through the number of equal symbol pairs (a linear function of the statistic),
* the number of runs above and below the median symbol,
* the lag-1 serial correlation of symbol numbers.

Stouffer's sum joins the three. Over all candidates of the corpus a weighted Benjamini-Hochberg step (weights by
length: long strings can be told apart, short ones can't) keeps the share of false discoveries at ``fdr``. It
needs only a histogram of binned p-values, which has a fixed number of bins; p-values are rounded up to their bin.

Letters alone are held against glued words: symbols are numbered by how frequent they are in text, the shares are
those of glued words and CamelCase, and the sum's spread grows with length as theirs does (at 20 to 200 letters about one
glued string in a thousand, or fewer, has p < 0.001). A random string of 20 has p near 0.1, of 64 below 0.001. Digits alone need
no test: from 24 on the hex pattern reports them, and 20 to 23 are as uniform as other numbers. They do not count as tested.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

KINDS = ("assign", "access", "hex", "random")
# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_OFTEN = "etaoinshrdlucmfwypgbvkxjqz"
#: name, symbols in order, how many times likelier than in a uniform source two symbols of text are equal; None
#: for digits alone
ENCODINGS = (
    ("decimal", _DIG, None),
    ("hex", _DIG + "abcdef", 1.5),
    ("hex_upper", _DIG + "ABCDEF", 1.5),
    ("lower", _OFTEN, 1.65),
    ("upper", _OFTEN.upper(), 1.65),
    ("base32", _UP + "234567", 1.8),
    ("base36", _DIG + _LOW, 2.0),
    ("letters", "".join(c + c.upper() for c in _OFTEN), 2.6),
    ("base62", _DIG + _UP + _LOW, 3.0),
    ("base64", _UP + _LOW + _DIG + "+/", 3.0),
    ("base64url", _UP + _LOW + _DIG + "-_", 3.0),
    ("mixed", _UP + _LOW + _DIG + "+/-_", 3.0),
)
_INDEX = [(name, {c: i for i, c in enumerate(symbols)}, factor) for name, symbols, factor in ENCODINGS]
SWITCH, CORRELATION = 0.35, 0.25
#: Share of switches and correlation of glued words, by frequency of letters.
GLUED = {"lower": (0.34, -0.12), "upper": (0.34, -0.12), "letters": (0.36, -0.12)}
#: The general null counts as so many pairs of adjacent characters of an encoding.
PRIOR_PAIRS = 2_000
#: The variance of the sum is 1 + length / SPREAD for letters alone, whose symbols are far from independent.
SPREAD = 55
#: p-values are binned by their base-10 logarithm in hundredths, down to this many decades
DECADES = 40


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def general_null(name: str) -> tuple[float, float, float] | None:
    """(share of equal symbol pairs, share of switches, correlation) of text where nothing is known of the corpus; None: no test."""
    _, index, factor = next(e for e in _INDEX if e[0] == name)
    return None if factor is None else (factor / len(index), *GLUED.get(name, (SWITCH, CORRELATION)))


GENERAL = {name: general_null(name) for name, *_ in ENCODINGS}
_SYMBOLS = _UP + _LOW + _DIG + "+/-_"
_CODE = np.full(256, len(_SYMBOLS), np.int64)
_CODE[list(_SYMBOLS.encode())] = np.arange(len(_SYMBOLS))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent characters, both of a candidate's alphabet, over whole texts."""
    a = len(_SYMBOLS) + 1
    total = np.zeros(a * a, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            raw = text.encode()
            for i in range(0, len(raw), 1 << 20):
                code = _CODE[np.frombuffer(raw, np.uint8)[i : i + (1 << 20) + 1]]
                total += np.bincount(code[:-1] * a + code[1:], minlength=a * a)
    at = np.flatnonzero(total)
    at = at[(at // a < a - 1) & (at % a < a - 1)]
    yield pa.RecordBatch.from_arrays([pa.array(at // a, pa.int64()), pa.array(at % a, pa.int64()), pa.array(total[at], pa.int64())], names=["x", "y", "n"])


def fitted(counts: np.ndarray) -> dict[str, tuple[float, float, float] | None]:
    """Each encoding's null from ``counts`` of adjacent symbols (by _SYMBOLS). Upper case is read as lower case is, too: glued
    words are written either way."""
    out: dict[str, tuple[float, float, float] | None] = {}
    low = counts.copy().astype(float)
    low[26:52, 26:52] += counts[:26, :26]
    for name, symbols, factor in ENCODINGS:
        if factor is None:
            out[name] = None
            continue
        source = symbols.lower() if name == "upper" else symbols
        of, table = [_SYMBOLS.index(c) for c in source], low if name in ("lower", "upper") else counts
        pair = table[np.ix_(of, of)].astype(float)
        n, a = pair.sum(), len(of)
        prior = GENERAL[name]
        if not n:
            out[name] = prior
            continue
        first, second, i = pair.sum(1) / n, pair.sum(0) / n, np.arange(a)
        side = 2 * i >= a
        mean = (first @ i + second @ i) / 2
        var = (first @ (i - mean) ** 2 + second @ (i - mean) ** 2) / 2
        seen = (float((first**2).sum()), float(pair[side[:, None] != side[None]].sum() / n), float((i - mean) @ pair @ (i - mean) / n / var) if var else prior[2])
        mixed = [(n * s + PRIOR_PAIRS * p) / (n + PRIOR_PAIRS) for s, p in zip(seen, prior, strict=True)]
        # no share may be 0 or 1, nor a correlation 1
        out[name] = (max(mixed[0], 1 / a), min(max(mixed[1], 0.02), 0.98), min(max(mixed[2], -0.95), 0.95))
    return out


def fit_null(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[float, float, float] | None]:
    """The nulls of all encodings, from all texts: at most 66 x 66 sums come to the driver."""
    rows = docs.select(text_of(text_col)).mapInArrow(_pairs, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(_SYMBOLS), len(_SYMBOLS)))
    for r in rows:
        counts[r["x"], r["y"]] = r["n"]
    return fitted(counts)


def infer_encoding(s: str) -> tuple[str, dict[str, int], float | None]:
    """The smallest alphabet that holds the candidate ``s``."""
    symbols = set(s)
    return next(e for e in _INDEX if symbols <= e[1].keys())


def battery(s: str, nulls: dict = GENERAL) -> tuple[str, float]:
    """(encoding, p-value of "text-like"). Strings of one symbol, or of digits alone, have p = 1."""
    name, index, _ = infer_encoding(s)
    if nulls[name] is None or len(set(s)) < 2:
        return name, 1.0
    kappa, switch, correlation = nulls[name]
    x, n, a = [index[c] for c in s], len(s), len(index)
    counts: dict[int, int] = {}
    for i in x:
        counts[i] = counts.get(i, 0) + 1
    pairs, equal = n * (n - 1) / 2, sum(c * (c - 1) / 2 for c in counts.values())
    z_uniform = (equal + 0.5 - pairs * kappa) / math.sqrt(pairs * kappa * (1 - kappa))
    side = [2 * i >= a for i in x]
    switches = sum(p != q for p, q in zip(side, side[1:], strict=False))
    # each test looks from the null's value towards a random string's, and is left out where the two are as good as equal
    side_of = math.copysign(1, switch - 0.5)
    z_runs = side_of * (switches + 0.5 * side_of - (n - 1) * switch) / math.sqrt((n - 1) * switch * (1 - switch))
    mean = sum(x) / n
    var = sum((i - mean) ** 2 for i in x)
    r = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / var
    z_serial = math.copysign(1, correlation) * (math.atanh(min(max(r, -0.999), 0.999)) - math.atanh(correlation)) * math.sqrt(n - 4)
    told = [z for z, on in ((z_uniform, kappa * a > 1.05), (z_runs, abs(switch - 0.5) > 0.02), (z_serial, abs(correlation) > 0.02)) if on]
    if not told:
        return name, 1.0
    spread = math.sqrt(1 + n / SPREAD) if name in GLUED else 1.0
    return name, max(_phi(sum(told) / math.sqrt(len(told)) / spread), 10.0**-DECADES)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; positions are code points, ends exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def length_weight(n: int) -> float:
    return min(n, 64) / 32


def p_bin(p: float, n: int) -> int:
    """The bin of a length-weighted p-value, in hundredths of a decade, rounded up to the larger p."""
    return max(-DECADES * 100, math.ceil(100 * math.log10(p / length_weight(n))))


def candidates(text: str, base: list[tuple[int, int, int]], nulls: dict = GENERAL) -> list[dict]:
    """Candidates that no base span holds. ``base`` ascends, so one sweep will do."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] <= a:
            reach = max(reach, base[i][2])
            i += 1
        if b > reach:
            encoding, p = battery(m.group(), nulls)
            weight = length_weight(b - a) if encoding != "decimal" else 0.0
            out.append({"start": a, "end": b, "encoding": encoding, "p": p, "bin": p_bin(p, b - a), "weight": weight})
    return out


def bh_cut(bins: dict[int, int], mean_weight: float, fdr: float) -> int | None:
    """The largest bin that the step-up procedure rejects, from the counts by bin."""
    m, seen, cut = sum(bins.values()), 0, None
    for b in sorted(bins):
        seen += bins[b]
        if 10 ** (b / 100) * mean_weight <= fdr * seen / m:
            cut = b
    return cut


_SPAN = "struct<start:long,kind:int,end:long>"
_SCAN = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<{_SPAN}>, found array<struct<start:long,end:long,encoding:string,p:double,bin:int,weight:double>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string())]
    + [("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])))]
    + [("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("p", pa.float64()), ("bin", pa.int32()), ("weight", pa.float64())])))]
)


def _scan(nulls: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append({"doc_id": doc_id, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(spans_text(base).encode()).hexdigest(), "base": [{"start": a, "kind": k, "end": b} for a, k, b in base], "found": candidates(text, base, nulls)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, least_p.

    Null and empty texts have no spans. Very long texts are scanned whole, in time linear in their length. Rows that repeat are
    scanned each for itself, and their strings count each; strings that tie for the last p-value are all reported or none. An
    empty table gives an empty table. Other columns of ``docs`` are not read, so their names may clash with anything.
    """
    nulls = fit_null(docs, text_col)
    scanned = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_scan(nulls), _SCAN), "secret-scan")
    each = scanned.select(F.explode("found").alias("c"))
    counts = each.where("c.weight > 0").groupBy(F.col("c.bin").alias("bin")).agg(F.count("*").alias("n"), F.sum("c.weight").alias("w")).collect()
    total = sum(r["n"] for r in counts)
    cut = bh_cut({r["bin"]: r["n"] for r in counts}, sum(r["w"] for r in counts) / total, fdr) if total else None
    kept = F.filter("found", lambda c: (c["bin"] <= F.lit(cut)) & (c["weight"] > 0)) if cut is not None else F.slice("found", 1, 0)
    hits = scanned.withColumn("hits", kept)
    random = F.transform("hits", lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.sort_array(F.concat("base", random)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return hits.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size("hits").cast("long").alias("n_random"), F.array_min(F.transform("hits", lambda c: c["p"])).alias("least_p"))
