"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to blocks in order of their population count. Two blocks are compared only if some
of their counts differ by no more than the radius; within a pair of blocks, each tile of rows meets only the range
of counts within the radius, by exclusive-or and bit counts in numpy. A task returns a spanning forest of the
links it finds, never the links of a group one by one, so a group of n fingerprints costs n rows. Groups are then
joined across tasks by large-star and small-star rounds, each written to the shared folder.

``near_duplicates`` links fingerprints alone. ``similar_groups`` links texts by the exact similarity of their shingle
sets. Two similar sets share one of their first shingles in any common order, so only texts that do compare their wide
fingerprints, which gives candidate groups; within a group the members meet a hub, and those that don't link with it all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_scratch, materialise, scratch_mark, text_of

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# The hash's seed and the fingerprint's width.
SEED, BITS = 42, 64
#: Blocks at least, and fingerprints in a block at most unless that makes more blocks.
BLOCKS, BLOCK_ROWS = 12, 200_000
TILE = 512
#: Partitions of the comparison at most; each then has several jobs.
MOST_PARTITIONS = 20_000
#: Texts of a candidate group that meet in one verification job, from each side.
VERIFY_ROWS = 256
#: Texts of one first shingle that are paired where they are found; more meet in jobs of LIST_ROWS from each side.
PAIRED, LIST_ROWS = 16, 4096
#: Frequent shingles come last in the order: of those found FREQUENT times in one of ORDER_SHARE texts, at most MOST_FREQUENT.
ORDER_SHARE, FREQUENT, MOST_FREQUENT = 64, 3, 200_000


def bit_majority(h: np.ndarray, step: int = 1 << 16) -> int:
    """The number whose bits are set in over half of ``h`` (uint64)."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), step):
        part = np.ascontiguousarray(h[i : i + step])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 4) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return bit_majority(np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], np.uint64))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return run


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes over links a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def block_links(left: np.ndarray, right: np.ndarray | None, radius: int, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of row numbers (the right side's after the left's), of all links within ``left`` (``right``
    None) or between the two. Fingerprints are rows of 64-bit words."""
    pops = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
    order = np.argsort(pops(left), kind="stable")
    rows = left[order]
    if right is None:
        columns, names, shift = rows, order, 0
    else:
        order_right = np.argsort(pops(right), kind="stable")
        columns, names, shift = right[order_right], np.concatenate([order, order_right + len(left)]), len(left)
    counts, held, size = pops(columns), [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        label = components(len(names), np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        i = np.flatnonzero(label != np.arange(len(names)))
        return i, label[i]

    words, others = np.ascontiguousarray(rows.T), np.ascontiguousarray(columns.T)
    kind = np.uint8 if BITS * len(words) < 256 else np.uint16
    xor, bits, sums = (np.empty((TILE, 8 * TILE), t) for t in (np.uint64, np.uint8, kind))
    for i in range(0, len(rows), TILE):
        pop = pops(rows[[i, min(i + TILE, len(rows)) - 1]])
        lo, hi = int(np.searchsorted(counts, pop[0] - radius, "left")), int(np.searchsorted(counts, pop[1] + radius, "right"))
        if right is None:
            lo = max(lo, i)
        for j in range(lo, hi, 8 * TILE):
            a, b = words[:, i : i + TILE], others[:, j : min(hi, j + 8 * TILE)]
            cut = np.s_[: a.shape[1], : b.shape[1]]
            for w in range(len(words)):
                np.bitwise_xor(a[w][:, None], b[w][None], out=xor[cut])
                np.bitwise_count(xor[cut], out=bits[cut])
                np.add(sums[cut], bits[cut], out=sums[cut]) if w else np.copyto(sums[cut], bits[cut])
            x, y = np.nonzero(sums[cut] <= radius)
            on = x + i != y + j if right is None else slice(None)
            if len(x[on]):
                held.append((x[on] + i, y[on] + j + shift))
                size += len(held[-1][0])
            if size > most:
                held = [reduced()]
                size = len(held[0][0])
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, label = reduced()
    return names[i], names[label]


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the least node of its component, as signed longs."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialise(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def link_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """Forest edges (u, v), as nodes, of all links among the fingerprints of ``fps`` (node long, words array<long>)."""
    spark = fps.sparkSession
    pop = F.aggregate("words", F.lit(0), lambda s, w: s + F.bit_count(w))
    fps = fps.select("node", "words", pop.alias("p"))
    sizes = {r["p"]: r["n"] for r in fps.groupBy("p").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    rows = max(1, min(-(-total // BLOCKS), BLOCK_ROWS))
    # a count's fingerprints, cut by hash into parts of about `rows`; parts fill blocks in order
    parts, blocks, room = {p: -(-n // rows) for p, n in sizes.items()}, [], 0
    for p in sorted(sizes):
        for k in range(parts[p]):
            n = sizes[p] / parts[p]
            if not blocks or room < n * 0.5:
                blocks.append([])
                room = rows
            blocks[-1].append((p, k))
            room -= n
    of = [(p, k, b) for b, members in enumerate(blocks) for p, k in members]
    lo, hi = (np.array([f(m)[0] for m in blocks], np.int64) for f in (min, max))
    n_jobs = int(np.triu(lo[None, :] - hi[:, None] <= radius).sum())
    # the pairs of blocks are made where they are needed, not on the driver
    n = max(1, len(blocks))
    at = lambda values, i: F.get(F.lit(values), i) if values else F.lit(0)
    pairs = spark.range(len(blocks) ** 2).select(F.col("id").alias("job"), F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    pairs = pairs.where((F.col("i") <= F.col("j")) & (at(lo.tolist(), F.col("j")) - at(hi.tolist(), F.col("i")) <= radius))
    goes = pairs.select("job", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("b"))
    goes = goes.select("b", "job", (F.col("b") == F.col("j")).alias("right_side"), (F.col("i") == F.col("j")).alias("own"))
    deal = spark.createDataFrame(of, "p int, k int, b int")
    deal = F.broadcast(deal) if len(of) <= BROADCAST_ROWS else deal
    cuts = F.broadcast(spark.createDataFrame([(p, k) for p, k in parts.items()], "p int, cuts int"))
    dealt = fps.join(cuts, "p").withColumn("k", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).join(deal, ["p", "k"])
    sent = dealt.join(F.broadcast(goes) if 2 * n_jobs <= BROADCAST_ROWS else goes, "b").select("job", "node", "words", "right_side", "own")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        node, fp, side = pdf["node"].to_numpy(np.int64), np.stack(pdf["words"]).astype(np.int64).view(np.uint64), pdf["right_side"].to_numpy(bool)
        if not pdf["own"].iloc[0]:
            node = np.concatenate([node[~side], node[side]])
        u, v = block_links(fp, None, radius) if pdf["own"].iloc[0] else block_links(fp[~side], fp[side], radius)
        return pd.DataFrame({"u": node[u], "v": node[v]})

    # a job is little data and much work: partitions by number are not coalesced
    return sent.repartition(max(1, min(n_jobs, MOST_PARTITIONS)), "job").groupBy("job").applyInPandas(compare, "u long, v long")


def shingle_set(text: str, shingle: int) -> tuple[bytes, np.ndarray]:
    """(the words, joined, and the hashes of its different shingles, sorted). Fewer words than a shingle are one."""
    words = text.encode().translate(_LOWER).split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    return b" ".join(words), np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], np.uint64))


def wide_fingerprint(h: np.ndarray, words: int) -> list[int]:
    """SimHash of ``words`` times 64 bits: each further word is that of the hashes mixed anew."""
    out = []
    for _ in range(words):
        out.append(bit_majority(h))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return out


def first_shingles(h: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first of the sorted hashes ``h``, ``frequent`` (sorted) ones last: as many that two sets of the similarity share one of
    them. Such sets share ``similarity`` times the larger's size, so less than that many of a set's hashes follow its first."""
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1
    if not len(h) or not len(frequent):
        return h[:n] if len(h) else h
    late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    return np.concatenate([h[~late], h[late]])[:n]


def frequent_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that many of ``texts`` (text, t) have, sorted, from a share of the texts. They set an order and so the
    length of lists; what is found doesn't depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle)[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64), pa.int64())], names=["h"])

    some = texts.where(F.pmod("t", F.lit(ORDER_SHARE)) == 0).dropDuplicates(["t"]).select("text")
    counted = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def _mark(shingle: int, words: int, similarity: float, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of a task's equal texts one has first shingles
        for batch in batches:
            keys, fps, first = [], [], []
            for text in batch.column(1).to_pylist():
                joined, h = shingle_set(text, shingle)
                keys.append(xxhash.xxh3_64_intdigest(joined) - (1 << 63))
                fps.append(np.array(wide_fingerprint(h, words), np.uint64).view(np.int64))
                first.append(first_shingles(h[: 0 if keys[-1] in seen else None], similarity, frequent.value).view(np.int64))
                seen.add(keys[-1])
            columns = [pa.array(keys, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "t", "node", "words", "first"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, node): the pairs (u, v) of up to ``PAIRED`` nodes of one h, or (h, u) for each node of a longer list."""

    def found(h: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node = h[new], node[new]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, int)
        size = np.diff(np.append(starts, len(h)))
        of = np.repeat(size, size)
        short = of <= PAIRED
        at = [np.flatnonzero((h[:-d] == h[d:]) & short[:-d]) for d in range(1, min(PAIRED, len(h)))]
        pairs = np.unique(np.concatenate([np.stack([node[i], node[i + d]], 1) for d, i in enumerate(at, 1)] or [np.empty((0, 2), np.int64)]), axis=0)
        n, long = len(pairs), ~short
        none = np.concatenate([np.ones(n, bool), np.zeros(long.sum(), bool)])
        columns = np.concatenate([np.zeros(n, np.int64), h[long]]), np.concatenate([pairs[:, 0], node[long]]), np.concatenate([pairs[:, 1], node[long]])
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64(), mask=none), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64(), mask=~none)], names=["h", "u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(held[-1][0])
        if size >= 1 << 19:
            h, node = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(h, h[-1]))  # the last list may go on
            if cut:
                yield found(h[:cut], node[:cut])
            held = [(h[cut:], node[cut:])]
            size = 0 if not cut else len(h) - cut
    if held:
        yield found(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _list_links(radius: int):
    """Rows sorted by job (h, a, b) and side: links between side 0 and side 1, or among side 0 where a is b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links() -> pa.RecordBatch:
            side, node, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            right = side == 1
            fp = fp.view(np.uint64)
            u, v = block_links(fp[~right], fp[right] if right.any() else None, radius) if job[1] == job[2] or right.any() and not right.all() else (np.empty(0, int),) * 2
            return pa.RecordBatch.from_arrays([pa.array(node[u], pa.int64()), pa.array(node[v], pa.int64())], names=["u", "v"])

        job = None
        for batch in batches:
            h, a, b, side, node = (batch.column(c).to_numpy() for c in range(5))
            fp = np.stack([x.values.to_numpy() for x in batch.column(5)]) if len(h) else np.empty((0, 1), np.int64)
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(h) else []
            for i, j in zip(new, [*new[1:], len(h)], strict=True):
                if held and job != (h[i], a[i], b[i]):
                    yield links()
                    held = []
                job = (h[i], a[i], b[i])
                held.append((side[i:j], node[i:j], fp[i:j]))
        if held:
            yield links()

    return run


def first_links(first: DataFrame, fps: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that join all nodes of ``fps`` (node, words) that share a first shingle in ``first`` (h, node; rows may repeat)
    and whose fingerprints are within the radius.

    Short lists give pairs. The nodes of a longer one meet in jobs of two parts of bounded size, which return forests.
    """
    lists = materialise(first.repartition("h").sortWithinPartitions("h", "node").mapInArrow(_lists, "h long, u long, v long"), "similar-lists")
    pairs = lists.where("h IS NULL").select("u", "v").distinct()
    of = lambda side: fps.select(F.col("node").alias(side), F.col("words").alias(f"{side}_words"))
    differ = F.aggregate(F.zip_with("u_words", "v_words", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    near = pairs.join(of("u"), "u").join(of("v"), "v").where(differ <= radius).select("u", "v")
    long = lists.where("h IS NOT NULL").select("h", F.col("u").alias("node"))
    sizes = long.groupBy("h").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = long.join(sizes, "h").withColumn("part", part).join(fps, "node")
    other = dealt.select("h", "part", "node", "words", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    jobs = other.select("h", F.least("part", "o").alias("a"), F.greatest("part", "o").alias("b"), (F.col("part") > F.col("o")).cast("int").alias("side"), "node", "words")
    jobs = jobs.repartition("h", "a", "b").sortWithinPartitions("h", "a", "b", "side")
    return near.unionByName(jobs.mapInArrow(_list_links(radius), "u long, v long"))


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle)[1].view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["node", "label", "shingles"])

    return run


def set_links(sets: list[np.ndarray], n_left: int, similarity: float, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets (left of ``n_left`` with right, or all if it is 0) of the similarity or more, by
    products of incidence rows over the shingles that two sets have."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    common = np.flatnonzero(np.bincount(column, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    row, column = row[place[column] >= 0], place[column][place[column] >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for i in range(0, len(common), step):
        a, b = np.searchsorted(column, [i, i + step])
        m = np.zeros((n, min(step, len(common) - i)), np.float32)
        m[row[a:b], column[a:b] - i] = 1
        shared += m @ m.T
    x, y = np.nonzero(shared >= similarity * (size[:, None] + size[None] - shared) - 1e-3)
    on = (x < n_left) & (y >= n_left) if n_left else x > y
    label = components(n, x[on], y[on])
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def _shingles_at(column: pa.Array, i: int) -> np.ndarray:
    return np.array(column[i].values.to_numpy(), np.int64)


def _hub_links(similarity: float):
    """Rows sorted by (label, part), each part's hub first: links of the part's members with the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = hub = None
        for batch in batches:
            u, v = [], []
            for i, (label, part, member, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                x = _shingles_at(batch.column(4), i)
                if not member:
                    at, hub = (label, part), (node, x)
                elif at == (label, part):
                    shared = len(np.intersect1d(hub[1], x, assume_unique=True))
                    if shared >= similarity * (len(hub[1]) + len(x) - shared) - 1e-9:
                        u.append(node)
                        v.append(hub[0])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _job_links(similarity: float):
    """Rows sorted by job (label, a, b) and side: links between side 0 and side 1, or among side 0 where there is no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray]] = []
        last = None

        def links() -> pa.RecordBatch:
            n_left = sum(side == 0 for side, *_ in rows)
            none = (np.empty(0, int),) * 2
            i, j = set_links([r[2] for r in rows], n_left if n_left < len(rows) else 0, similarity) if len(rows) > 1 and n_left else none
            node = np.array([r[1] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[i], pa.int64()), pa.array(node[j], pa.int64())], names=["u", "v"])

        for batch in batches:
            for i, (label, a, b, side, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if (label, a, b) != last and rows:
                    yield links()
                    rows = []
                last = (label, a, b)
                rows.append((side, node, _shingles_at(batch.column(5), i)))
        if rows:
            yield links()

    return run


def verified_links(texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Forest edges (u, v) that join all pairs of one label in ``texts`` (node, label, text; each node once) of the similarity or
    more.

    A group that fits a job is compared whole. In a larger one every member first meets the hub, its least node; those that link
    with it are joined already. The rest, few in groups of copies, meet all members, in jobs of two parts: n + rest * n pairs.
    """
    sets = materialise(texts.select("node", "label", "text").mapInArrow(_sets(shingle), "node long, label long, shingles array<long>"), "similar-sets")
    large = sets.groupBy("label").agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("parts"), F.min("node").alias("hub")).where("parts > 1")
    large = materialise(large, "similar-large")
    large = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = sets.join(large, "label")
    others = members.where("node <> hub").select("label", part("parts").alias("part"), F.lit(True).alias("member"), "node", "shingles")
    hubs = members.where("node = hub").select("label", every("parts").alias("part"), F.lit(False).alias("member"), "node", "shingles")
    met = others.unionByName(hubs).repartition("label", "part").sortWithinPartitions("label", "part", "member")
    linked = materialise(met.mapInArrow(_hub_links(similarity), "u long, v long"), "similar-linked")
    rest = members.where("node <> hub").join(linked, F.col("node") == F.col("u"), "left_anti")
    crowds = materialise(rest.groupBy("label").agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("blocks")), "similar-rest")
    crowds = F.broadcast(crowds) if crowds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else crowds
    left = rest.join(crowds, "label").select("label", part("blocks").alias("a"), every("parts").alias("b"), F.lit(0).alias("side"), "node", "shingles")
    right = members.join(crowds, "label").select("label", every("blocks").alias("a"), part("parts").alias("b"), F.lit(1).alias("side"), "node", "shingles")
    small = sets.join(large, "label", "left_anti").select("label", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "node", "shingles")
    jobs = small.unionByName(left).unionByName(right).repartition("label", "a", "b").sortWithinPartitions("label", "a", "b", "side")
    return linked.unionByName(jobs.mapInArrow(_job_links(similarity), "u long, v long"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 3, radius: int = 45) -> DataFrame:
    """One row per input row: doc_id, component_id (the least doc_id that links reach). Texts link if their sets of shingles have
    a Jaccard similarity of ``similarity`` or more.

    Candidates share one of their first shingles (which all similar texts do) and have fingerprints of ``words`` times 64 bits
    within ``radius``. At 0.8 two texts differ in 29 of 192 bits, 5 more or less, so 45 misses one in two thousand at the very
    bound; unrelated texts differ in 96, 7 more or less. Texts without words (null, empty) are equal, and so one group. Very long
    texts are compared whole. Rows that repeat are one group. Null ids never name a group: one of null ids alone has a null id.
    An empty table gives an empty table. Other columns are not read.
    """
    text, since = text_of(text_col), scratch_mark()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(picked, shingle))
    mark = _mark(shingle, words, similarity, frequent)
    marked = materialise(picked.mapInArrow(mark, "doc_id long, t long, node long, words array<long>, first array<long>"), "similar")
    distinct = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("words").alias("words")), "similar-distinct")
    first = marked.select(F.explode("first").alias("h"), "node")
    near = star_components(first_links(first, distinct.select("node", "words"), radius))
    wanted = materialise(distinct.join(near, "node").select("node", "label", "least"), "similar-candidates")
    # the text of each node's least id
    w = wanted.select(F.col("node").alias("w_node"), "label", "least")
    at = marked.join(w, (F.col("node") == F.col("w_node")) & F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("node", "label", "least").agg(F.min("t").alias("at_t"))
    texts = picked.join(at, (F.col("t") == F.col("at_t")) & F.col("doc_id").eqNullSafe(F.col("least")))
    texts = materialise(texts.dropDuplicates(["node"]).select("node", "label", "text"), "similar-texts")
    labels = star_components(verified_links(texts, similarity, shingle)).withColumnRenamed("label", "group")
    named = distinct.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("group", "node").alias("group"))
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of = materialise(named.join(names, "group").select("node", "component_id"), "similar-groups")
    drop_scratch(docs.sparkSession, since, keep=("similar", "similar-groups"))
    return marked.join(of, "node").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id (the least doc_id that links reach).

    Texts without words (null, empty) have the fingerprint zero and link like any other. Very long texts are hashed whole; a bit
    that just half of the hashes have is 0. Rows that repeat share a fingerprint, and so a component. Null ids never name a
    component; one of null ids alone has a null id. An empty table gives an empty table. Other columns are not read.
    """
    since = scratch_mark()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    marked = materialise(picked.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = star_components(link_fingerprints(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("words")), radius))
    grouped = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    names = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialise(grouped.join(names, "label").select("fp", "component_id"), "simhash-groups")
    drop_scratch(docs.sparkSession, since, keep=("simhash", "simhash-groups"))
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
