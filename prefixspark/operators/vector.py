"""Vectors: exact search, k-means, product quantization, and an inverted file of quantized residuals.

Models (centroids, codebooks) are small by construction, k or 256 rows a sub-space, and go to the executors as broadcasts;
vectors stay distributed. Ties go to the lowest index everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter, VectorDimensionMismatch, require
from ..functions.distance import closest, distances, l2_sq, matrix
from ..functions.rng import Xorshift64Star
from .running import sum_before

# Codes in a sub-space, and the rounds of training.
CODES, TRAIN_ROUNDS = 256, 24
#: Queries that are sent to all vectors at once or meet a part of a list in one task, and postings that one task scans.
QUERY_BLOCK, POSTING_ROWS = 4096, 500_000
#: Tasks whose partial sums the driver adds up itself; those of more are first summed by key.
DIRECT_TASKS = 64


def _top(query_ids: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ids of each query, by (distance, id)."""
    if 0 < k and 4 * k < len(ids) and not np.isnan(d).any():
        q, i = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        order = np.lexsort((ids[i], d[q, i], q))
        q, i = q[order], i[order]
        on = np.arange(len(q)) - np.searchsorted(q, q) < k
        return query_ids[q[on]], ids[i[on]], d[q[on], i[on]]
    order = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :k] if len(ids) else np.empty((len(query_ids), 0), int)
    return np.repeat(query_ids, order.shape[1]), ids[order].ravel(), np.take_along_axis(d, order, 1).ravel()


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """``queries`` in blocks of about ``QUERY_BLOCK`` rows, by a hash of query_id; no queries, no blocks."""
    n = -(-queries.count() // QUERY_BLOCK)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def distance_pairs(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 4) -> DataFrame:
    """(query_id, id, distance) of each query (query_id, vec) and each vector. One block of queries is broadcast at a time, so that
    no broadcast grows with the table."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("x"))
    out = vectors.sparkSession.createDataFrame([], "query_id BIGINT, id BIGINT, distance DOUBLE")
    for block in query_blocks(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "vec")):
        out = out.unionByName(rows.crossJoin(F.broadcast(block)).select("query_id", "id", F.round(l2_sq(F.col("vec"), F.col("x")), digits).alias("distance")))
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest vectors of each query (query_id, vec). Queries go out in blocks by a hash of their
    id, of which the driver holds one at a time; each task keeps k of its own, so k rows a task and query are shuffled."""
    require(k >= 0, "k must not be negative")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "vec")
    spark, schema = vectors.sparkSession, "query_id BIGINT, id BIGINT, distance DOUBLE"
    out, blocks = spark.createDataFrame([], schema), query_blocks(asked)
    for some in blocks:
        block = some.collect()
        if not block:
            continue
        qs = spark.sparkContext.broadcast((np.array([r["query_id"] for r in block]), np.array([r["vec"] for r in block], float)))

        def run(batches: Iterator[pa.RecordBatch], qs=qs) -> Iterator[pa.RecordBatch]:
            q_ids, points = qs.value
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), points.shape[1])
                d = distances(points, x)
                if digits is not None:
                    d = np.round(d, digits)
                columns = _top(q_ids, ids, d, k)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "distance"])

        found = vectors.select(F.col(id_col).cast("bigint"), vec_col).mapInArrow(run, schema)
        out = found if len(blocks) == 1 else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest(vectors: DataFrame, points: np.ndarray, vec_col: str = "embedding", centroid: str = "centroid") -> DataFrame:
    """``vectors`` with the nearest point's index and its squared distance."""
    sent = vectors.sparkSession.sparkContext.broadcast(np.asarray(points, float))
    schema = vectors.schema.simpleString().removeprefix("struct<").removesuffix(">") + f",{centroid}:int,distance:double"
    at = vectors.columns.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column(at), sent.value.shape[1]), sent.value)
            best = d.argmin(1) if len(d) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(d[np.arange(len(d)), best], pa.float64())], names=[*batch.schema.names, centroid, "distance"])

    return vectors.mapInArrow(run, schema)


def with_index(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``index`` from 0 in the order of a column of different numbers, without gathering them: the count of the rows
    before, by ranges of the column. Nothing depends on partitions, so a row that is computed again has its number again."""
    return sum_before(rows, F.lit(1).cast("bigint"), None, order, "index")


def _check(rows: int, dimension: int, k: int, rounds: int) -> None:
    require(k > 0 and dimension > 0 and rounds > 0, "k, dimension and rounds must be positive")
    require(rows >= k, "fewer rows than centroids")


def _rows_at(indexed: DataFrame, wanted: list[int], vec_col: str) -> np.ndarray:
    found = {r["index"]: r[vec_col] for r in indexed.where(F.col("index").isin(sorted(set(wanted)))).select("index", vec_col).collect()}
    return np.array([found[i] for i in wanted], float)


def train_kmeans(indexed: DataFrame, spaces: list[slice], k: int, rounds: int, seeds: list[int], vec_col: str = "vec", start: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Lloyd's k-means in several slices of the vectors at once; ``indexed`` has ``index`` (0 to n - 1).

    Each slice draws k different rows by its seed (or has its points in ``start``), stops when no assignment changes, and draws a row anew for an empty cluster.
    A round is one pass for all slices; tasks send sums by centroid, which are summed by key. Clusters whose sizes changed have other
    rows; only where all sizes are those of the round before a second pass compares the assignments themselves.
    """
    n = indexed.count()
    dimension = len(indexed.select(vec_col).first()[0]) if n else 0
    _check(n, dimension, k, rounds)
    rngs = [Xorshift64Star(s) for s in seeds]
    points = [np.array(p, float) for p in start] if start is not None else [_rows_at(indexed, rng.distinct(k, n), vec_col)[:, s] for rng, s in zip(rngs, spaces, strict=True)]
    before: list[np.ndarray | None] = [None] * len(spaces)
    active = list(range(len(spaces)))
    context = indexed.sparkSession.sparkContext
    tasks = indexed.rdd.getNumPartitions()
    sizes: list[dict[int, int] | None] = [None] * len(spaces)

    def one_pass(work: list[tuple[int, slice, np.ndarray, np.ndarray | None]]) -> tuple[dict[int, dict[int, list]], dict[int, int]]:
        """Counts and sums by slice and centroid, and by slice the rows whose centroid isn't that of the points before (if given)."""
        sent = context.broadcast(work)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                x = matrix(batch.column(0), dimension)
                for i, s, now, was in sent.value:
                    part = x[:, s]
                    a = closest(part, now)
                    changed = len(a) if was is None else int((a != closest(part, was)).sum())
                    count, total, moved = held.setdefault(i, [np.zeros(k), np.zeros(now.shape), 0])
                    count += np.bincount(a, minlength=k)
                    cells = (a[:, None] * now.shape[1] + np.arange(now.shape[1])).ravel()
                    total += np.bincount(cells, part.ravel(), minlength=now.size).reshape(now.shape)
                    held[i][2] = moved + changed
            out = [(i, c, int(count[c]), total[c].tolist(), moved) for i, (count, total, moved) in held.items() for c in np.flatnonzero(count).tolist() or [0]]
            table = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64()), strict=True)], names=["space", "c", "n", "total", "moved"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"space": [pdf["space"].iloc[0]], "c": [pdf["c"].iloc[0]], "n": [pdf["n"].sum()], "total": [np.sum(np.stack(pdf["total"]), axis=0)], "moved": [pdf["moved"].sum()]})

        schema = "space INT, c INT, n BIGINT, total ARRAY<DOUBLE>, moved BIGINT"
        partial = indexed.select(vec_col).mapInArrow(sums, schema)
        got = (partial if tasks <= DIRECT_TASKS else partial.groupBy("space", "c").applyInPandas(add, schema)).collect()
        sent.unpersist()
        by: dict[int, dict[int, list]] = {i: {} for i, *_ in work}
        moved = dict.fromkeys(by, 0)
        for r in got:
            held = by[r["space"]].setdefault(r["c"], [0, 0.0])
            held[0] += r["n"]
            held[1] = held[1] + np.array(r["total"])
            moved[r["space"]] += r["moved"]
        return by, moved

    for _ in range(rounds):
        by, moved = one_pass([(i, spaces[i], points[i], None) for i in active])
        now = {i: {c: n for c, (n, _) in by[i].items() if n} for i in active}
        same = [i for i in active if now[i] == sizes[i]]
        if same:
            moved |= one_pass([(i, spaces[i], points[i], before[i]) for i in same])[1]
        for i in active:
            sizes[i] = now[i]
        anew: list[tuple[int, int, int]] = []
        for i in list(active):
            if not moved[i]:
                active.remove(i)
                continue
            before[i], points[i] = points[i], points[i].copy()
            for c in range(k):
                if c in by[i] and by[i][c][0]:
                    points[i][c] = by[i][c][1] / by[i][c][0]
                else:
                    anew.append((i, c, rngs[i].next_bounded(n)))
        if anew:
            for (i, c, _), row in zip(anew, _rows_at(indexed, [r for *_, r in anew], vec_col), strict=True):
                points[i][c] = row[spaces[i]]
        if not active:
            break
    return points


def sub_spaces(dimension: int, m: int) -> list[slice]:
    require(dimension > 0 and m > 0 and dimension % m == 0, "dimension must be a positive multiple of the sub-vectors")
    w = dimension // m
    return [slice(i * w, (i + 1) * w) for i in range(m)]


def train_codebook(indexed: DataFrame, dimension: int, m: int, rounds: int, seed: int, vec_col: str = "vec") -> np.ndarray:
    """(m, 256, dimension / m): k-means in each sub-space, seeds seed + 1 and up."""
    require(indexed.count() >= CODES, "training set smaller than the codebook size")
    spaces = sub_spaces(dimension, m)
    return np.stack(train_kmeans(indexed, spaces, CODES, rounds, [seed + i + 1 for i in range(m)], vec_col))


def codebook_of(flat: list[float] | np.ndarray, dimension: int, m: int) -> np.ndarray:
    """A codebook from its numbers in the order sub-space, code, component; their count must fit."""
    w = sub_spaces(dimension, m)[0].stop
    require(len(flat) == m * CODES * w, f"{m * CODES * w} numbers make a codebook", VectorDimensionMismatch)
    return np.asarray(flat, float).reshape(m, CODES, w)


def encode(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The nearest code in each sub-space."""
    m, _, w = codebook.shape
    return np.stack([closest(x[:, i * w : (i + 1) * w], codebook[i]) for i in range(m)], axis=1) if len(x) else np.empty((0, m), int)


def lookup_table(q: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(queries, m, codes): squared distances of each query's sub-vectors to all codes."""
    m, _, w = codebook.shape
    return np.stack([distances(q[:, i * w : (i + 1) * w], codebook[i]) for i in range(m)], axis=1)


def adc(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, vectors): sums of table entries over the codes."""
    return sum(table[:, i, codes[:, i]] for i in range(codes.shape[1]))


@dataclass(frozen=True)
class IvfConfig:
    dimension: int
    n_centroids: int
    sub_vectors: int
    seed: int = 1

    def __post_init__(self) -> None:
        require(self.dimension > 0, "dimension must be positive")
        require(self.sub_vectors > 0, "sub-vectors must be positive")
        require(self.dimension % self.sub_vectors == 0, "dimension must be a multiple of the sub-vectors")
        require(self.n_centroids > 0, "centroids must be positive")


@dataclass(frozen=True)
class IvfModel:
    """What one generation of training publishes."""

    centroids: np.ndarray
    codebook: np.ndarray  # of residuals
    routing: np.ndarray  # of raw vectors

    def router(self) -> dict[tuple[int, ...], int]:
        """Routing code to centroid; of centroids with one code the highest index holds."""
        return {tuple(code): c for c, code in enumerate(encode(self.centroids, self.routing).tolist())}

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, code of the residual) of stored vectors: the exactly nearest centroid."""
        c = closest(x, self.centroids)
        return c, encode(x - self.centroids[c], self.codebook)

    def route(self, q: np.ndarray, router: dict | None = None) -> np.ndarray:
        """The centroid a query is sent to: by its routing code if a centroid has it, else the nearest."""
        table = router or self.router()
        exact = closest(q, self.centroids)
        return np.array([table.get(tuple(code), int(e)) for code, e in zip(encode(q, self.routing).tolist(), exact, strict=True)], int)


def train_ivf(samples: DataFrame, config: IvfConfig, vec_col: str = "vec", order: str = "id") -> IvfModel:
    """Centroids, residual codebook and routing codebook from the samples, in the order of ``order``."""
    lengths = samples.agg(F.min(F.size(vec_col)).alias("a"), F.max(F.size(vec_col)).alias("b"), F.count("*").alias("n")).first()
    require(lengths["n"] > 0, "training set is empty")
    require(lengths["a"] == lengths["b"] == config.dimension, "vectors differ from the index's dimension", VectorDimensionMismatch)
    require(lengths["n"] >= config.n_centroids, "fewer rows than centroids")
    require(lengths["n"] >= CODES, "training set smaller than the codebook size")
    indexed = with_index(samples.select(order, F.col(vec_col).alias("vec")), order).select("index", "vec").persist()
    (centroids,) = train_kmeans(indexed, [slice(0, config.dimension)], config.n_centroids, TRAIN_ROUNDS, [config.seed])
    sent = samples.sparkSession.sparkContext.broadcast(centroids)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), config.dimension)
            r = x - sent.value[closest(x, sent.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(r), pa.list_(pa.float64()))], names=["index", "vec"])

    left = indexed.select("index", "vec").mapInArrow(residuals, "index BIGINT, vec ARRAY<DOUBLE>").persist()
    codebook = train_codebook(left, config.dimension, config.sub_vectors, TRAIN_ROUNDS, config.seed)
    routing = train_codebook(indexed, config.dimension, config.sub_vectors, TRAIN_ROUNDS, config.seed)
    left.unpersist()
    indexed.unpersist()
    return IvfModel(centroids, codebook, routing)


def postings(vectors: DataFrame, model: IvfModel, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(centroid, id, code) of each vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, codes = sent.value.assign(matrix(batch.column(1), sent.value.centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), batch.column(0), pa.array(codes.astype(np.int16).tolist(), pa.list_(pa.int16()))], names=["centroid", "id", "code"])

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, "centroid INT, id BIGINT, code ARRAY<SMALLINT>")


def tables(queries: DataFrame, codebook: np.ndarray) -> DataFrame:
    """(query_id, t): each query's distances to all codes of all sub-spaces, sub-space by sub-space."""
    sent = queries.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, _, w = sent.value.shape
        for batch in batches:
            t = lookup_table(matrix(batch.column(1), m * w), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(t.reshape(len(t), -1)), pa.list_(pa.float64()))], names=["query_id", "t"])

    return queries.select(F.col("query_id").cast("bigint"), "vec").mapInArrow(run, "query_id BIGINT, t ARRAY<DOUBLE>")


def routes(queries: DataFrame, model: IvfModel, n_probe: int = 1) -> DataFrame:
    """(query_id, vec, centroid, exact): the list a query is sent to and its exactly nearest centroid; with ``n_probe`` above 1 a
    row for each of its nearest centroids instead."""
    require(n_probe > 0, "probes must be positive")
    sent = queries.sparkSession.sparkContext.broadcast((model, model.router()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, router = sent.value
        for batch in batches:
            q = matrix(batch.column(1), m.centroids.shape[1])
            near = np.argsort(distances(q, m.centroids), axis=1, kind="stable")[:, :n_probe]
            to = near if n_probe > 1 else m.route(q, router)[:, None]
            at = pa.array(np.repeat(np.arange(len(q)), to.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(to.ravel(), pa.int32()), pa.array(np.repeat(near[:, 0], to.shape[1]), pa.int32())], names=["query_id", "vec", "centroid", "exact"])

    vec = queries.schema["vec"].dataType.simpleString()
    return queries.select(F.col("query_id").cast("bigint"), "vec").mapInArrow(run, f"query_id BIGINT, vec {vec}, centroid INT, exact INT")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def search(posted: DataFrame, model: IvfModel, queries: DataFrame, k: int, digits: int | None = None, n_probe: int = 1) -> DataFrame:
    """(query_id, rank, id, distance): each query's k nearest in the list it is routed to (or its ``n_probe`` nearest lists), by its
    residual's table.

    Lists above ``POSTING_ROWS`` are cut by id hash, and a list's queries above ``QUERY_BLOCK`` by theirs; a task has one part of
    each and keeps k rows a query.
    """
    require(k >= 0, "k must not be negative")
    sent = posted.sparkSession.sparkContext.broadcast(model)
    routed = routes(queries, model, n_probe).drop("exact")
    sizes = posted.groupBy("centroid").agg(F.ceil(F.count("*") / POSTING_ROWS).cast("int").alias("parts"))  # a row for each centroid
    crowds = routed.groupBy("centroid").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))  # a row for each centroid
    of = F.broadcast(sizes.join(F.broadcast(crowds), "centroid"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = posted.join(of, "centroid").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", every("blocks")).drop("parts", "blocks")
    asked = routed.join(of, "centroid").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("query_id", "vec", "centroid", "block", every("parts").alias("part"))

    def scan(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ps):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        m, codes, ids = sent.value, np.stack(ps["code"]).astype(int), ps["id"].to_numpy()
        out = []
        for i in range(0, len(qs), 64):  # bounded memory: 64 queries against a part
            some = qs.iloc[i : i + 64]
            table = lookup_table(np.stack(some["vec"]).astype(float) - m.centroids[int(some["centroid"].iloc[0])], m.codebook)
            d = adc(table, codes)
            out.append(_top(some["query_id"].to_numpy(), ids, d if digits is None else np.round(d, digits), k))
        q, i, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "id": i, "distance": d})

    by = ["centroid", "part", "block"]
    found = asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(scan, "query_id BIGINT, id BIGINT, distance DOUBLE")
    return _ranked(found, k)


def search_refined(posted: DataFrame, vectors: DataFrame, model: IvfModel, queries: DataFrame, k: int, n_probe: int, refine: int) -> DataFrame:
    """As ``search`` over several lists, with the exact distances of the ``refine`` times k nearest by table."""
    rough = search(posted, model, queries, k * refine, n_probe=n_probe).select("query_id", "id")
    exact = rough.join(vectors.select("id", "vec"), "id").join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
    return _ranked(exact.select("query_id", "id", l2_sq(F.col("q"), F.col("vec")).alias("distance")), k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact hits that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return exact.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("recall"))


class IvfIndex:
    """A trained index over a journal of vectors (id from 0, vec). Training publishes a new generation in the catalogue
    folder; readers use the generation they resolved."""

    def __init__(self, spark: SparkSession, config: IvfConfig, catalog):
        self.spark, self.config, self.catalog = spark, config, catalog

    @property
    def is_trained(self) -> bool:
        return self.catalog.current() is not None

    def _model(self) -> IvfModel:
        require(self.is_trained, "the index is not trained")
        return self.catalog.model(self.catalog.current())

    def train(self, samples: DataFrame) -> int:
        """Samples are not inserted; the journal's vectors are posted anew under the new model."""
        model = train_ivf(samples, self.config)
        journal = self.catalog.journal()
        return self.catalog.publish(model, postings(journal, model))

    def insert(self, vectors: DataFrame) -> None:
        """Append vectors (vec); ids go on from the journal's count. The vectors are written with an order of their own before
        they are numbered, and posted from the journal, so a lost executor can't give one two numbers."""
        model, start = self._model(), self.vector_count()
        bad = vectors.where(F.size("vec") != self.config.dimension).limit(1).count()
        require(not bad, "vectors differ from the index's dimension", VectorDimensionMismatch)
        staged = self.catalog.stage(vectors.select(F.monotonically_increasing_id().alias("place"), F.col("vec").cast("array<float>").alias("vec")))
        self.catalog.append_journal(with_index(staged, "place").select((F.col("index") + start).alias("id"), "vec"))
        self.catalog.append_postings(postings(self.catalog.journal().where(F.col("id") >= start), model))
        self.catalog.drop_stage()

    def vector_count(self) -> int:
        require(self.is_trained, "the index is not trained")
        return self.catalog.journal().count()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        generation = self.catalog.current()
        model = self._model()
        if (bad := queries.where(F.size("vec") != self.config.dimension).limit(1).count()) > 0:
            raise VectorDimensionMismatch(f"{bad} query of another dimension")
        return search(self.catalog.postings(generation), model, queries, k)

    def recluster(self) -> int | None:
        """Train from the journal; nothing happens if it is untrained or empty."""
        if not self.is_trained or not (n := self.vector_count()):
            return None
        if n < CODES:
            raise InvalidParameter("training set smaller than the codebook size")
        return self.train(self.catalog.journal())
