"""Queries over the driver's tables for every operation of the engine, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, text
from ..functions.distance import l2_sq
from ..operators import arena, audit, cache, kv, radix, telemetry, vector, wal
from ..sources.catalog import Catalog
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- keyed store


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: the user is the key, the event the value; an error deletes."""
    op = F.when(F.col("event_type") == "error", "del").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), kv.as_key(F.col("user_id").cast("string")).alias("key"), F.col("event_id").cast("decimal(20,0)").alias("value"))


def _user(df: DataFrame) -> list:
    return [df["key"].cast("string").cast("bigint").alias("user_id"), F.col("value").cast("bigint").alias("value")]


@query("""SELECT user_id, arg_max(event_id, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""")
def kv_upsert_current(spark, sf_dir):
    state = kv.current(_ops(spark, sf_dir))
    return state.select(*_user(state))


_HISTORY = """SELECT event_id, user_id, lag(event_type) OVER w AS before, lag(event_id) OVER w AS before_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""


@query(f"SELECT event_id, user_id, CASE WHEN before <> 'error' THEN before_id END AS previous FROM ({_HISTORY})")
def kv_upsert_previous(spark, sf_dir):
    done = kv.history(_ops(spark, sf_dir))
    return done.select(F.col("seq").alias("event_id"), _user(done)[0], F.col("previous").cast("bigint").alias("previous"))


@query(f"SELECT event_id, user_id, coalesce(before <> 'error', false) AS existed FROM ({_HISTORY.replace('FROM events', ', event_type FROM events')}) WHERE event_type = 'error'")
def kv_delete_existed(spark, sf_dir):
    done = kv.history(_ops(spark, sf_dir)).where("op = 'del'")
    return done.select(F.col("seq").alias("event_id"), _user(done)[0], "existed")


@query("""SELECT p.k AS probe, o.o_totalprice AS value FROM (SELECT o_orderkey * 2 AS k FROM orders) p LEFT JOIN orders o ON o.o_orderkey = p.k""")
def kv_point_get(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    state = orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return kv.get(state, orders.select((F.col("o_orderkey") * 2).alias("key"))).select(F.col("key").alias("probe"), "value")


def _url_keys(pages: DataFrame) -> DataFrame:
    """URLs up to their third and their fourth slash; the value is the least page."""
    cut = [F.substring_index("url", "/", n) for n in (3, 4)]
    keys = pages.select("page_id", F.explode(F.array(*cut)).alias("k"))
    return keys.groupBy(kv.as_key(F.col("k")).alias("key")).agg(F.min("page_id").alias("value"))


_URL_KEYS = """keys AS (SELECT k AS key, min(page_id) AS value FROM (
  SELECT page_id, unnest([array_to_string(string_split(url, '/')[1:3], '/'), array_to_string(string_split(url, '/')[1:4], '/')]) AS k FROM pages) GROUP BY k)"""
_LCP = """SELECT q.page_id, octet_length(encode(k.key)) AS matched_bytes, k.value FROM pages q LEFT JOIN {keys} k ON starts_with(q.url, k.key)
  QUALIFY row_number() OVER (PARTITION BY q.page_id ORDER BY octet_length(encode(k.key)) DESC NULLS LAST) = 1"""


@query(f"WITH {_URL_KEYS} {_LCP.format(keys='keys')}")
def kv_longest_prefix_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return kv.longest_prefix(_url_keys(pages), pages.select("page_id", "url"), "url").select("page_id", "matched_bytes", "value")


@query(f"WITH {_URL_KEYS}, live AS (SELECT * FROM keys WHERE value % 3 <> 0) {_LCP.format(keys='live')}")
def kv_lcp_with_tombstones(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    keys = _url_keys(pages)
    puts = keys.select(F.lit(0).alias("seq"), F.lit("put").alias("op"), "key", "value")
    deletes = keys.where("value % 3 = 0").select(F.lit(1), F.lit("del"), "key", F.lit(None).cast("bigint"))
    return kv.longest_prefix(kv.current(puts.union(deletes)), pages.select("page_id", "url"), "url").select("page_id", "matched_bytes", "value")


# --- radix shape and codecs


@query("""SELECT p_partkey, i - 1 AS position, instr('0123456789ABCDEF', substr(h, i, 1)) - 1 AS nibble
FROM (SELECT p_partkey, hex(encode(p_name)) AS h, unnest(range(1, 1 + length(hex(encode(p_name))))) AS i FROM part)""")
def key_nibbles(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", kv.as_key(F.col("p_name")).alias("key"))
    return parts.select("p_partkey", F.posexplode(bits.nibbles(F.col("key"))).alias("position", "nibble"))


_NODES = """nodes AS (SELECT d AS depth, substr(h, 1, d) AS path, bit_count(coalesce(bit_or(CASE WHEN d < length(h) THEN 1 << (instr('0123456789ABCDEF', substr(h, d + 1, 1)) - 1) END), 0)) AS n, bool_or(d = length(h)) AS leaf
  FROM (SELECT h, unnest(range(0, 1 + length(h))) AS d FROM (SELECT DISTINCT hex(encode(c_name)) AS h FROM customer)) GROUP BY ALL)"""


@query(f"""WITH {_NODES} SELECT depth, CASE WHEN n <= 4 THEN 'Node4' WHEN n <= 16 THEN 'Node16' WHEN n <= 64 THEN 'Node64' ELSE 'Node256' END AS family, count(*) AS n_nodes, sum(n)::BIGINT AS n_children, count(*) FILTER (leaf) AS n_leaves FROM nodes GROUP BY ALL""")
def radix_shape(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(kv.as_key(F.col("c_name")).alias("key")).distinct()
    return radix.shape(names)


@query("""SELECT p_partkey, mask, CASE WHEN (mask >> (p_size % 16)) & 1 = 1 AND p_partkey % 7 <> 0 THEN bit_count(mask & ((1 << (p_size % 16)) - 1))::INT END AS child
FROM (SELECT p_partkey, p_size, (p_partkey * 2654435761) % 65536 AS mask FROM part)""")
def resolve_child_rank(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") * 2654435761 % 65536).alias("mask"))
    return parts.select("p_partkey", "mask", bits.child_rank(F.col("mask"), F.col("p_size") % 16, F.col("p_partkey") % 7 == 0).alias("child"))


@query("""SELECT l_orderkey, l_linenumber, (l_suppkey % 6)::INT AS node_type, l_orderkey * 4096 + l_linenumber AS "offset", (l_partkey % 16)::INT AS arena, l_returnflag = 'R' AS tombstone, (l_partkey % 65536)::INT AS poly,
  lower(lpad(hex(((l_partkey % 65536)::UBIGINT << 48) | ((l_returnflag = 'R')::UBIGINT << 47) | ((l_partkey % 16)::UBIGINT << 43) | ((l_orderkey * 4096 + l_linenumber)::UBIGINT << 3) | (l_suppkey % 6)::UBIGINT), 16, '0')) AS word FROM lineitem""")
def pointer_pack_unpack(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    word = bits.pack_pointer(F.col("l_suppkey") % 6, F.col("l_orderkey") * 4096 + F.col("l_linenumber"), F.col("l_partkey") % 16, F.col("l_returnflag") == "R", F.col("l_partkey") % 65536)
    packed = items.select("l_orderkey", "l_linenumber", word.alias("w"))
    return packed.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in bits.unpack_pointer(F.col("w")).items()), F.lower(F.lpad(F.hex("w"), 16, "0")).alias("word"))


@query("""SELECT o_orderkey, v AS payload, dead AS tombstone, lower(hex(((v >> 44)::BIGINT << 48) | (dead::BIGINT << 47) | ((v & 17592186044415) << 3))) AS word
FROM (SELECT o_orderkey, (o_orderkey * 40503 + 12345) * 65537 % 72057594037927936 AS v, o_orderstatus = 'F' AS dead FROM orders)""")
def inline_leaf_codec(spark, sf_dir):
    v = (F.col("o_orderkey") * 40503 + 12345) * 65537 % 72057594037927936
    packed = table(spark, sf_dir, "orders").select("o_orderkey", bits.pack_inline(v, F.col("o_orderstatus") == "F").alias("w"))
    return packed.select("o_orderkey", *(c.alias(n) for n, c in bits.unpack_inline(F.col("w")).items()), F.lower(F.hex("w")).alias("word"))


@query("""SELECT event_id, ['TreeInsert','CasContention','TreeHit','VectorInsert','VectorSearch','Recluster','KvInsert','KvMatch','WalFlush','ClockEvict'][least(event_id % 12, 9) + 1] AS kind, (user_id % 268435456)::INT AS a, (event_id * 1000003 % 268435456)::INT AS b,
  ((event_id % 12) << 56) | ((user_id % 268435456) << 28) | (event_id * 1000003 % 268435456) AS word FROM events""")
def event_word_codec(spark, sf_dir):
    words = table(spark, sf_dir, "events").select("event_id", bits.encode_event(F.col("event_id") % 12, F.col("user_id"), F.col("event_id") * 1000003).alias("word"))
    return words.select("event_id", *(c.alias(n) for n, c in bits.decode_event(F.col("word")).items()), "word")


@query("""SELECT o_orderkey, CASE WHEN v < 72057594037927936 THEN 'LeafInlined' ELSE 'LeafOffset' END AS leaf FROM (SELECT o_orderkey, o_orderkey * 20000000000000 AS v FROM orders)""")
def leaf_kinds(spark, sf_dir):
    """Values of any order key: as decimals, which hold what a long doesn't."""
    value = F.col("o_orderkey").cast("decimal(19,0)") * F.lit(20000000000000).cast("decimal(14,0)")
    state = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return radix.leaves(state).select("o_orderkey", "leaf")


@query("SELECT count(*) AS n_keys, sum(octet_length(encode(user_id::VARCHAR)))::BIGINT AS key_bytes, 0 AS slot_bytes FROM (SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error')")
def kv_stats(spark, sf_dir):
    return kv.stats(kv.current(_ops(spark, sf_dir)))


@query(f"""WITH {_NODES.replace('bit_count(', '(', 1)}
SELECT path, nib::INT AS nibble, CASE WHEN (n >> nib) & 1 = 1 THEN bit_count(n & ((1 << nib) - 1))::INT END AS rank, CASE WHEN (n >> nib) & 1 = 1 THEN path || substr('0123456789ABCDEF', nib + 1, 1) END AS child FROM nodes, range(16) t(nib)""")
def radix_lookup_child(spark, sf_dir):
    """All sixteen children of each node of all depths, branching nodes and leaves too."""
    nodes = radix.nodes(table(spark, sf_dir, "customer").select(kv.as_key(F.col("c_name")).alias("key")).distinct())
    probes = nodes.select("path", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("nibble"))
    return radix.lookup_child(nodes, probes).select("path", "nibble", "rank", "child")


# --- memory accounting


@query("""SELECT doc_id, reserved, raw, start, start + n_chars <= 100000 AS fits FROM (SELECT *, ((raw + 7) // 8) * 8 AS start FROM (
  SELECT doc_id, n_chars, n_chars + 7 AS reserved, coalesce(sum(n_chars + 7) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw FROM documents))""")
def bump_alloc(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("arena"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"), F.lit(8).cast("bigint").alias("align"))
    return arena.bump(sizes, 100_000).select("doc_id", "reserved", "raw", "start", "fits")


@query("""SELECT s_suppkey, class, cap // (slot * n) AS chunks, cap // (slot * n) * n AS n_slots FROM (SELECT s_suppkey, 4096 + s_suppkey * 997 AS cap FROM supplier)
CROSS JOIN (VALUES (0, 48, 83), (1, 152, 26), (2, 528, 7), (3, 2064, 1)) t(class, slot, n)""")
def slab_class_capacity(spark, sf_dir):
    pools = table(spark, sf_dir, "supplier").select("s_suppkey", (4096 + F.col("s_suppkey") * 997).alias("capacity"))
    return arena.slab_capacity(pools).select("s_suppkey", "class", "chunks", "n_slots")


@query("""SELECT o_orderkey, o_custkey % 8 = 0 AND o_custkey + 48 <= 4096 AS ok FROM orders""")
def access_bounds(spark, sf_dir):
    ok = arena.in_bounds(F.col("o_custkey"), F.lit(48), F.lit(8), F.lit(4096))
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("ok"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type = 'error' AS back, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, []::BIGINT[] AS stack, 0::BIGINT AS chunks, NULL::BIGINT AS got, NULL::BIGINT AS event_id, false AS back FROM o
  UNION ALL
  SELECT user_id, k, CASE WHEN back THEN list_append(whole, 48::BIGINT) ELSE whole[1:len(whole) - 1] END, chunks + opened::BIGINT, CASE WHEN back THEN 48 ELSE whole[len(whole)] END, event_id, back
  FROM (SELECT *, CASE WHEN opened THEN list_transform(range(83), lambda i: chunks * 3984 + i * 48) ELSE stack END AS whole
        FROM (SELECT o.user_id, o.k, o.event_id, o.back, s.stack, s.chunks, NOT o.back AND len(s.stack) = 0 AND (s.chunks + 1) * 3984 <= 4096 AS opened FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)))
SELECT user_id AS pool, 0::INT AS class, event_id AS seq, CASE WHEN back THEN 'free' ELSE 'alloc' END AS op, got AS "offset" FROM s WHERE k > 0""")
def slab_replay(spark, sf_dir):
    """Slots handed out and taken back, by user; a delete gives back the slot of the same user's first chunk."""
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("pool"), F.lit(0).alias("class"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "free").otherwise("alloc").alias("op"), F.lit(48).cast("bigint").alias("offset"))
    return arena.slab_replay(ops, 4096)


@query("""SELECT g AS generation, CASE WHEN least_active IS NULL THEN 40 - g >= 1 ELSE least_active > g AND 40 - g >= 2 END AS reclaim
FROM (SELECT DISTINCT p_size AS g FROM part), (SELECT min(p_size) + 20 AS least_active FROM part WHERE p_size >= 10)""")
def snapshot_vacuum(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("generation")).distinct()
    readers = sizes.where("generation >= 10").select((F.col("generation") + 20).alias("era"))
    return arena.vacuum(sizes.withColumn("retired_era", F.col("generation")), readers, 40).select("generation", "reclaim")


# --- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _first(spark: SparkSession, sf_dir: str, n: int) -> np.ndarray:
    """The first n vectors: the fixed seeds of a model, n rows by definition."""
    return np.array([r["embedding"] for r in _vectors(spark, sf_dir).where(F.col("vec_id") < n).orderBy("vec_id").collect()], float)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 100."""
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_EMB = _D2.format(a="q.embedding", b="v.embedding")
_PAIRS = f"pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_EMB} AS d FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"


@query(f"WITH {_PAIRS} SELECT query_id, id, round(d, 4) AS distance FROM pairs")
def l2_pairs(spark, sf_dir):
    return vector.distance_pairs(_vectors(spark, sf_dir), _queries(spark, sf_dir))  # a query set against all rows


@query(f"WITH {_PAIRS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 4), id)::INT AS rank, id, round(d, 4) AS distance FROM pairs QUALIFY rank <= 10")
def exact_topk(spark, sf_dir):
    return vector.exact_topk(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10, digits=4)


_NEAREST = f"SELECT v.vec_id, v.embedding, q.vec_id::INT AS centroid, {_EMB} AS d FROM embeddings v, embeddings q WHERE q.vec_id < 16 QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, q.vec_id) = 1"


@query(f"SELECT vec_id, centroid, round(d, 4) AS distance FROM ({_NEAREST})")
def nearest_centroid(spark, sf_dir):
    found = vector.nearest(_vectors(spark, sf_dir), _first(spark, sf_dir, 16))
    return found.select("vec_id", "centroid", F.round("distance", 4).alias("distance"))


@query(f"SELECT count(*) AS n, round(sum(d), 3) AS inertia FROM ({_NEAREST})")
def kmeans_inertia(spark, sf_dir):
    found = vector.nearest(_vectors(spark, sf_dir), _first(spark, sf_dir, 16))
    return found.agg(F.count("*").alias("n"), F.round(F.sum("distance"), 3).alias("inertia"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.with_index(_vectors(spark, sf_dir), "vec_id").select("index", F.col("embedding").alias("vec"))


def _trained(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    """(centroid, i, n, mean): the trainer's points after some rounds from the first 16 vectors, and how many rows each of its last
    round's clusters had. A cluster that no row chose would be drawn anew and so has no row."""
    indexed = _indexed(spark, sf_dir)
    points = [_first(spark, sf_dir, 16)]
    for _ in range(rounds):
        points += vector.train_kmeans(indexed, [slice(0, 64)], 16, 1, [1], start=[points[-1]])
    sizes = vector.nearest(_vectors(spark, sf_dir), points[-2]).groupBy("centroid").agg(F.count("*").alias("n"))
    means = spark.createDataFrame([(c, i, x) for c, p in enumerate(points[-1].tolist()) for i, x in enumerate(p)], "centroid INT, i INT, mean DOUBLE")
    return means.join(F.broadcast(sizes), "centroid").select("centroid", "i", "n", "mean")


_STEP = "SELECT centroid, i, count(*) AS n, avg(x::DOUBLE) AS mean FROM (SELECT centroid, unnest(embedding) AS x, (generate_subscripts(embedding, 1) - 1)::INT AS i FROM ({from_})) GROUP BY centroid, i"
_STEP1 = _STEP.format(from_=_NEAREST)


@query(f"SELECT centroid, i, n, round(mean, 5) AS mean FROM ({_STEP1})")
def kmeans_one_step(spark, sf_dir):
    return _trained(spark, sf_dir, 1).withColumn("mean", F.round("mean", 5))


def _next_step(number: int) -> str:
    return f"""c{number} AS (SELECT centroid, list(mean ORDER BY i) AS m FROM step{number} GROUP BY centroid),
near{number} AS (SELECT v.vec_id, v.embedding, c.centroid, {_D2.format(a='v.embedding', b='c.m')} AS d FROM embeddings v, c{number} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.centroid) = 1),
step{number + 1} AS ({_STEP.format(from_=f'SELECT * FROM near{number}')})"""


@query(f"WITH step1 AS ({_STEP1}), {_next_step(1)} SELECT centroid, i, n, round(mean, 5) AS mean FROM step2")
def kmeans_two_steps(spark, sf_dir):
    return _trained(spark, sf_dir, 2).withColumn("mean", F.round("mean", 5))


@query(f"WITH step1 AS ({_STEP1}), {', '.join(map(_next_step, range(1, 5)))} SELECT centroid, i, round(mean, 5) AS mean FROM step5")
def kmeans_trained(spark, sf_dir):
    """Five rounds in one call of the trainer."""
    (points,) = vector.train_kmeans(_indexed(spark, sf_dir), [slice(0, 64)], 16, 5, [1], start=[_first(spark, sf_dir, 16)])
    return spark.createDataFrame([(c, i, x) for c, p in enumerate(points.tolist()) for i, x in enumerate(p)], "centroid INT, i INT, mean DOUBLE").withColumn("mean", F.round("mean", 5))


def _codebook(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """(8, 256, 8): the sub-vectors of the first 256 vectors."""
    return _first(spark, sf_dir, 256).reshape(256, 8, 8).transpose(1, 0, 2)


_SUBS = "subs AS (SELECT vec_id, s, embedding[s * 8 + 1 : s * 8 + 8] AS x FROM embeddings, range(8) t(s))"
_BOOK = "book AS (SELECT vec_id AS code, s, x FROM subs WHERE vec_id < 256)"
_CODES = f"codes AS (SELECT v.vec_id, v.s, b.code FROM subs v JOIN book b USING (s) QUALIFY row_number() OVER (PARTITION BY v.vec_id, v.s ORDER BY {_D2.format(a='v.x', b='b.x')}, b.code) = 1)"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _codebook(spark, sf_dir)
    model = vector.IvfModel(np.zeros((1, 64)), book, book)
    return vector.postings(_vectors(spark, sf_dir), model, "vec_id", "embedding")


@query(f"WITH {_SUBS}, {_BOOK}, {_CODES} SELECT vec_id, s::INT AS sub, code::SMALLINT AS code FROM codes")
def pq_encode(spark, sf_dir):
    return _coded(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode("code").alias("sub", "code"))


_LUT = f"lut AS (SELECT q.vec_id AS query_id, q.s, b.code, {_D2.format(a='q.x', b='b.x')} AS d FROM subs q JOIN book b USING (s) WHERE q.vec_id % 100 = 0)"


@query(f"WITH {_SUBS}, {_BOOK}, {_LUT} SELECT query_id, s::INT AS sub, code::INT AS code, round(d, 4) AS d FROM lut")
def adc_lut(spark, sf_dir):
    """Each query's table: 8 x 256 numbers."""
    each = vector.tables(_queries(spark, sf_dir), _codebook(spark, sf_dir)).select("query_id", F.posexplode("t").alias("p", "d"))
    return each.select("query_id", F.floor(F.col("p") / 256).cast("int").alias("sub"), (F.col("p") % 256).cast("int").alias("code"), F.round("d", 4).alias("d"))


@query(f"""WITH {_SUBS}, {_BOOK}, {_CODES}, {_LUT}, sums AS (SELECT l.query_id, c.vec_id AS id, round(sum(l.d), 4) AS distance FROM codes c JOIN lut l ON l.s = c.s AND l.code = c.code GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, id, distance FROM sums QUALIFY rank <= 10""")
def adc_topk_flat(spark, sf_dir):
    book = _codebook(spark, sf_dir)
    model = vector.IvfModel(np.zeros((1, 64)), book, book)
    return vector.search(_coded(spark, sf_dir), model, _queries(spark, sf_dir), 10, digits=4)


def _fixed_ivf(spark: SparkSession, sf_dir: str, m: int = 8) -> vector.IvfModel:
    """16 centroids from the first vectors; residual and routing codebooks from the first 256. Every vector is indexed."""
    first = _first(spark, sf_dir, 256)
    centroids = first[:16]
    left = first - centroids[vector.distances(first, centroids).argmin(1)]
    cut = lambda x: x.reshape(256, m, 64 // m).transpose(1, 0, 2)
    return vector.IvfModel(centroids, cut(left), cut(first))


@query(f"SELECT centroid, count(*) AS n FROM ({_NEAREST}) GROUP BY centroid")
def ivf_postings_stats(spark, sf_dir):
    posted = vector.postings(_vectors(spark, sf_dir), _fixed_ivf(spark, sf_dir), "vec_id", "embedding")
    return posted.groupBy("centroid").agg(F.count("*").alias("n"))


_ROUTER = f"""{_SUBS}, {_BOOK}, {_CODES}, words AS (SELECT vec_id, list(code ORDER BY s) AS w FROM codes GROUP BY vec_id),
router AS (SELECT w, max(vec_id)::INT AS centroid FROM words WHERE vec_id < 16 GROUP BY w), near AS ({_NEAREST}),
routed AS (SELECT n.vec_id, coalesce(r.centroid, n.centroid) AS routed, n.centroid AS exact FROM near n JOIN words USING (vec_id) LEFT JOIN router r USING (w))"""


@query(f"WITH {_ROUTER} SELECT vec_id, routed, exact FROM routed")
def ivf_router(spark, sf_dir):
    routed = vector.routes(_vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), _fixed_ivf(spark, sf_dir))
    return routed.select(F.col("query_id").alias("vec_id"), F.col("centroid").alias("routed"), "exact")


_SUBTRACT = "list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE - x[2]::DOUBLE)"
_IVF = f"""{_ROUTER}, left_over AS (SELECT n.vec_id, n.centroid, {_SUBTRACT.format(a='n.embedding', b='c.embedding')} AS r FROM near n JOIN embeddings c ON c.vec_id = n.centroid),
rsubs AS (SELECT vec_id, centroid, s, r[s * 8 + 1 : s * 8 + 8] AS x FROM left_over, range(8) t(s)), rbook AS (SELECT vec_id AS code, s, x FROM rsubs WHERE vec_id < 256),
rcodes AS (SELECT v.vec_id, v.centroid, v.s, b.code FROM rsubs v JOIN rbook b USING (s) QUALIFY row_number() OVER (PARTITION BY v.vec_id, v.s ORDER BY {_D2.format(a='v.x', b='b.x')}, b.code) = 1),
asked AS (SELECT q.vec_id AS query_id, r.routed AS centroid, {_SUBTRACT.format(a='q.embedding', b='c.embedding')} AS r FROM embeddings q JOIN routed r USING (vec_id) JOIN embeddings c ON c.vec_id = r.routed WHERE q.vec_id % 100 = 0),
rlut AS (SELECT query_id, centroid, b.s, b.code, {_D2.format(a='r[b.s * 8 + 1 : b.s * 8 + 8]', b='b.x')} AS d FROM asked, rbook b),
scanned AS (SELECT l.query_id, c.vec_id AS id, round(sum(l.d), 4) AS distance FROM rcodes c JOIN rlut l ON l.centroid = c.centroid AND l.s = c.s AND l.code = c.code GROUP BY ALL),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, id, distance FROM scanned QUALIFY rank <= 10)"""


def _ivf_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fixed_ivf(spark, sf_dir)
    posted = vector.postings(_vectors(spark, sf_dir), model, "vec_id", "embedding")
    return vector.search(posted, model, _queries(spark, sf_dir), 10, digits=4)


@query(f"WITH {_IVF} SELECT * FROM hits")
def ivf_search_nprobe1(spark, sf_dir):
    return _ivf_hits(spark, sf_dir)


@query(f"""WITH {_IVF}, {_PAIRS}, exact AS (SELECT query_id, id FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 4), id) <= 10)
SELECT e.query_id, count(h.id) / 10 AS recall FROM exact e LEFT JOIN hits h ON h.query_id = e.query_id AND h.id = e.id GROUP BY e.query_id""")
def ivf_recall_at_10(spark, sf_dir):
    return vector.recall(_ivf_hits(spark, sf_dir), exact_topk(spark, sf_dir), 10)


@query()
def ivf_search_refined(spark, sf_dir):
    """Fine codes, 14 of 16 lists and exact distances for the nearest by table: recall of 0.9 or more against brute force on
    vectors without clusters, where a list or two find little."""
    model = _fixed_ivf(spark, sf_dir, 32)
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vector.search_refined(vector.postings(vectors, model), vectors, model, _queries(spark, sf_dir), 10, n_probe=14, refine=8)


def _folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/index-{uuid.uuid4().hex}"


@query()
def ivf_trained_search(spark, sf_dir):
    """Train, insert, re-cluster from the journal and search: three generations of a catalogue."""
    index = vector.IvfIndex(spark, vector.IvfConfig(64, 8, 8, 7), Catalog(spark, _folder(spark)))
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index.train(vectors)
    index.insert(vectors.orderBy("id").select("vec"))
    index.recluster()
    return index.search(_queries(spark, sf_dir), 10)


# --- prefix cache


def _tokens(turns: DataFrame) -> DataFrame:
    """Words as numbers: the first seven hexadecimal digits of their md5."""
    words = F.transform(F.split("text", " "), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint"))
    return turns.select("conv_id", "turn", words.alias("tokens"))


_TOKENS = "tokens AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT) AS tokens FROM conversations)"
_STORED = "stored AS (SELECT tokens[1:3 + turn] AS tokens, max(conv_id * 10 + turn + 1) AS kv_offset FROM tokens WHERE len(tokens) >= 3 + turn GROUP BY ALL)"


@query(f"WITH {_TOKENS} SELECT conv_id, turn, array_to_string(list_transform(tokens, lambda t: printf('%02X%02X%02X%02X', t & 255, (t >> 8) & 255, (t >> 16) & 255, t >> 24)), '') AS key FROM tokens")
def cache_token_keys(spark, sf_dir):
    return _tokens(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.hex(cache.encode_key(F.col("tokens"))).alias("key"))


def _stored(tokens: DataFrame) -> DataFrame:
    some = tokens.where(F.size("tokens") >= 3 + F.col("turn"))
    return cache.latest(some.select(F.slice("tokens", F.lit(1), (3 + F.col("turn")).cast("int")).alias("tokens"), (F.col("conv_id") * 10 + F.col("turn") + 1).alias("kv_offset"), (F.col("conv_id") * 10 + F.col("turn")).alias("seq")))


@query(f"""WITH {_TOKENS}, {_STORED} SELECT q.conv_id, q.turn, len(s.tokens)::INT AS token_len, s.kv_offset FROM tokens q LEFT JOIN stored s ON q.tokens[1:len(s.tokens)] = s.tokens
QUALIFY row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY len(s.tokens) DESC NULLS LAST) = 1""")
def cache_prefix_match(spark, sf_dir):
    tokens = _tokens(table(spark, sf_dir, "conversations"))
    return cache.match_prefix(_stored(tokens), tokens).select("conv_id", "turn", "token_len", "kv_offset")


@query(f"WITH {_TOKENS}, {_STORED} SELECT array_to_string(tokens, ' ') AS prefix, kv_offset FROM stored")
def cache_latest_offset(spark, sf_dir):
    stored = _stored(_tokens(table(spark, sf_dir, "conversations")))
    return stored.select(F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("prefix"), "kv_offset")


@query("""WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' ELSE 'pass' END AS kind FROM events),
l AS (SELECT *, max(CASE WHEN kind = 'insert' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS inserted FROM k),
m AS (SELECT *, count(*) FILTER (kind = 'pass') OVER w AS passes, max(event_id) FILTER (kind <> 'pass') OVER w AS touched, max(event_id) FILTER (kind = 'pass') OVER (PARTITION BY user_id, inserted ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_pass
  FROM l WHERE inserted IS NOT NULL WINDOW w AS (PARTITION BY user_id, inserted ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, inserted, min(CASE WHEN kind = 'pass' AND passes > 1 AND touched < last_pass THEN event_id END) AS evicted FROM m GROUP BY ALL""")
def cache_clock_batch(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type").isin("click", "view"), "touch").otherwise("pass")
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"))
    return cache.clock_batch(events, "user_id").select("user_id", "inserted", "evicted")


def cache_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as operations on sixteen caches: even turns insert their first 3 + turn tokens, odd ones match with all of
    theirs, the eighth sweeps."""
    t = _tokens(table(spark, sf_dir, "conversations"))
    op = F.when(F.col("turn") % 8 == 7, "sweep").when(F.col("turn") % 2 == 0, "insert").otherwise("match")
    key = F.when(op == "insert", F.slice("tokens", F.lit(1), 3 + F.col("turn"))).otherwise(F.col("tokens"))
    return t.select((F.col("conv_id") % 16).alias("cache_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("seq"), op.alias("op"), key.alias("tokens"), (F.col("conv_id") * 10 + F.col("turn") + 1).alias("kv_offset"), F.lit(512).alias("steps"))


# A full sweep looks at all cells, so the hand is always back at the first.
_SWEPT_LIVE = "list_transform(list_filter({live}, lambda e: e.mark > 0), lambda e: {{'cell': e.cell, 'key': e.key, 'kv': e.kv, 'mark': e.mark - 1, 'own': e.own}})"
_SWEPT_FREE = "list_concat({free}, list_transform(list_filter({live}, lambda e: e.mark = 0), lambda e: e.cell))"
_REPLAY = f"""ops AS (SELECT conv_id % 16 AS cache_id, conv_id * 10 + turn AS seq, CASE WHEN turn % 8 = 7 THEN 'sweep' WHEN turn % 2 = 0 THEN 'insert' ELSE 'match' END AS op,
  CASE WHEN turn % 8 <> 7 AND turn % 2 = 0 THEN tokens[1:3 + turn] ELSE tokens END AS tokens, conv_id * 10 + turn + 1 AS kv, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id * 10 + turn) AS k FROM tokens),
s AS (
  SELECT DISTINCT cache_id, 0::BIGINT AS k, []::BIGINT[] AS free, 0::BIGINT AS chunks, []::STRUCT(cell BIGINT, key BIGINT[], kv BIGINT, mark BIGINT, own BOOLEAN)[] AS live, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::BIGINT AS token_len, NULL::BIGINT AS kv_offset, NULL::BIGINT AS evicted FROM ops
  UNION ALL
  SELECT cache_id, k, CASE WHEN op = 'insert' THEN f3[1:len(f3) - 1] ELSE f3 END, chunks + opened::BIGINT,
    CASE op WHEN 'insert' THEN list_sort(list_append(list_transform(l2, lambda e: {{'cell': e.cell, 'key': e.key, 'kv': e.kv, 'mark': e.mark, 'own': e.own AND e.key <> tokens}}), {{'cell': f3[len(f3)], 'key': tokens, 'kv': kv, 'mark': 1::BIGINT, 'own': true}}))
            WHEN 'match' THEN list_transform(l2, lambda e: {{'cell': e.cell, 'key': e.key, 'kv': e.kv, 'mark': CASE WHEN e.cell = best.cell THEN 1 ELSE e.mark END, 'own': e.own}}) ELSE l2 END,
    seq, op, CASE WHEN op = 'match' THEN len(best.key) END, CASE WHEN op = 'match' THEN best.kv END, CASE WHEN op = 'sweep' THEN len(live) - len(l1) END
  FROM (SELECT *, op = 'insert' AND len(f2) = 0 AS opened, CASE WHEN op = 'insert' AND len(f2) = 0 THEN list_transform(range(83), lambda i: (chunks * 3984 + i * 48) // 8) ELSE f2 END AS f3,
          list_sort(list_transform(list_filter(l2, lambda e: e.own AND tokens[1:len(e.key)] = e.key), lambda e: {{'n': len(e.key), 'e': e}}), 'DESC')[1].e AS best
        FROM (SELECT *, CASE WHEN full_ THEN {_SWEPT_LIVE.format(live='l1')} ELSE l1 END AS l2, CASE WHEN full_ THEN {_SWEPT_FREE.format(free='f1', live='l1')} ELSE f1 END AS f2
              FROM (SELECT *, CASE WHEN full_ OR op = 'sweep' THEN {_SWEPT_LIVE.format(live='live')} ELSE live END AS l1, CASE WHEN full_ OR op = 'sweep' THEN {_SWEPT_FREE.format(free='free', live='live')} ELSE free END AS f1
                    FROM (SELECT o.cache_id, o.k, o.seq, o.op, o.tokens, o.kv, s.free, s.chunks, s.live, o.op = 'insert' AND len(s.free) = 0 AND (s.chunks + 1) * 3984 > 4096 AS full_
                          FROM s JOIN ops o ON o.cache_id = s.cache_id AND o.k = s.k + 1)))))"""


@query(f"WITH RECURSIVE {_TOKENS}, {_REPLAY} SELECT cache_id, seq, op, token_len, kv_offset, evicted FROM s WHERE k > 0")
def cache_replay(spark, sf_dir):
    return cache.replay(cache_ops(spark, sf_dir), 4096)


# --- write-ahead log


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events are a transaction, its last one the parent; a hundred are a log."""
    op = (F.col("event_id") % 3).cast("tinyint")
    payload = F.when(op == 2, F.encode("props", "UTF-8")).otherwise(wal.region_payload(F.col("user_id")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.floor(F.col("event_id") / 100).alias("log_id"), F.floor(F.col("event_id") / 10).alias("tx_id"), (F.col("event_id") % 10).cast("int").alias("pos"),
        (F.col("event_id") % 10 == 9).alias("is_parent"), F.col("event_id").alias("lsn"), op.alias("opcode"), (F.col("event_id") * 7 % 997).alias("offset"), payload.alias("payload"))


_FRAMES = """frames AS (SELECT event_id, event_id // 100 AS log_id, event_id // 10 AS tx_id, event_id % 3 AS opcode, event_id * 7 % 997 AS off,
  CASE WHEN event_id % 3 = 2 THEN hex(encode(props)) ELSE printf('%08X', user_id) END AS payload FROM events)"""


@query(f"WITH {_FRAMES} SELECT event_id, printf('%08X', length(payload) // 2 + 10) || printf('%02X', opcode) || printf('%010X', off) || printf('%08X', length(payload) // 2) || payload AS frame FROM frames")
def wal_encode(spark, sf_dir):
    return _frames(spark, sf_dir).select("event_id", F.hex(wal.encode_frame(F.col("opcode"), F.col("offset"), F.col("payload"))).alias("frame"))


@query(f"WITH {_FRAMES} SELECT log_id, count(*) AS n, sum(length(payload) // 2 + 10)::BIGINT AS declared, sum(length(payload) // 2 + 14)::BIGINT AS bytes FROM frames GROUP BY log_id")
def wal_log_sizes(spark, sf_dir):
    n = wal.encoded_length(F.col("payload"))
    return _frames(spark, sf_dir).groupBy("log_id").agg(F.count("*").alias("n"), F.sum(n).alias("declared"), F.sum(n + 4).alias("bytes"))


@query(f"WITH {_FRAMES} SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY event_id) - 1 AS lsn, opcode::TINYINT AS opcode, off AS \"offset\", payload FROM frames")
def wal_decode(spark, sf_dir):
    logs = wal.encode_logs(wal.commit_order(_frames(spark, sf_dir)))
    return wal.parse_logs(logs).select("log_id", "lsn", "opcode", "offset", F.hex("payload").alias("payload"))


_IMAGE = "SELECT off + i AS address, arg_max(instr('0123456789ABCDEF', substr(payload, 2 * i + 1, 1)) * 16 - 16 + instr('0123456789ABCDEF', substr(payload, 2 * i + 2, 1)) - 1, event_id)::SMALLINT AS byte FROM (SELECT *, unnest(range(length(payload) // 2)) AS i FROM frames WHERE opcode = 2 {and_}) GROUP BY address"


@query(f"WITH {_FRAMES} {_IMAGE.format(and_='')}")
def wal_replay(spark, sf_dir):
    return wal.replay(_frames(spark, sf_dir))


@query(f"WITH {_FRAMES} SELECT max(off + length(payload) // 2) AS high_water FROM frames")
def wal_high_water(spark, sf_dir):
    return wal.high_water(_frames(spark, sf_dir))


@query(f"WITH {_FRAMES} {_IMAGE.format(and_='AND tx_id < 64')}")
def wal_crash_prefix(spark, sf_dir):
    return audit.crash_audit(_frames(spark, sf_dir), 64)


@query("SELECT event_id // 10 AS tx_id, count(*) AS n, max(CASE WHEN event_id % 10 = 9 THEN event_id % 10 END)::INT AS parent_at FROM events GROUP BY 1")
def wal_tx_order(spark, sf_dir):
    """The parent's place in each transaction's order: it comes last."""
    ordered = wal.commit_order(_frames(spark, sf_dir))
    place = (F.row_number().over(Window.partitionBy("tx_id").orderBy("order")) - 1).cast("int")
    return ordered.withColumn("place", place).groupBy("tx_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("is_parent"), F.col("place"))).alias("parent_at"))


# --- telemetry and audits


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counters(spark, sf_dir):
    return telemetry.counters(table(spark, sf_dir, "events"), "event_type")


@query("SELECT user_id, hits, misses, CASE WHEN hits + misses = 0 THEN 0 ELSE hits / (hits + misses) END AS rate FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY user_id)")
def hit_rate(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"))
    return n.withColumn("rate", telemetry.hit_rate(F.col("hits"), F.col("misses")))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, count(*) / 3600 AS rate FROM events GROUP BY ALL")
def rates_per_hour(spark, sf_dir):
    return telemetry.rates_per_hour(table(spark, sf_dir, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""SELECT event_id, user_id, CASE WHEN gap >= 0.1 THEN round(1 / gap, 6) END AS rate FROM (SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)""")
def sample_rates(spark, sf_dir):
    """Each user's events as a rising counter."""
    events = table(spark, sf_dir, "events")
    seen = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return telemetry.rates(events.withColumn("seen", seen), "seen", by="user_id").select("event_id", "user_id", F.round("rate", 6).alias("rate"))


@query("SELECT hour, count(*) AS n, least(count(*), 8) AS kept, greatest(count(*) - 8, 0) AS dropped FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour FROM events) GROUP BY hour")
def ring_drop_newest(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return telemetry.ring(events, "hour", "event_id", 8).groupBy("hour").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id LIMIT 64) WHERE event_type NOT IN ('CasContention', 'TreeHit') ORDER BY event_id DESC LIMIT 6")
def log_pump(spark, sf_dir):
    return telemetry.pump(table(spark, sf_dir, "events"), "event_id", "event_type").select("event_id", "event_type")


# The storm's operations and their values, made in SQL: FNV-1a of each key's bytes, in wide numbers.
_STORM = """attempts AS (SELECT w, a, a % 65536 AS k FROM range(16) x(w), range(62500) y(a)),
bytes AS (SELECT k, 'storm:' || lpad(lower(printf('%X', k)), 12, '0') AS key FROM range(65536) z(k)),
stored AS (SELECT k, (list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, 19), lambda i: ord(key[i])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 72057594037927936::HUGEINT)::BIGINT AS v FROM bytes),
ops AS (SELECT k, v, 32 * a + w AS read_at, 32 * a + 16 + w AS write_at FROM attempts JOIN stored USING (k))"""


@query(f"""WITH {_STORM}, held AS (SELECT k, arg_max(v, write_at) AS v FROM ops GROUP BY k)
SELECT count(*) AS verified, count(*) FILTER (h.v IS DISTINCT FROM s.v) AS lost FROM stored s LEFT JOIN held h USING (k) WHERE k < least(65536, 62500)""")
def storm_audit(spark, sf_dir):
    return audit.storm_audit(spark, 16, 1_000_000, 65_536)


@query(f"""WITH {_STORM}, seen AS (SELECT k, write_at, moment = write_at AS writes, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sees
  FROM (SELECT k, read_at AS moment, write_at, NULL AS v FROM ops UNION ALL SELECT k, write_at, write_at, v FROM ops)),
pairs AS (SELECT max(sees) FILTER (NOT writes) AS looked, max(sees) FILTER (writes) AS replaced FROM seen GROUP BY k, write_at)
SELECT count(*) AS attempts, count(*) FILTER (looked IS DISTINCT FROM replaced) AS contended, count(*) FILTER (looked IS DISTINCT FROM replaced) * 100.0::DOUBLE / count(*) AS rate FROM pairs""")
def storm_contention(spark, sf_dir):
    return audit.storm_contention(audit.storm_ops(spark, 16, 1_000_000, 65_536))


@query("""WITH frames AS (SELECT tx, pos, 8 * tx AS off, CASE pos WHEN 0 THEN 4 ELSE 8 END AS n FROM range(512) t(tx), range(2) p(pos))
SELECT count(DISTINCT tx) AS written, count(DISTINCT tx) FILTER (tx < 400) AS replayed, count(*) FILTER (tx < 400 AND pos = 1) AS survived, count(*) FILTER (tx < 400 AND pos = 1) = 400 AS consistent,
  max(off + n) FILTER (tx < 400) AS high_water, sum(14 + n)::BIGINT AS log_bytes FROM frames""")
def crash_cycle(spark, sf_dir):
    return audit.crash_cycle(spark, 512, 400)


@query("""WITH filled AS (SELECT i, 28 * i AS raw, (28 * i + 7) // 8 * 8 + 21 <= 1048576 AS fits FROM range(60000) t(i))
SELECT count(*) AS inserted, max(raw + 28)::BIGINT AS frontier, 1048576::BIGINT AS capacity, count(*) FILTER (i % 97 = 0) AS verified, (65536 // 3984 * 83)::BIGINT AS allocated, (65536 // 3984 * 83 // 2)::BIGINT AS recycled FROM filled WHERE fits""")
def pressure_audit(spark, sf_dir):
    """An arena of 1 MiB and a slab pool of 64 KiB."""
    return audit.pressure(spark, 1 << 20)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 97 = 0")
def pressure_sample(spark, sf_dir):
    return audit.sample(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) <= 65536 AS stored FROM documents")
def memory_exhaustion(spark, sf_dir):
    return audit.fill(table(spark, sf_dir, "documents"), 65_536, "n_chars", "doc_id", "source").select("doc_id", "used", "stored")


@query("""SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024) ELSE n || ' B' END AS size,
  '[' || repeat('▓', k) || repeat('░', 10 - k) || ']' AS bar FROM (SELECT doc_id, n_chars * n_chars AS n, floor(least(1.0, n_chars / 5000) * 10)::INT AS k FROM documents)""")
def display_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n", F.col("n_chars") * F.col("n_chars"))
    return docs.select("doc_id", text.format_bytes(F.col("n")).alias("size"), text.bar(F.col("n_chars") / 5000, 12).alias("bar"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1048576 WHEN 2 THEN p_size * 1073741824 WHEN 3 THEN p_size END AS bytes FROM (SELECT p_partkey, p_size::BIGINT AS p_size FROM part)")
def parse_sizes(spark, sf_dir):
    suffix = F.get(F.array(*map(F.lit, ("KB", "MB", "GB", "", "XB"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_size(F.concat(F.col("p_size").cast("string"), suffix)).alias("bytes"))
