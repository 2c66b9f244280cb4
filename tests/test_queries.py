"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from prefixspark.plans import entries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", entries.SQL)
def test_matches_sql(spark, db, name):
    df = entries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(db.sql(entries.SQL[name]).columns)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({entries.SQL[name]})").fetchall()
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert key(df.select(*columns).collect()) == key(want)


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(entries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["page_id", "matched_bytes", "value"]
    without = set(entries.QUERIES) - set(entries.SQL)
    assert without == {"ivf_trained_search", "ivf_search_refined"}  # tested on their own


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_refined_search_reaches_its_recall(spark, sf):
    where = f"/root/testdata/{sf}"
    found, exact = (entries.QUERIES[n](spark, where) for n in ("ivf_search_refined", "exact_topk"))
    rows = entries.vector.recall(found, exact, 10).collect()
    assert len(rows) == exact.select("query_id").distinct().count() >= 5 and sum(r["recall"] for r in rows) / len(rows) >= 0.9


def test_prefix_match_is_an_equi_join(spark):
    plan = entries.kv_longest_prefix_url(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_state_has_partial_aggregation(spark):
    plan = entries.kv_upsert_current(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") >= 1 and plan.count("Exchange") == 1


def test_children_of_every_node_match_brute_force(spark):
    keys = {r["c_name"].encode().hex().upper() for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    children = {}
    for h in keys:
        for d in range(len(h) + 1):
            children.setdefault(h[:d], set()).update(h[d : d + 1])
    want = {(p, i): (sorted(c).index(x), p + x) if (x := "0123456789ABCDEF"[i]) in c else (None, None) for p, c in children.items() for i in range(16)}
    rows = entries.QUERIES["radix_lookup_child"](spark, SF).collect()
    assert len(rows) == len(want) and {(r["path"], r["nibble"]): (r["rank"], r["child"]) for r in rows} == want
    assert max(r["rank"] for r in rows if r["rank"] is not None) == 9 and any(not c for c in children.values())


def test_sql_replays_a_full_cache(spark):
    """On a larger table, where inserts find the cache full and sweep it themselves."""
    db = duckdb.connect()
    db.sql("CREATE VIEW conversations AS FROM '/root/testdata/sf0.1/conversations.parquet'")
    df = entries.QUERIES["cache_replay"](spark, "/root/testdata/sf0.1")
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({entries.SQL['cache_replay']})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_cache_replay_probes_with_whole_texts(spark):
    turns = {(r["conv_id"], r["turn"]): r["text"].split(" ") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    ops = {r["seq"]: r for r in entries.cache_ops(spark, SF).collect()}
    assert all(len(ops[i * 10 + t]["tokens"]) == (min(3 + t, len(w)) if t % 2 == 0 else len(w)) for (i, t), w in turns.items())
    assert len({len(w) for (_, t), w in turns.items() if t % 2 and t % 8 != 7}) > 1 < max(len(w) for w in turns.values()) / 4
    rows = entries.QUERIES["cache_replay"](spark, SF).collect()
    assert {r["seq"] for r in rows} == set(ops)
    assert all(r["token_len"] <= len(ops[r["seq"]]["tokens"]) for r in rows if r["token_len"])


def test_leaf_kinds_of_values_beyond_a_long(spark, tmp_path):
    keys = [1, 3602, 3603, 461_168, 461_169, 36_000_000, (1 << 63) - 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    rows = entries.QUERIES["leaf_kinds"](spark, f"file://{tmp_path}").collect()
    assert {r["o_orderkey"]: r["leaf"] for r in rows} == {k: "LeafInlined" if k * 20000000000000 < 1 << 56 else "LeafOffset" for k in keys}
