import datetime as dt
import random

import duckdb
import pytest

from prefixspark.llm import entries as E
from prefixspark.llm import url_filter as U

DAY0 = dt.date(2024, 1, 1)


def plain(captures, entries):
    state = {}
    for p, day, on in entries:
        if p is not None and day is not None and on is not None:
            state.setdefault(p.lower(), {}).setdefault(day, []).append(on)
    out = []
    for i, url, day in captures:
        active = []
        if url and "://" in url and day is not None:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
            path = "/" + rest.split("?")[0].split("#")[0].partition("/")[2].lower()
            for p, days in state.items():
                before = [d for d in days if d <= day]
                if before and any(days[max(before)]):
                    ph, _, pp = p.partition("/")
                    parts = [x for x in path.split("/") if x]
                    if (not pp and (host == ph or host.endswith("." + ph))) or (pp and host == ph and parts[: len(pp.split("/"))] == pp.split("/")):
                        active.append(p)
        best = min(active, key=lambda p: (-len(p), p), default=None)
        out.append((str(i), str(url), str(day), best is not None, best, len(active)))
    return sorted(out, key=str)


def tables(spark, seed=1):
    rng = random.Random(seed)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org", "other.net"]
    entries = [(rng.choice(hosts) + rng.choice(["", "", "/en", "/en/deep", "/EN"]), DAY0 + dt.timedelta(rng.randint(0, 900)), rng.random() < 0.6) for _ in range(150)]
    entries += [(None, DAY0, True), ("a.com", None, True), ("a.com", DAY0, None)]
    captures = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'user@'])}{rng.choice(hosts)}{rng.choice(['', ':8080'])}{rng.choice(['', '/', '/en', '/en/', '/english', '/en/deep/er', '/en?q=/de#f'])}", DAY0 + dt.timedelta(rng.randint(-30, 950))) for i in range(400)]
    captures += [(500, None, DAY0), (501, "http://a.com/", None), (None, "http://a.com/", DAY0), (502, "not a url", DAY0), (503, "", DAY0), (504, "http://a.com/" + "s/" * 5000, DAY0 + dt.timedelta(300)), captures[0], captures[0]]
    return captures, entries


@pytest.mark.parametrize(("broadcast_rows", "hot_captures"), [(100_000, U.HOT_CAPTURES), (0, U.HOT_CAPTURES), (0, 3)])
def test_matches_plain(spark, broadcast_rows, hot_captures):
    captures, entries = tables(spark)
    c = spark.createDataFrame([(*x, 1, "clash") for x in captures], "page_id long, url string, fetched date, month int, pattern string")
    e = spark.createDataFrame(entries, "pattern string, day date, listed boolean")
    got = U.filter_captures(c, e, broadcast_rows=broadcast_rows, hot_captures=hot_captures).collect()
    rows = sorted(((str(r["page_id"]), str(r["url"]), str(r["fetched"]), r["blocked"], r["pattern"], r["n_active"]) for r in got), key=str)
    assert rows == plain(captures, entries) and sum(r[3] for r in rows) > 50


def test_empty_tables(spark):
    captures, entries = tables(spark)
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    e = spark.createDataFrame(entries, "pattern string, day date, listed boolean")
    assert U.filter_captures(c.limit(0), e).count() == 0
    assert U.filter_captures(c, e.limit(0)).where("blocked").count() == 0 and U.filter_captures(c, e.limit(0)).count() == len(captures)


def test_no_python_in_the_plan_and_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    df = E.op7_url_filter(spark, sf)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    want = db.sql(f"SELECT page_id, url, fetched, blocked, pattern, n_active FROM ({E.OP7_SQL})").fetchall()
    got = [tuple(r) for r in df.select("page_id", "url", "fetched", "blocked", "pattern", "n_active").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[3] for r in got)
