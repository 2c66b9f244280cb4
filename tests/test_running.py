import random

import pytest

from prefixspark.operators import running


@pytest.mark.parametrize("rows", [3, 7, 1000])
def test_sums_and_previous_rows_over_ranges(spark, rows):
    """Groups of very different sizes, a null group, and columns with the names of inner ones, cut into many ranges or none."""
    rng = random.Random(rows)
    data = [(rng.choice(["a", "a", "a", "b", None]), i * 3 - 50, rng.randint(0, 9), i) for i in range(60)] + [("c", 10_000, 5, 0)]
    df = spark.createDataFrame(data, "g string, at bigint, v int, range int").repartition(5)
    got = {(r["g"], r["at"]): r for r in running.row_before(running.sum_before(df, df["v"], "g", "at", "total", rows), ["at", "v"], "g", "at", "last", rows).collect()}
    assert len(got) == len(data)
    total, last = {}, {}
    for g, at, v, n in sorted(data, key=lambda r: r[1]):
        r = got[g, at]
        assert (r["total"], r["range"]) == (total.get(g, 0), n) and (tuple(r["last"]) if r["last"] else None) == last.get(g)
        total[g], last[g] = total.get(g, 0) + v, (at, v)


@pytest.mark.parametrize("rows", [4, 1000])
def test_without_groups(spark, rows):
    df = spark.createDataFrame([(i * i, i) for i in range(30)], "k bigint, v int").repartition(4)
    got = [(r["k"], r["n"], r["last"] and r["last"]["v"]) for r in running.row_before(running.sum_before(df, running.F.lit(1), None, "k", "n", rows), ["v"], None, "k", "last", rows).orderBy("k").collect()]
    assert got == [(i * i, i, i - 1 if i else None) for i in range(30)]


def test_no_task_sees_a_whole_group(spark):
    df = spark.range(5000).selectExpr("'one' AS g", "id", "1 AS v")
    at = running.range_of(df, running.F.col("id"), 100)
    sizes = [r["count"] for r in df.groupBy(at.alias("r")).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 300


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, k bigint, v int")
    assert running.sum_before(df, df["v"], "g", "k", "n").count() == 0 == running.row_before(df, ["v"], "g", "k", "p").count()
