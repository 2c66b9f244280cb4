from prefixspark.__main__ import arguments, run
from prefixspark.operators import audit


def test_storm(spark):
    (line,) = run(spark, arguments(["storm", "--workers", "4", "--attempts", "4000", "--keyspace", "100"]), [])
    assert line == "verified 100, lost 0, contended 300 of 4000 (7.50%)"  # all four see a new key as absent, three then meet its value


def test_contention_of_one_worker_and_of_none(spark):
    assert tuple(audit.storm_contention(audit.storm_ops(spark, 1, 50, 7)).first()) == (50, 0, 0.0)
    assert tuple(audit.storm_contention(audit.storm_ops(spark, 3, 2, 7)).first()) == (0, 0, 0.0)


def test_crash(spark):
    (line,) = run(spark, arguments(["crash", "--transactions", "64", "--survivors", "40"]), [])
    assert line == "cycle 0: 40 of 64 replayed, 40 survived, consistent=True, high water 320, log 2560 bytes"
    rows = audit.crash_cycles(spark, 5, 6, period=3).orderBy("cycle").collect()
    assert [(r["cycle"], r["replayed"], r["survived"], r["consistent"], r["high_water"]) for r in rows] == [(0, 1, 1, True, 8), (1, 2, 2, True, 16), (2, 3, 3, True, 24), (3, 1, 1, True, 8), (4, 2, 2, True, 16)]
    assert audit.crash_cycles(spark, 0).count() == 0


def test_pressure(spark):
    (line,) = run(spark, arguments(["pressure", "--arena", "1MB"]), [])
    assert line == "inserted 37449, frontier 1048572 of 1048576 bytes, verified 387, slots 1328, recycled 664"


def test_repl(spark, tmp_path):
    assert run(spark, arguments(["repl", f"file://{tmp_path}", "--arena", "4KB"]), ["inspect-arena", "kv-insert abc 1", "inspect-arena", "exit"])[::2] == ["arena frontier: 0 of 4096 bytes, 4096 left", "arena frontier: 16 of 4096 bytes, 4080 left"]
