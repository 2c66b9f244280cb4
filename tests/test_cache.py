import random

import pytest

from prefixspark.errors import CacheCapacityExceeded, InvalidParameter
from prefixspark.operators import cache as C
from prefixspark.schemas import CACHE_OPS


def test_longest_prefix_of_tokens(spark):
    stored = spark.createDataFrame([(0, [1, 2, 3], 9), (1, [1, 2, 3], 10), (2, [1, 2, 3, 4, 5], 20)], "seq INT, tokens ARRAY<BIGINT>, kv_offset BIGINT")
    asked = spark.createDataFrame([(0, [1, 2, 3, 4, 5, 6]), (1, [1, 2, 3, 8]), (2, [9, 9]), (3, []), (4, [1, 2])], "query_id BIGINT, tokens ARRAY<BIGINT>")
    rows = C.match_prefix(C.latest(stored), asked).orderBy("query_id").collect()
    assert [(r["token_len"], r["kv_offset"]) for r in rows] == [(5, 20), (3, 10), (None, None), (None, None), (None, None)]
    assert C.match_prefix(C.latest(stored).limit(0), asked).where("kv_offset IS NOT NULL").count() == 0


def test_machine():
    c = C.ClockCache(4096)
    c.insert([1, 2, 3], 10)
    c.insert([1, 2, 3, 4, 5], 20)
    assert c.match([1, 2, 3, 4, 5, 6]) == (5, 20) and c.match([1, 2, 3, 8]) == (3, 10) and c.match([9, 9]) is None and c.match([]) is None
    for bad in (([], 1), ([1], 0)):
        with pytest.raises(InvalidParameter):
            c.insert(*bad)
    for capacity in (100, 4097):
        with pytest.raises(InvalidParameter):
            C.ClockCache(capacity)


def test_stale_entries_go_and_come_back():
    c = C.ClockCache(4096)
    c.insert([1, 2], 5)
    assert (c.evict_step(c.grid), c.evict_step(c.grid)) == (0, 1)
    assert c.match([1, 2, 3]) is None
    c.insert([1, 2], 6)
    assert c.match([1, 2, 3]) == (2, 6)


def test_touch_saves_for_one_pass():
    c = C.ClockCache(4096)
    c.insert([1], 5)
    c.evict_step(c.grid)
    assert c.match([1]) == (1, 5)
    assert c.evict_step(c.grid) == 0 and c.evict_step(c.grid) == 1


def test_full_cache_makes_room_by_eviction():
    c = C.ClockCache(4096)
    for i in range(83):
        c.insert([i], i + 1)
    assert len(c.live) == 83
    c.insert([250], 1234)
    assert c.match([250]) == (1, 1234)
    c.evict_step(c.grid)  # a sweep before a full insert doesn't make it fail
    for i in range(300, 383):
        c.insert([i], 1)
    assert len(c.live) <= 83


def test_hand_stops_at_the_end_of_the_grid():
    c = C.ClockCache(4096)
    c.evict_step(500)
    assert c.hand == 500 and c.evict_step(100) == 0 and c.hand == 0


def test_aliased_slots_answer_for_their_owner_only():
    c = C.ClockCache(4096)
    c.insert([1, 2], 5)
    c.evict_step(c.grid)
    c.evict_step(c.grid)
    c.insert([7], 9)  # takes the slot
    assert c.match([1, 2]) is None and c.match([7]) == (1, 9)


def test_no_room_is_an_error():
    c = C.ClockCache(4096)
    c.chunks = 1
    with pytest.raises(CacheCapacityExceeded):
        c.insert([1], 1)


def test_batch_form_matches_a_state_machine(spark):
    rng, rows, want = random.Random(1), [], {}
    for slot in range(60):
        inserted = mark = None
        for seq in range(40):
            kind = rng.choices(["insert", "touch", "pass"], [1, 3, 4])[0]
            rows.append((slot, seq, kind))
            if kind == "insert":
                inserted, mark = seq, 1
                want[slot, inserted] = None
            elif inserted is None or want[slot, inserted] is not None:
                continue
            elif kind == "touch":
                mark = 1
            elif mark:
                mark = 0
            else:
                want[slot, inserted] = seq
    got = C.clock_batch(spark.createDataFrame(rows, "slot INT, seq INT, kind STRING")).collect()
    assert {(r["slot"], r["inserted"]): r["evicted"] for r in got} == want


def test_replay_by_cache(spark):
    rows = [(0, 0, "insert", [1, 2], 5, None), (0, 1, "match", [1, 2, 3], None, None), (0, 2, "sweep", None, None, 512), (0, 3, "sweep", None, None, 512), (0, 4, "match", [1, 2], None, None), (1, 0, "match", [1, 2], None, None)]
    ops = spark.createDataFrame(rows, f"cache_id BIGINT, {CACHE_OPS}")
    got = {(r["cache_id"], r["seq"]): (r["token_len"], r["kv_offset"], r["evicted"]) for r in C.replay(ops, 4096).collect()}
    assert got == {(0, 0): (None, None, None), (0, 1): (2, 5, None), (0, 2): (None, None, 0), (0, 3): (None, None, 1), (0, 4): (None, None, None), (1, 0): (None, None, None)}


def test_names_that_clash(spark):
    names = ["q", "best", "k", "h", "p", "lengths", "_q"]
    asked = spark.createDataFrame([([1, 2, 3], *range(7))], "tokens ARRAY<BIGINT>, " + ", ".join(f"{n} INT" for n in names))
    stored = spark.createDataFrame([([1, 2], 5)], "tokens ARRAY<BIGINT>, kv_offset BIGINT")
    found = C.match_prefix(stored, asked)
    assert found.columns == ["tokens", *names, "token_len", "kv_offset"] and tuple(found.first())[1:] == (*range(7), 2, 5)
