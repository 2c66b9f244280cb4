import random
from collections import Counter

import numpy as np

from prefixspark.llm import decontaminate as D
from .tests_llm_plain import low_words


def plain_matches(text, items, t=0.8):
    """Every window of every item's size, by exact similarity."""
    words, out = low_words(text), {}
    for item_id, item in items:
        iw = low_words(item or "")
        if not iw or len(iw) > len(words):
            continue
        k = min(5, len(iw))
        b = Counter(tuple(iw[i : i + k]) for i in range(len(iw) - k + 1))
        all_shingles = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        if not any(s in b for s in all_shingles):
            continue
        n = b.total()
        for a in range(len(all_shingles) - n + 1):
            s = D.weighted_similarity(Counter(all_shingles[a : a + n]), b)
            if s >= t and (item_id not in out or s > out[item_id][0]):
                out[item_id] = s, a, len(iw)
    return out


def check(docs, bench, texts):
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = sorted((str(r["doc_id"]), r["item_id"], round(r["similarity"], 9), r["first_word"], r["n_words"]) for r in D.find_leaks(docs, bench).collect())
    want = sorted((str(i), k, round(s, 9), a, n) for i, t in texts(docs) for k, (s, a, n) in plain_matches(t, items).items())
    assert got == want
    return want


def test_small_documents(spark, small_docs, texts):
    assert check(small_docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), texts)


def test_edited_passages_and_odd_rows(spark, odd_docs, odd_rows, texts):
    rng = random.Random(8)
    base = [w for r in odd_rows[20:] for w in r[1].split()]
    items = [(i, " ".join(rng.choices(base, k=n))) for i, n in enumerate((40, 60, 12, 3, 1, 90, 60))] + [(20, None), (21, ""), (22, "zzz yyy zzz yyy zzz yyy zzz yyy zzz yyy")]
    rows = []
    for i in range(60):
        words = items[rng.choice([0, 1, 2, 3, 5, 6])][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "edited"
        rows.append((1000 + i, " ".join([*rng.choices(base, k=rng.randint(0, 80)), *words, *rng.choices(base, k=rng.randint(0, 80))])))
    rows.append((2000, "ZZZ yyy " * 30))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(check(docs, spark.createDataFrame(items, "item_id long, text string"), texts)) > 40


def test_block_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 24))) for i in range(300)]
    b = D.Benchmark(items, 16, 0.8)
    (c,) = b.classes
    fps = b.fps[c][rng.integers(0, 300, 200)]
    for _ in range(14):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    want = {(w, i) for w, i in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ b.fps[c][None]) <= 16), strict=True)}
    assert b.near(c, fps) == {(int(w), int(i)) for w, i in want} and len(want) >= 200


def test_blocks_let_few_items_pass():
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 24))) for i in range(4000)]
    b = D.Benchmark(items, 20, 0.8)
    (c,) = b.classes
    fps = rng.integers(0, 1 << 63, 50, np.uint64) * np.uint64(2) + rng.integers(0, 2, 50, np.uint64)
    met = sum(len(w) for w, _ in b.candidates(c, fps))
    assert met < 0.25 * 4000 * 50
    want = {(int(w), int(i)) for w, i in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ b.fps[c][None]) <= 20), strict=True)}
    assert b.near(c, fps) == want


def test_recall_on_planted_edits(spark):
    """1,000 items; each edited copy whose exact similarity is 0.8 or more must be found, at every rate of edits."""
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 41, 60, 90, 150])))) for i in range(1000)]
    rows, rate_of, true = [], {}, {}
    for i, (item_id, text) in enumerate(items):
        words, rate = text.split(), i % 4
        for k in rng.sample(range(len(words)), min(rate, len(words) // 30)):
            words[k] = "edited"
        rows.append((i, " ".join([*(f"v{rng.randrange(3000)}" for _ in range(20)), *words, *(f"v{rng.randrange(3000)}" for _ in range(20))])))
        edited, own = ([tuple(x[j : j + 5]) for j in range(len(x) - 4)] for x in (words, text.split()))
        rate_of[i], true[i] = rate, D.weighted_similarity(Counter(edited), Counter(own)) >= 0.8
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for rate in range(4):
        of = [i for i in true if rate_of[i] == rate and true[i]]
        assert sum((i, i) in found for i in of) >= 0.99 * len(of) and len(of) >= 50


def test_item_blocks_and_empty_tables(spark, small_docs, no_docs, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, D.find_leaks(small_docs, bench).collect()))
    monkeypatch.setattr(D, "ITEM_BLOCK", 15)
    assert sorted(map(tuple, D.find_leaks(small_docs, bench).collect())) == one
    assert D.find_leaks(no_docs, bench).count() == 0
    assert D.find_leaks(small_docs, bench.limit(0)).count() == 0


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate((60, 60, 60, 24, 12, 9, 6, 5, 3))]
    items += [(9, "again and again and " * 12), (3, items[4][1] + " one more")]  # shingles that repeat, and an id of two texts
    rows = [(1, " ".join(items[0][1].split()[:55]))]  # 51 of 56 shingles
    for i, (_, item) in enumerate(items):
        words = item.split()
        for cut in range(min(len(words), 16)):
            a = rng.randint(0, cut)
            part = words[a : len(words) - cut + a]
            rows.append((100 + 20 * i + cut, " ".join(part)))
            part = list(part)
            part[rng.randrange(len(part))] = "edited"
            rows.append((1000 + 20 * i + cut, " ".join(part)))
    want = {}
    for doc_id, text in rows:
        words = text.split()
        for item_id, item in items:
            iw = item.split()
            k = min(5, len(iw))
            b = Counter(tuple(iw[j : j + k]) for j in range(len(iw) - k + 1))
            mine = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
            if 0 < len(mine) < b.total() and (s := D.weighted_similarity(Counter(mine), b)) >= 0.8:
                want[doc_id, item_id] = max(want.get((doc_id, item_id), (0.0, 0, 0)), (round(s, 9), 0, len(words)))
    found = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    n_words = {i: len(t.split()) for i, t in rows}
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["first_word"], r["n_words"]) for r in found}
    assert len(want) > 30 and want[1, 0] == (round(51 / 56, 9), 0, 55)
    assert {key: got.get(key) for key in want} == want
    # all other rows are windows of an item's own size
    own = {(i, len(t.split())) for i, t in items}
    assert all((item_id, n) in own and n <= n_words[doc_id] for (doc_id, item_id), (_, _, n) in got.items() if (doc_id, item_id) not in want)
