import random
import re

import numpy as np
import pytest
import xxhash

from prefixspark.llm import simhash_dedup as D


def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_matches_plain(which, request, texts):
    docs = request.getfixturevalue(which)
    pairs = texts(docs)
    ids, fps = [i for i, _ in pairs], [plain_fingerprint(t) for _, t in pairs]
    of = plain_components(fps, 4)
    least = {c: min((i for i, x in zip(ids, of, strict=True) if x == c and i is not None), default=None) for c in of}
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in D.near_duplicates(docs).collect())
    assert got == sorted((str(i), f"{fp:016x}", str(least[c])) for i, fp, c in zip(ids, fps, of, strict=True))


def test_links_over_many_blocks(spark, monkeypatch):
    """Chains and hubs whose members have different population counts, in blocks far below a group's size."""
    monkeypatch.setattr(D, "BLOCK_ROWS", 40)
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(40):
            fps.add(fp)
            for b in rng.sample(range(64), 3):
                fp ^= 1 << b
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(x, [x]) for x in fps], "node long, words array<long>").repartition(4)
    got = {r["node"]: r["label"] for r in D.star_components(D.link_fingerprints(df, 4)).collect()}
    want = plain_components([x & (2**64 - 1) for x in fps], 4)
    assert [got.get(x, x) for x in fps] == [fps[c] for c in want]


def test_forest_is_small():
    rng = random.Random(6)
    hub = rng.getrandbits(64)
    group = np.array(sorted({hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}), np.uint64)[:, None]
    u, _ = D.block_links(group, None, 4, most=10_000)
    assert len(u) == len(group) - 1  # 2 million links, one tree


def plain_groups(pairs, k=5, t=0.8):
    sets = []
    for _, text in pairs:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(pairs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])) or not (sets[i] or sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(pairs))]


def check_groups(docs, texts):
    pairs = texts(docs)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in D.similar_groups(docs).collect())
    assert got == sorted((str(i), str(c)) for (i, _), c in zip(pairs, plain_groups(pairs), strict=True))
    return sum(a != b for a, b in got)


def test_similar_groups_match_plain(small_docs, odd_docs, texts):
    assert check_groups(small_docs, texts) > 5
    check_groups(odd_docs, texts)


def test_texts_of_null_ids_are_compared(spark, texts):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "more"])), (5, " ".join(["first", *words])), (None, " ".join(words[::-1])), (6, "else")]
    assert check_groups(spark.createDataFrame(rows, "doc_id long, text string"), texts) == 2


def test_chains_and_stars_in_one_large_group(spark, monkeypatch):
    """Members that the hub doesn't reach: each shares four fifths with the next only."""
    monkeypatch.setattr(D, "VERIFY_ROWS", 5)
    chain = [(i, 1, " ".join(f"w{j}" for j in range(i * 4, i * 4 + 60))) for i in range(30)]
    star = [(100 + i, 1, " ".join([*(f"v{j}" for j in range(80)), f"x{i}"])) for i in range(25)]
    apart = [(200 + i, 1, " ".join(f"y{i}z{j}" for j in range(40))) for i in range(8)]
    texts = spark.createDataFrame([*chain, *star, *apart], "node long, label long, text string")
    links = [tuple(r) for r in D.verified_links(texts, 0.8, 5).collect()]
    sets = {n: D.shingle_set(t, 5)[1] for n, _, t in (*chain, *star, *apart)}
    assert all(len(set(sets[u]) & set(sets[v])) >= 0.8 * len(set(sets[u]) | set(sets[v])) - 1e-6 or u == v or (u // 100 == v // 100 < 2) for u, v in links)
    nodes = sorted(sets)
    label = D.components(len(nodes), D.np.array([nodes.index(u) for u, _ in links]), D.np.array([nodes.index(v) for _, v in links]))
    assert sorted(D.np.unique(label, return_counts=True)[1].tolist()) == [1] * 8 + [25, 30]

def test_large_groups_of_edited_copies(spark, texts, monkeypatch):
    monkeypatch.setattr(D, "VERIFY_ROWS", 20)  # so that a group has many verification jobs
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.randint(40, 200))
        for _ in range(rng.choice([3, 90])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    assert check_groups(spark.createDataFrame(rows, "doc_id long, text string"), texts) > 50


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = rng.choice(2000, n, replace=False)
        y = np.concatenate([x[: n - int(rng.integers(0, n // 4 + 1))], 2000 + rng.choice(50, int(rng.integers(0, n // 4 + 1)), replace=False)])
        if (shared := len(np.intersect1d(x, y))) >= 0.8 * (len(x) + len(y) - shared) - 1e-9:
            frequent = np.sort(rng.choice(2000, int(rng.integers(0, 1500)), replace=False)).astype(np.uint64)
            a, b = (D.first_shingles(np.sort(z).astype(np.uint64), 0.8, frequent) for z in (x, y))
            assert len(np.intersect1d(a, b)) and len(a) <= 0.2 * len(x) + 1


def test_lists_of_all_lengths_give_the_links(spark, texts, monkeypatch):
    """Pairs, longer lists and lists in parts; texts that share no shingle are not compared."""
    monkeypatch.setattr(D, "LIST_ROWS", 4)
    monkeypatch.setattr(D, "ORDER_SHARE", 1)
    monkeypatch.setattr(D, "link_fingerprints", None)  # all with all
    rng = random.Random(8)
    rows = []
    for size in (1, 2, 3, 4, 9, 30):
        words = [f"g{size}w{j}" for j in range(120)]
        for _ in range(size):
            copy = list(words)
            copy[rng.randrange(120)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join([*(f"common{j}" for j in range(30)), *(f"own{i}w{j}" for j in range(40))])) for i in range(20)]
    rng.shuffle(rows)
    assert check_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), texts) == 1 + 2 + 3 + 8 + 29


def test_empty_table(no_docs):
    assert D.near_duplicates(no_docs).count() == 0
