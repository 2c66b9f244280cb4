import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from prefixspark.llm import lm_score as L


def plain_words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_base_score_matches_plain(which, request, texts):
    docs = request.getfixturevalue(which)
    every = [(i, plain_words(t) + ["END"]) for i, t in texts(docs)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in every if not held(i) for w in ws)
    n, v = c.total(), len(c)
    want = sorted((str(i), held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in every)
    # a head of few words, so that the join has its part
    rows = L.score_documents(docs, p_symbol=1e-3, p_context=1e-2).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def brute_tree(texts, n_symbols, depth, p_symbol, p_context, z):
    """Contexts, their next counts and the verdicts, with dictionaries."""
    total = sum(map(len, texts))
    uni = Counter(x for t in texts for x in t)
    p0 = {s: (uni[s] + 0.1) / (total + 0.1 * n_symbols) for s in range(n_symbols)}
    nxt = defaultdict(Counter)
    for t in texts:
        s = (L.END, *t)
        for i in range(1, len(s)):
            for d in range(1, min(depth, i) + 1):
                nxt[s[i - d : i]][s[i]] += 1
    least = max(p_context * total, 1)
    count = lambda ctx: uni[ctx[0]] if len(ctx) == 1 else nxt[ctx[:-1]][ctx[-1]]
    levels = [[(s,) for s in range(L.END, n_symbols) if uni[s] >= least]]
    for _ in range(depth - 1):
        levels.append([(*c, x) for c in levels[-1] for x in nxt[c] if x >= 2 and nxt[c][x] >= least and (*c, x)[1:] in levels[-1]])
    kept = {}
    for level in levels:
        for c in level:
            n = count(c)
            below = {s: uni[s] / total for s in range(n_symbols) if uni[s]} if len(c) == 1 else {s: k / count(c[1:]) for s, k in nxt[c[1:]].items()}
            expected = {s: q for s, q in below.items() if n * q >= 5}
            g = sum(nxt[c][s] * math.log(nxt[c][s] / (n * q)) for s, q in expected.items() if nxt[c][s])
            rest, rest_e = n - sum(nxt[c][s] for s in expected), n * (1 - sum(expected.values()))
            g = 2 * (g + (rest * math.log(rest / rest_e) if rest > 1e-9 and rest_e > 1e-9 else 0))
            if expected and g > len(expected) + z * math.sqrt(2 * len(expected)):
                kept[c] = {s: k for s, k in nxt[c].items() if k >= max(p_symbol * total, 2)}, sum(nxt[c].values()), len(nxt[c])

    def prob(history, s):
        p = p0[s]
        for d in range(1, depth + 1):
            if len(history) >= d and (c := tuple(history[-d:])) in kept:
                stored, n, k = kept[c]
                p = (stored.get(s, 0) + max(n - sum(stored.values()) + k, 1) * p) / max(n + k, 1)
        return p

    return kept, prob


@pytest.mark.parametrize("counted", [L.COUNTED, 40])
def test_tree_matches_brute_force(spark, monkeypatch, counted):
    monkeypatch.setattr(L, "COUNTED", counted)
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(120):
        t = [2]
        for _ in range(60):
            t.append(int((t[-1] * 3 + (t[-2] if len(t) > 1 else 0)) % 5 + 2 if rng.random() < 0.7 else rng.integers(0, 9)))
            t[-1] = 0 if t[-1] == 1 else t[-1]
        texts.append((*t, L.END))
    n = 9
    uni = np.bincount([x for t in texts for x in t], minlength=n)
    coded = spark.createDataFrame([(i, False, bytearray(np.array(t, np.int32).tobytes())) for i, t in enumerate(texts)], "rid long, held_out boolean, symbols binary")
    args = dict(depth=3, p_symbol=1e-3, p_context=5e-3, z=4.0)
    tree = L.build_tree(coded, uni[1:], int(uni[0]), int(uni.sum()), **args)
    kept, prob = brute_tree(texts, n, **args)
    assert len(tree.levels) == 3 and len(kept) == sum(int(level["kept"].sum()) for level in tree.levels) > 5
    for t in texts[:10]:
        s = (L.END, *t)
        want = [math.log10(prob(s[:i], s[i])) for i in range(1, len(s))]
        assert np.allclose(tree.log10(np.array(s, np.int64)), want)
    for history in [(L.END,), (L.END, 2), (L.END, 4, 3), (L.END, 5, 2, 6)]:  # a distribution in every state
        assert abs(sum(10 ** tree.log10(np.array((*history, s), np.int64))[-1] for s in range(n)) - 1) < 1e-9


def test_leaves_match_brute_force(spark):
    """Trunk contexts off: every head word below the share is a leaf or none, and scores follow its pairs."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(90):
        t = [int(rng.integers(2, 40))]
        for _ in range(50):
            t.append(t[-1] % 37 + 3 if t[-1] < 20 and rng.random() < 0.6 else int(rng.choice([0, *range(2, 40)])))
        texts.append((*t, L.END))
    n = 40
    uni = np.bincount([x for t in texts for x in t], minlength=n)
    held = [i % 9 == 0 for i in range(90)]
    n_symbol = np.bincount([x for t, h in zip(texts, held, strict=True) if not h for x in t], minlength=n)
    total = int(n_symbol.sum())
    coded = spark.createDataFrame([(i, h, bytearray(np.array(t, np.int32).tobytes())) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "rid long, held_out boolean, symbols binary")
    tree = L.Tree((uni + 0.1) / (uni.sum() + 4))
    stored = {r["key"]: r["n"] for r in L.grow_leaves(tree, coded, n_symbol.astype(float), total, 1.0, 60).collect()}
    pairs = Counter((a, b) for t, h in zip(texts, held, strict=True) if not h for a, b in zip((L.END, *t), t, strict=False) if a > L.END and n_symbol[a] >= 60)
    assert stored == {(a << 32) | b: k for (a, b), k in pairs.items() if k > 1}
    kept = set()
    for a in range(2, n):
        if n_symbol[a] >= 60:
            e = {b: n_symbol[a] * tree.unigram[b] for b in range(n)}
            if any(k > e[b] and k * math.log(k / e[b]) - k + e[b] > -math.log(L.RARE) for (x, b), k in pairs.items() if x == a):
                kept.add(a)
    assert kept == set(np.flatnonzero(tree.leaf_total).tolist()) and 3 < len(kept) < n - 2
    for a in kept:  # a distribution in every leaf, with the gains of its table
        of = {b: k for (x, b), k in pairs.items() if x == a}
        full, types, some = sum(of.values()), len(of), sum(k for k in of.values() if k > 1)
        p = [10 ** (tree.log10(np.array([a, b], np.int64))[0] + (math.log10(1 + of[b] / (tree.leaf_low[a] * tree.unigram[b])) if of.get(b, 0) > 1 else 0)) for b in range(n)]
        want = [((of[b] if of.get(b, 0) > 1 else 0) + (full - some + types) * tree.unigram[b]) / (full + types) for b in range(n)]
        assert np.allclose(p, want) and abs(sum(p) - 1) < 1e-9


def test_leaf_gains_reach_the_score(spark):
    """Pairs of words below the trunk's share: the score of a whole table is that of the trunk's tree plus the leaves'."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        w = []
        while len(w) < 60:
            a = int(rng.integers(300))
            w += [f"a{a}", f"b{a}"]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with_leaves, without = ({r["doc_id"]: r["score"] for r in L.score_documents(docs, p_context=0.5, least=n).where("held_out").collect()} for n in (20, 10**9))
    gained = sum(with_leaves.values()) - sum(without.values())
    assert gained / (61 * len(without)) > 0.5
    c = Counter(x for i, t in rows if not L.is_held_out(i) for x in zip(t.split(), [*t.split()[1:], "END"], strict=True))
    uni = Counter(x for i, t in rows if not L.is_held_out(i) for x in [*t.split(), "END"])
    total, types = uni.total(), len(uni)
    p0 = lambda x: (uni[x] + 0.1) / (total + 0.1 * (types + 1))
    want = 0.0
    for i, t in rows:
        if i not in without:
            continue
        prev = None
        for x in [*t.split(), "END"]:
            p = p0(x)
            if prev is not None and prev[0] == "a":  # words "b" are followed at random and are no leaves
                of = {y: k for (a, y), k in c.items() if a == prev}
                stored = sum(k for k in of.values() if k > 1)
                p = ((of[x] if of.get(x, 0) > 1 else 0) + (sum(of.values()) - stored + len(of)) * p) / (sum(of.values()) + len(of))
            want += math.log10(p)
            prev = x
    assert sum(with_leaves.values()) == pytest.approx(want, rel=1e-6)


def test_contexts_help_on_held_out_text(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        w = [0]
        for _ in range(80):
            w.append(int((w[-1] * 7 + 3) % 50) if rng.random() < 0.8 else int(rng.integers(50)))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    out = L.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in out)
    assert out and (sum(r["score"] for r in out) - sum(r["base_score"] for r in out)) / tokens > 0.4


def test_no_training_documents(spark, no_docs):
    assert L.score_documents(no_docs).count() == 0
    held = next(i for i in range(100) if L.is_held_out(i))
    row = L.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["base_score"] == pytest.approx(0)
