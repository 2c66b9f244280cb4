import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from prefixspark.llm import packing as P


def test_bounds_are_optimal():
    rng = random.Random(7)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        bounds, padding = P.choose_bounds(np.array(lengths), np.array(counts), k)
        cost = lambda bs: sum(c * (next(b for b in bs if b >= n) - n) for n, c in zip(lengths, counts, strict=True))
        best = min(cost((*some, lengths[-1])) for r in range(min(k, len(lengths))) for some in itertools.combinations(lengths[:-1], r))
        assert padding == best == cost(bounds) and len(bounds) <= k
    assert P.choose_bounds(np.array([], np.int64), np.array([], np.int64), 3) == ([], 0)


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
@pytest.mark.parametrize("shard_rows", [50_000, 7])
def test_pieces_and_batches(which, shard_rows, request, texts, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", shard_rows)
    docs = request.getfixturevalue(which)
    rows = P.pack(docs, max_len=700, n_buckets=5, token_budget=4000).collect()
    encode = P.tokenizer(P.TOKENIZER).encode_ordinary
    want = []
    for i, t in texts(docs):
        n = len(encode(t))
        want += [(str(i), k, 700 * k, min(700, n - 700 * k)) for k in range(max(1, -(-n // 700)))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["n_tokens"]) for r in rows) == sorted(want)
    lengths, counts = np.unique([r["n_tokens"] for r in rows if r["n_tokens"]], return_counts=True)
    bounds, padding = P.choose_bounds(lengths, counts, 5)
    assert sum(r["padding"] or 0 for r in rows) == padding
    batches = defaultdict(list)
    for r in rows:
        if not r["n_tokens"]:
            assert r["bucket"] is None and r["batch"] is None
            continue
        assert r["bound"] == bounds[r["bucket"]] >= r["n_tokens"] and r["padding"] == r["bound"] - r["n_tokens"]
        batches[r["bucket"], r["batch"]].append(r["slot"])
    for (b, k), slots in batches.items():
        full = max(1, 4000 // bounds[b])
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= full
        assert len(slots) == full or (b, k + 1) not in batches  # only a bucket's last batch is short


def test_empty_table(no_docs):
    assert P.pack(no_docs).count() == 0
