import hashlib
import random

import numpy as np
import pytest

from prefixspark.llm import bwt_columns as C
from prefixspark.llm import suffix_dedup as D


def plain(texts, length):
    seen = {}
    for raw in texts:
        for i in range(len(raw) - length + 1):
            w = hashlib.blake2b(raw[i : i + length], digest_size=12).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[hashlib.blake2b(raw[i : i + length], digest_size=12).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def check(docs, texts, length=400, **more):
    pairs = texts(docs)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in D.remove_repeats(docs, length=length, **more).collect())
    want = sorted((str(i), *p) for (i, _), p in zip(pairs, plain([t.encode() for _, t in pairs], length), strict=True))
    assert got == want
    return sum(w[2] > 0 for w in want)


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_matches_plain(which, request, texts):
    assert check(request.getfixturevalue(which), texts)


@pytest.mark.parametrize("hot_runs", [D.HOT_RUNS, 2])
def test_shared_and_edited_passages(spark, texts, hot_runs):
    """One passage in many texts, near copies, periodic texts; with hot_runs 2 nearly every gram takes the distributed way."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdé ", k=n))
    passage, base, rows = letters(300), letters(1500), []
    for i in range(40):
        at = rng.randint(0, 250)
        rows.append((i, letters(rng.randint(0, 300)) + passage[at:] + letters(rng.randint(0, 300))))
    for i in range(40, 70):
        cut = rng.randint(0, 1400)
        rows.append((i, base[:cut] + letters(1) + base[cut + rng.randint(0, 2) :]))
    rows += [(70, "ab" * 700), (71, "ba" * 300), (72, base), (73, passage * 4)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string"), texts, length=128, hot_runs=hot_runs) > 30


def test_held_runs_are_cut_between_grams(spark, small_docs, monkeypatch, texts):
    monkeypatch.setattr(D, "HELD_RUNS", 5)
    assert check(small_docs.limit(60), texts)


def test_columns_match_plain_suffix_order():
    """Order and common prefixes of each column against sorted suffixes; bytes 0 and 255 are symbols like others."""
    rng = random.Random(13)
    for _ in range(30):
        n, width = rng.randint(1, 12), rng.randint(1, 14)
        symbols = rng.choice(([0, 255], [1, 2, 3], list(range(9))))
        starts = [rng.randrange(width) for _ in range(n)]
        texts = [bytes(rng.choices(symbols, k=rng.randint(0, width - s))) for s in starts]
        groups = np.array(sorted(rng.randint(0, 2) for _ in range(n)))
        order, prefix = np.arange(n), np.zeros(n, np.int32)
        for k in range(width - 1, -1, -1):
            column = np.array([t[k - s] + 1 if 0 <= k - s < len(t) else 0 for t, s in zip(texts, starts, strict=True)], np.uint16)
            order, prefix = C.next_column(column, groups.astype(np.uint16), order, prefix, 99)
            suffix = [t[k - s :] if k >= s else b"" for t, s in zip(texts, starts, strict=True)]
            here = [(groups[i], suffix[i]) for i in order]
            assert here == sorted(here)
            for i in range(1, n):
                a, b = here[i - 1], here[i]
                common = next((j for j, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
                assert prefix[i] == (common if a[0] == b[0] else 0)
        for length in (1, 3):
            got = C.repeated_windows(texts, groups, np.array(starts), length)
            for i, (t, s) in enumerate(zip(texts, starts, strict=True)):
                want = [j for j in range(len(t) - length + 1) if any(groups[m] == groups[i] and m != i and j + s >= starts[m] and texts[m][j + s - starts[m] : j + s - starts[m] + length] == t[j : j + length] for m in range(n))]
                assert got[i].tolist() == want


def test_spans():
    a, b = D.merge_spans(np.array([5, 1, 3, 20, 2]), np.array([9, 3, 5, 22, 8]))
    assert (a.tolist(), b.tolist()) == ([1, 20], [9, 22])
    assert D.kept_bytes(b"0123456789", np.array([0, 5]), np.array([2, 10])) == b"234"
    assert D.kept_bytes(b"01", a[:0], b[:0]) == b"01"


def test_empty_table(no_docs):
    assert D.remove_repeats(no_docs).count() == 0
