import random
from collections import defaultdict

import pytest

from prefixspark.llm import line_dedup as D
from pyspark.sql import functions as F


def words(line):
    return [w for w in __import__("re").split("[ \t\x0b\f\r]+", line.lower()) if w]


def near(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    i = next((i for i, a in enumerate(x) if a != y[i]), len(x))
    return x[i:] == y[i + 1 :]


def units(w, least, chars):
    """Words, or a short line's characters behind two marks."""
    joined = " ".join(w)
    return w if len(w) >= least else ("\n", "\n", *joined) if len(joined) >= chars else ()


def plain(rows, least=D.MIN_WORDS, chars=D.MIN_CHARS):
    """Dropped (equal, near) line numbers by distinct (doc_id, text); rows: (doc_id, text)."""
    first = {}
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in docs:
        for k, line in enumerate(t.split("\n")):
            if w := tuple(words(line)):
                first.setdefault(w, (i is not None, i or 0, k))
                first[w] = min(first[w], (i is not None, i or 0, k))
    by_size = defaultdict(list)
    for w in first:
        if u := units(w, least, chars):
            by_size[len(u)].append((w, u))
    gone = {w for n, ws in by_size.items() for w, u in ws if any(first[v] < first[w] and near(u, x) for m in (n - 1, n, n + 1) for v, x in by_size.get(m, ()))}
    out = {}
    for i, t in docs:
        equal, nearly = [], []
        for k, line in enumerate(t.split("\n")):
            if w := tuple(words(line)):
                if w in gone:
                    nearly.append(k)
                elif (i is not None, i or 0, k) > first[w]:
                    equal.append(k)
        out[i, t] = len(equal), len(nearly), sorted(equal + nearly)
    return out


def check(docs, texts):
    rows = texts(docs)
    want = plain(rows)
    report = sorted((str(r["doc_id"]), r["n_lines"], r["n_equal"], r["n_near"], r["n_kept"], list(r["dropped"])) for r in D.line_report(docs).collect())
    expected = sorted((str(i), t.count("\n") + 1, *want[i, t][:2], t.count("\n") + 1 - sum(want[i, t][:2]), want[i, t][2]) for i, t in rows)
    assert report == expected
    cut = D.dedup_lines(docs)
    assert cut.columns == docs.columns
    rebuilt = sorted((str(i), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(want[i, t][2]))) for i, t in rows)
    assert sorted((str(i), t) for i, t in texts(cut)) == rebuilt
    return want


def test_small_documents(small_docs, texts):
    assert any(n for _, n, _ in check(small_docs, texts).values())


def test_odd_rows(odd_docs, texts):
    check(odd_docs.where("doc_id IS NULL OR doc_id <> 2"), texts)
    assert D.dedup_lines(odd_docs).where("doc_id = 4").first()["text"] is None


def test_edits_of_every_kind(spark, texts):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)]
    rows, base = [], [rng.choices(vocabulary, k=n) for n in (6, 7, 8, 9, 12, 12, 30)] + [["same"] * 12]
    for i in range(90):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1, 1])] = rng.choice([[], ["new"], [rng.choice(vocabulary)]])
            lines.append(rng.choice([" ", "  ", "\t"]).join(rng.choice([x, x.upper()]) for x in w))
        rows.append((i, "\n".join([*lines, "", "  "])))
    want = check(spark.createDataFrame(rows, "doc_id long, text string"), texts)
    assert sum(n for _, n, _ in want.values()) > 30


def test_hot_lines_meet_their_verdict_by_broadcast(spark, small_docs, texts, monkeypatch):
    monkeypatch.setattr(D, "HOT_LINE", 2)
    check(small_docs, texts)


def test_a_template_with_very_many_fillings(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four page "), "id", F.lit(" six seven eight nine ten")).alias("text"))
    rows = D.line_report(docs).agg(F.sum("n_near"), F.sum("n_equal")).first()
    assert tuple(rows) == (2999, 0)


@pytest.mark.parametrize(("x", "y", "want"), [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a b", True), ("a b c", "b c", True), ("a b c", "c b a", False), ("a b c d", "b c d a", False), ("a a b", "a b", True), ("a", "b", True), ("a b c", "a", False)])
def test_one_word_apart(spark, x, y, want):
    row = spark.createDataFrame([(x.split(), y.split())], "x array<string>, y array<string>").select(D.one_word_apart(F.col("x"), F.col("y")).alias("v"), D.one_word_apart(F.col("y"), F.col("x")).alias("w")).first()
    assert (row["v"], row["w"]) == (want, want)


def test_short_lines_by_characters(spark, texts):
    rng = random.Random(12)
    base = ["all content copyright of its owner", "Subscribe to our newsletter today!", "the quick brown fox jumped over", "abcdefghijklmnopqrstuvwxyz", "page 12", "one two three four five six se7en"]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(4):
            c = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(c))
                c[k : k + rng.choice([0, 1, 1])] = rng.choice([[], ["x"], ["é"], ["\U0001f600"]])
            lines.append("".join(c))
        rows.append((i, "\n".join(lines)))
    rows += [(200, " ".join("abcdefghijklmnopqrstuvwxyz")), (201, "page 13")]  # the same units but for the marks; too short
    want = check(spark.createDataFrame(rows, "doc_id long, text string"), texts)
    assert sum(n for _, n, _ in want.values()) > 30 and want[200, rows[-2][1]][1] == 0


def test_a_collision_hides_no_true_partner(spark, monkeypatch):
    """All hashes of (unit, place) are made one of four, so that most keys collide."""
    rows = [(i, f"a b c d e f g h {'x' * (i % 3 + 1)} {i % 7}") for i in range(40)] + [(100 + i, f"k l m n o p q r s{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    real = F.xxhash64
    monkeypatch.setattr(D.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(4)) if len(c) == 2 and isinstance(c[0], str) and c[0] == "word" else real(*c))
    got = {r["doc_id"]: r["n_near"] for r in D.line_report(docs).collect()}
    assert got == {i: want[i, t][1] for i, t in rows} and sum(got.values()) > 20


def test_columns_whose_names_clash(spark, texts):
    names = ["doc_id", "text", "_lines", "_d_t", "_dropped", "_d_id", "lines", "d_id", "d_t", "dropped", "t", "pos", "h1", "words", "a.b"]
    line = "one two three four five six seven eight"
    docs = spark.createDataFrame([(i, f"{line}\nof {i}", *([i] * (len(names) - 2))) for i in range(3)], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    cut = D.dedup_lines(docs)
    assert cut.columns == names and sorted(map(tuple, cut.collect())) == [(0, f"{line}\nof 0", *[0] * 13), (1, "of 1", *[1] * 13), (2, "of 2", *[2] * 13)]


def test_no_python_in_the_plan(small_docs):
    assert not any(x in D.line_report(small_docs)._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_empty_table(no_docs):
    assert D.line_report(no_docs).count() == 0 and D.dedup_lines(no_docs).count() == 0
