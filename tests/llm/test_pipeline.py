"""The pipeline's stages: columns, decisions, odd rows, and a whole run against plain versions of its stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from prefixspark.llm.packing import TOKENIZER, tokenizer

from .test_decontaminate import plain_matches
from .test_line_dedup import plain as plain_lines
from .test_quality_rules import plain as plain_quality
from .test_simhash_dedup import plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, edited copies, benchmark passages and junk, beside clean ones."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(n // 12))
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(4)]
    rows = [(i, prose(rng.randint(24, 240))) for i in range(60)]
    copies = [(100 + i, rows[i][1]) for i in range(5)]
    edited = []
    for i in range(5):  # lines are cut otherwise, so the words are alike but the lines are not
        words = rows[10 + i][1].split()
        words[0] = "changed"
        edited.append((200 + i, "\n".join(" ".join(words[j : j + 17]) for j in range(0, len(words), 17))))
    leaks = [(300 + i, f"{prose(60)}\n{items[i % 4][1]}\n{prose(60)}") for i in range(6)]
    junk = [(400 + i, "too short") for i in range(5)] + [(410, "again and again and " * 40)]
    every = [(i, t, "en", f"s{i % 3}.org", len(t)) for i, t in (*rows, *copies, *edited, *leaks, *junk)] + [(500, None, None, None, None), (None, rows[3][1] + prose(60), "en", "s1.org", 3)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def plain_run(rows, items):
    """(doc_id, text) after the four filtering stages."""
    rows = [(i, t or "") for i, t in rows]
    ok = lambda t: (q := plain_quality(t))[0] >= 10 and 100 * q[4] <= 20 * q[0]  # noqa: E731  (no host is bad here)
    rows = [(i, t) for i, t in rows if i is None or ok(t)]
    gone = plain_lines(rows)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i, t][2]))) for i, t in rows]
    rows = [(i, t) for (i, t), c in zip(rows, plain_groups(rows), strict=True) if i is None or c is None or i == c]
    return [(i, t) for i, t in rows if i is None or not plain_matches(t, items)]


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        out.append((name, docs))
    return out


def test_stages_keep_columns_and_clean_documents(spark, folder):
    done = dict(stages(spark, folder))
    assert list(done) == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in done.items()}
    assert all(done[n].columns == COLUMNS for n in list(done)[:-1])
    clean = set(range(60))
    assert clean <= ids["quality"] and not ids["quality"] & {400, 401, 402, 403, 404, 410, 500}
    assert ids["lines"] == ids["quality"]  # texts shrink, documents stay
    assert clean <= ids["near_duplicates"] and not ids["near_duplicates"] & set(range(200, 205))
    assert clean <= ids["decontamination"] and not ids["decontamination"] & set(range(300, 304))  # the last two lost the passage as a repeated line


def test_run_matches_plain(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    encode = tokenizer(TOKENIZER).encode_ordinary
    want = sorted((str(i), len(encode(t))) for i, t in plain_run(rows, items))
    got = sorted((str(r["doc_id"]), r["n"]) for r in P.run(spark, folder).groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect())
    assert got == want


def test_a_document_of_a_null_id_stays(spark, folder):
    assert all(df.where("doc_id IS NULL").count() >= 1 for _, df in stages(spark, folder))


def test_odd_and_empty_tables(spark, folder, odd_docs, no_docs):
    extra = ["h1", "fp", "pattern", "host", "_row_key", "row_key", "_rejected", "r", "a.b"]
    wider = lambda df: df.select("*", *(F.lit(7).alias(c) for c in extra[4:])).select(*COLUMNS, *(f"`{c}`" for c in extra))
    for docs in (wider(odd_docs), wider(no_docs)):
        for name, stage in P.STAGES:
            docs = stage(spark, docs, folder)
            if name != "packing":
                assert docs.columns == [*COLUMNS, *extra] and docs.where("_rejected <> 7 OR row_key <> 7").isEmpty()
        assert docs.where("n_tokens < 0").count() == 0


def test_lines_without_a_count_of_characters(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars")
    assert P.lines(spark, docs, folder).columns == docs.columns


def test_verdicts_hold_for_rows_whose_ids_are_null_or_repeat(spark, folder):
    rng = random.Random(22)
    prose = lambda n: " ".join("".join(rng.choices("ijklmnop", k=6)) for _ in range(n))
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    a, b, c, d, e, f, leak, short_leak = *(prose(60) for _ in range(6)), f"{prose(30)} {passage} {prose(30)}", " ".join(passage.split()[:36])
    edited = f"{c} with words"  # similar to c
    rows = [(None, "junk"), (None, leak), (None, a), (None, a), (1, a), (2, b), (2, b), (2, b), (None, c), (None, edited)]
    rows += [(3, d), (3, "junk"), (4, e), (4, leak), (5, f), (5, a), (6, short_leak)]
    docs = spark.createDataFrame([(i, t, "en", "s.org", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    held = lambda *rows: sorted(rows, key=str)
    assert told(P.quality(spark, docs, folder)) == held(*(r for r in rows if r[1] != "junk"))
    assert told(P.decontamination(spark, docs, folder)) == held(*(r for r in rows if r[1] not in (leak, short_leak)))
    near = told(P.near_duplicates(spark, docs, folder))
    assert [r for r in near if r[1] not in (c, edited)] == held((1, a), (2, b), (3, d), (3, "junk"), (4, e), (4, leak), (5, f), (6, short_leak))
    assert sum(r[1] in (c, edited) for r in near) == 1
    done = docs
    for _, stage in P.STAGES[:-1]:
        done = stage(spark, done, folder)
    # of the copies the first in line order keeps its lines; n exact repeats are one row
    texts = [t for _, t in told(done)]
    assert sorted(t for t in texts if t) == sorted((a, b, c if c in texts else edited, d, e, f))
    assert P.pack(spark, done, folder).where("n_tokens > 0").count() == 6
