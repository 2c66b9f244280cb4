import re
from collections import Counter

import duckdb
import pytest

from prefixspark.llm import entries as E
from prefixspark.llm import quality_rules as Q


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_matches_plain(which, request, texts):
    docs = request.getfixturevalue(which)
    rows = Q.apply_rules(docs).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    want = [(str(i), *(p := plain(t)), p[0] < 10 or 100 * p[4] > 20 * p[0]) for i, t in texts(docs)]
    assert got == sorted(want)
    assert all(r["kept"] in (True, False) and not (r["base_failed"] and r["kept"]) and (r["kept"] or r["base_failed"] or r["soft_failed"]) for r in rows)


def hosts(spark):
    junk, clean = "### $$$ %%% &&& *** ||| <<< >>> one two three four", "these are ten quite ordinary words that say very little"
    soft = "word ### a &&& b *** c $$$ d %%% e ||| f <<< g"
    rows = [(i, junk, "bad.org") for i in range(80)] + [(100 + i, clean, "bad.org") for i in range(20)]
    rows += [(200 + i, clean, "good.org") for i in range(90)] + [(300 + i, soft, "good.org") for i in range(10)] + [(400, clean, "tiny.org"), (401, clean, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdict_reaches_documents(spark):
    got = {r["doc_id"]: r for r in Q.apply_rules(hosts(spark)).collect()}
    assert got[0]["host_bad"] and not got[0]["kept"]
    assert all(got[100 + i]["kept"] for i in range(20))  # clean documents of a bad host stay
    assert all(got[300 + i]["soft_failed"] and got[300 + i]["kept"] for i in range(10))  # soft failures of a good host stay
    assert got[400]["kept"] and got[401]["kept"]
    assert 0 < got[400]["host_rate"] < 0.9  # one document says little: the prior's mean pulls


def test_the_host_verdict_changes_what_is_kept(spark):
    """The same soft failures: kept on a good host, rejected on a bad one; hosts by domain, from URLs."""
    clean, soft = "these are ten quite ordinary words that say very little", "word ### a &&& b *** c $$$ d %%% e ||| f <<< g"
    rows = [(i, soft, f"https://www.Bad.org/{i}") for i in range(70)] + [(100 + i, clean, f"http://u@bad.org:80/{i}?q") for i in range(30)]
    rows += [(200 + i, soft, "https://good.org/") for i in range(5)] + [(300 + i, clean, "https://good.org/x") for i in range(95)] + [(400, soft, "plain name")]
    got = {r["doc_id"]: r for r in Q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, url string"), host_col="url").collect()}
    assert {r["host"] for r in got.values()} == {"bad.org", "good.org", "plain name"}
    assert not any(got[i]["base_failed"] for i in got) and not any(got[i]["kept"] for i in range(70))
    assert all(got[i]["kept"] for i in got if i >= 100)


def test_shuffled_way_agrees(spark, monkeypatch):
    one = sorted(map(tuple, Q.apply_rules(hosts(spark)).collect()))
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, Q.apply_rules(hosts(spark)).collect())) == one


def test_sql_agrees(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    df = E.op5_quality_rules(spark, "/root/testdata/sf0.01")
    columns = sorted(df.columns)
    assert columns == sorted(db.sql(E.OP5_SQL).columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({E.OP5_SQL})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_empty_table(no_docs):
    assert Q.apply_rules(no_docs).count() == 0
