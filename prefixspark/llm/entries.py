"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, lm_score, packing, quality_rules, secret_scan, simhash_dedup, suffix_dedup, url_filter
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
WITH words AS MATERIALIZED (SELECT true AS is_item, row_number() OVER () AS r, item_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
  UNION ALL SELECT false, row_number() OVER (), doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM documents),
items AS (SELECT r, id, s, least(len(ws), 5) AS k, len(ws) - least(len(ws), 5) + 1 AS n, count(*) AS m
  FROM (SELECT *, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda i: array_to_string(ws[i : i + least(len(ws), 5) - 1], ' '))) AS s FROM words WHERE is_item AND len(ws) > 0) GROUP BY r, id, s, ws),
tokens AS (SELECT r, id, n_words, place, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS five
  FROM (SELECT r, id, len(ws) AS n_words, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM words WHERE NOT is_item) WINDOW o AS (PARTITION BY r ORDER BY place)),
places AS (SELECT r, id, k, n_words, n_words - k + 1 AS h, place, array_to_string(five[1 : k], ' ') AS s FROM tokens, (SELECT DISTINCT k FROM items) WHERE place + k <= n_words),
met AS (SELECT p.r, p.id AS doc_id, i.r AS i, i.id AS item_id, s, k, n, m, h, n_words, place FROM places p JOIN items i USING (k, s)),
starts AS (SELECT *, unnest(CASE WHEN h < n THEN [0] ELSE range(greatest(0, place - n + 1), least(place, h - n) + 1) END) AS first_word FROM met),
shared AS (SELECT r, doc_id, i, item_id, k, n, h, n_words, first_word, least(count(*), m) AS in_both FROM starts GROUP BY r, doc_id, i, item_id, k, n, h, n_words, first_word, s, m),
found AS (SELECT r, doc_id, item_id, first_word, CASE WHEN h < n THEN n_words ELSE n + k - 1 END AS n_words, sum(in_both) / (least(h, n) + n - sum(in_both)) AS similarity FROM shared GROUP BY r, doc_id, i, item_id, k, n, h, shared.n_words, first_word)
SELECT doc_id, item_id, similarity::DOUBLE AS similarity, first_word::BIGINT AS first_word, n_words::BIGINT AS n_words FROM found WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, first_word) = 1
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 6))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i : i + 4]) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, range(5) r(j) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT doc_id, host, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN repeated r USING (doc_id)),
f AS (SELECT doc_id, host, n_words, word_chars, n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        100 * n_symbols > 10 * word_chars OR 100 * (len(ls) - len(list_distinct(ls))) > 30 * len(ls) AS soft_failed FROM m),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM f GROUP BY host),
moments AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) AS var, avg(1 / n) AS noise FROM hosts),
prior AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * noise > 1e-9 THEN greatest(mean * (1 - mean) / (var - mean * (1 - mean) * noise) - 1, 1.0) ELSE 20.0 END AS weight FROM moments),
rates AS (SELECT host, n + weight AS size, (bad + mean * weight) / (n + weight) AS rate FROM hosts, prior),
verdicts AS (SELECT host, rate, rate - 1.64 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5 AS host_bad FROM rates)
SELECT f.*, round(v.rate, 6) AS host_rate, host_bad, NOT base_failed AND NOT (host_bad AND soft_failed) AS kept FROM f JOIN verdicts v ON f.host IS NOT DISTINCT FROM v.host
"""


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def _md5_number(text, at: int):
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def capture_table(pages: DataFrame) -> DataFrame:
    """The pages as captures. The table holds no fetch time; one follows from the URL's md5, within 730 days."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), _md5_number(F.col("url"), 1) % 730).alias("fetched"))


def list_table(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' hosts, by a fixed rule on the host's md5: a third of the hosts is listed on some day, half
    of those are taken off later, and a third of all has its path /en listed."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    n, day = _md5_number(F.col("host"), 1), F.date_add(F.lit("2023-01-01").cast("date"), _md5_number(F.col("host"), 5) % 365)
    on = hosts.where(n % 3 == 0).select(F.col("host").alias("pattern"), day.alias("day"), F.lit(True).alias("listed"))
    off = hosts.where((n % 3 == 0) & (n % 2 == 0)).select("host", F.date_add(day, 200), F.lit(False))
    path = hosts.where(n % 3 == 1).select(F.concat("host", F.lit("/en")), F.date_add(day, 100), F.lit(True))
    return on.union(off).union(path)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_captures(capture_table(pages), list_table(pages))


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2023-01-01' + (('0x' || substr(md5(url), 1, 4))::INT % 730)::INT AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path
  FROM pages),
hosts AS (
  SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS n,
         DATE '2023-01-01' + (('0x' || substr(md5(host), 5, 4))::INT % 365)::INT AS day
  FROM (SELECT DISTINCT host FROM captures)),
intervals AS (
  SELECT host AS pattern, day AS valid_from, CASE WHEN n % 2 = 0 THEN day + 200 END AS valid_to FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT host || '/en', day + 100, NULL FROM hosts WHERE n % 3 = 1),
met AS (
  SELECT c.page_id, c.url, i.pattern
  FROM captures c JOIN intervals i
    ON c.fetched >= i.valid_from AND (i.valid_to IS NULL OR c.fetched < i.valid_to)
   AND (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)
        OR (contains(i.pattern, '/') AND starts_with(c.host || c.path || '/', i.pattern || '/'))))
SELECT c.page_id, c.url, c.fetched, any_value(m.pattern) IS NOT NULL AS blocked,
       arg_min(m.pattern, (-length(m.pattern), m.pattern)) AS pattern, count(DISTINCT m.pattern) AS n_active
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id AND c.url = m.url
GROUP BY c.page_id, c.url, c.fetched
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
pieces AS (SELECT r, p, octet_length(b) AS n, b[p + 1 : p + 1399] AS piece FROM (SELECT *, unnest(range(0, octet_length(b) - 399, 1000)) AS p FROM d)),
windows AS (SELECT r, p + i AS a, md5(piece[i + 1 : i + 400]) AS h FROM (SELECT *, unnest(range(least(1000, n - 399 - p))) AS i FROM pieces)),
repeated AS (SELECT r, a FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
spans AS (SELECT r, min(a) AS lo, max(a) + 400 AS hi
  FROM (SELECT r, a, sum(CASE WHEN a - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY a) AS span FROM (SELECT r, a, lag(a) OVER (PARTITION BY r ORDER BY a) AS before FROM repeated)) GROUP BY r, span),
gone AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM spans GROUP BY r),
kept AS (SELECT d.*, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN los IS NULL THEN b ELSE list_reduce(list_append(list_transform(range(1, len(los) + 1), lambda i: b[CASE WHEN i = 1 THEN 0 ELSE his[i - 1] END + 1 : los[i]]), b[his[len(his)] + 1 : octet_length(b)]), lambda x, y: x || y) END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, n_removed, n_spans, sha256(k) AS kept_sha256 FROM kept
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, with the dropped lines' numbers as text."""
    return line_dedup.line_report(documents(spark, sf_dir)).withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


OP10_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
split AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INT AS line_no FROM d),
lines AS MATERIALIZED (SELECT * FROM (SELECT r, doc_id, line_no, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws FROM split) WHERE len(ws) > 0),
firsts AS (SELECT ws, min((doc_id, line_no)) AS pos FROM lines GROUP BY ws),
unit AS (SELECT pos, len(ws) >= 8 AS of_words, CASE WHEN len(ws) >= 8 THEN ws ELSE list_concat([chr(10), chr(10)], string_split(array_to_string(ws, ' '), '')) END AS u
  FROM firsts WHERE len(ws) >= 8 OR length(array_to_string(ws, ' ')) >= 24),
wholes AS (SELECT pos, md5(of_words || array_to_string(u, chr(31))) AS key FROM unit),
without AS (SELECT pos, i, md5(of_words || array_to_string(list_concat(u[1 : i - 1], u[i + 1 : len(u)]), chr(31))) AS key FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM unit)),
near AS (SELECT DISTINCT pos FROM (
  SELECT pos FROM without QUALIFY min(pos) OVER (PARTITION BY i, key) < pos
  UNION ALL SELECT a.pos FROM without a JOIN wholes b USING (key) WHERE b.pos < a.pos
  UNION ALL SELECT b.pos FROM without a JOIN wholes b USING (key) WHERE a.pos < b.pos)),
judged AS (SELECT r, line_no, n.pos IS NOT NULL AS near, (doc_id, line_no) > f.pos AS equal FROM lines JOIN firsts f USING (ws) LEFT JOIN near n ON n.pos = f.pos),
counted AS (SELECT r, count(*) FILTER (NOT near) AS n_equal, count(*) FILTER (near) AS n_near, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped FROM judged WHERE near OR equal GROUP BY r)
SELECT doc_id, len(ls) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, len(ls) - coalesce(n_equal, 0) - coalesce(n_near, 0) AS n_kept, coalesce(dropped, '') AS dropped FROM d LEFT JOIN counted USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    ops = (op1_secret_scan, op2_lm_score, op3_license_scan, op4_decontaminate, op5_quality_rules, op6_simhash_dedup, op7_url_filter, op8_suffix_dedup, op9_packing, op10_line_dedup, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op5_quality_rules": OP5_SQL, "op7_url_filter": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL}
