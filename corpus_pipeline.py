"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; the last returns packed pieces. Verdicts are on
rows, by a key that each filtering stage gives them: doc_ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixspark.llm import decontaminate, line_dedup, packing, quality_rules, simhash_dedup
from prefixspark.llm.common import documents, drop_scratch, free_name, materialise, scratch_mark

#: No SQL: fingerprints, edit distances and the dynamic programme are tested against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame, stage: str) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, and that column's name. It is written so that the operator and the join that
    follows it see the same keys."""
    row = free_name(docs, "row_key")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), f"keyed-{stage}"), row


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(keyed: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that ``rejected`` does not name (its doc_id is the row key)."""
    return keyed.join(rejected.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts count as empty and go, a null source is a host of its own, very
    long texts are measured whole, repeated rows are judged each, an empty table stays empty, extra columns stay as they are."""
    keyed, row = _keyed(docs, "quality")
    return _without(keyed, row, quality_rules.apply_rules(keyed, id_col=row).where("NOT kept")).select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go; documents stay, n_chars (if there is one) follows their text. Nulls
    stay null, empty texts empty; rows that repeat an id and text are one document and keep the same lines; ties of an id go by
    the text's hash; an empty table stays empty, extra columns stay as they are."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*_columns(docs)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similar sets of five-word shingles (0.8 or more) one row stays: of the least id, null ids last,
    and of rows that share it the first. Null and empty texts are one group. Repeated rows are one group too. Very long texts are
    compared whole; an empty table stays empty; extra columns stay as they are."""
    keyed, row = _keyed(docs, "near-duplicates")
    groups = simhash_dedup.similar_groups(keyed, id_col=row).select(F.col("doc_id").alias("r"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r")
    stays = keyed.select("doc_id", F.col(row).alias("r")).join(groups, "r").groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(stays.select(F.col("first.r").alias(row)), row, "left_semi").select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts hold none; repeated rows go or stay each; very long texts
    are searched whole; an empty table or benchmark changes nothing; extra columns stay as they are."""
    keyed, row = _keyed(docs, "decontamination")
    leaks = decontaminate.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return _without(keyed, row, leaks).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches of like length. Null and empty texts have one row in no batch; very long texts are cut into
    pieces; repeated rows and ids are packed each; an empty table gives an empty table; extra columns are not read."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = documents(spark, sf_dir), scratch_mark()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_scratch(spark, since, keep=f"pipeline-{name}")
    return docs
