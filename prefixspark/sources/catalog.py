"""Generations of an index as folders of Parquet files, with a pointer row that is written last.

A generation's files never change, so a reader that has resolved a generation keeps a whole view. All reads and writes go
through Spark, so the folder may be in any store that Spark reads.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.vector import IvfModel
from ..schemas import JOURNAL, POSTINGS


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, schema: str | StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._has(name) else self.spark.createDataFrame([], schema)

    def current(self) -> int | None:
        return self._read("pointer", "generation INT").agg(F.max("generation")).first()[0]

    def journal(self) -> DataFrame:
        return self._read("journal", JOURNAL)

    def postings(self, generation: int) -> DataFrame:
        return self._read(f"gen={generation}/postings", POSTINGS)

    def publish(self, model: IvfModel, posted: DataFrame) -> int:
        """Write a generation whole, then its row in the pointer."""
        generation = (self.current() or 0) + 1
        at = f"{self.path}/gen={generation}"
        rows = [("centroids", 0, i, v.tolist()) for i, v in enumerate(model.centroids)]
        rows += [(name, s, c, v.tolist()) for name, book in (("codebook", model.codebook), ("routing", model.routing)) for s, sub in enumerate(book) for c, v in enumerate(sub)]
        self.spark.createDataFrame(rows, "part STRING, sub INT, code INT, vec ARRAY<DOUBLE>").coalesce(1).write.parquet(f"{at}/model")
        posted.repartition("centroid").write.partitionBy("centroid").parquet(f"{at}/postings")
        self.spark.createDataFrame([(generation,)], "generation INT").coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return generation

    def stage(self, rows: DataFrame) -> DataFrame:
        """``rows`` written and read again: the same rows however often they are read."""
        rows.write.mode("overwrite").parquet(f"{self.path}/stage")
        return self._read("stage", rows.schema)

    def drop_stage(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stage")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def append_journal(self, vectors: DataFrame) -> None:
        vectors.write.mode("append").parquet(f"{self.path}/journal")

    def append_postings(self, posted: DataFrame) -> None:
        posted.write.mode("append").partitionBy("centroid").parquet(f"{self.path}/gen={self.current()}/postings")

    def model(self, generation: int) -> IvfModel:
        rows = self.spark.read.parquet(f"{self.path}/gen={generation}/model").orderBy("part", "sub", "code").collect()
        part = lambda name: [r for r in rows if r["part"] == name]
        book = lambda name: np.stack([np.array([r["vec"] for r in part(name) if r["sub"] == s]) for s in sorted({r["sub"] for r in part(name)})])
        return IvfModel(np.array([r["vec"] for r in part("centroids")]), book("codebook"), book("routing"))
