"""A log as an append-only table: one row a flush, so a flush is whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import wal

SCHEMA = "flush BIGINT, bytes BINARY"


class LogSink:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def flush(self, frames: DataFrame, flush: int | None = None) -> int:
        """Append the frames of whole transactions, children before parents. A number that was flushed before is not written again,
        so a repeated micro-batch changes nothing."""
        number = self.flush_count() if flush is None else flush
        if self._rows().where(F.col("flush") == number).limit(1).count():
            return number
        batch = wal.commit_order(frames).withColumn("flush", F.lit(number).cast("bigint"))
        wal.encode_logs(batch, "flush").write.mode("append").parquet(self.path)
        return number

    def flush_count(self) -> int:
        """Flushes, not frames."""
        return self._rows().count()

    def size(self) -> int:
        return self._rows().agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]

    def is_empty(self) -> bool:
        return self.size() == 0

    def frames(self, tolerant: bool = False) -> DataFrame:
        """(flush, lsn, opcode, offset, payload) of all that was flushed; ``order`` is the log's."""
        return wal.parse_logs(self._rows(), "flush", tolerant).withColumn("order", F.struct("flush", "lsn"))

    def recover(self, tolerant: bool = False) -> DataFrame:
        return wal.replay(self.frames(tolerant), order="order")
