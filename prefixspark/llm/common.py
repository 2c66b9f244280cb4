"""What the operators share: scratch tables in the cluster's shared folder and text columns."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows may be broadcast; beyond it every caller has a shuffled way.
BROADCAST_ROWS = 100_000
_fallback: dict[str, str] = {}
_written: list[str] = []
#: Which thread wrote a table: queries that run at once drop only their own.
_owner: dict[str, int] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset in local mode (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = "file://" + tempfile.mkdtemp(prefix="prefixspark-")
    return _fallback["dir"]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs nothing before it.
    Shuffles of steps before go first: Spark deletes their files once the driver has collected the frames that no one holds."""
    df.sparkSession._jvm.java.lang.System.gc()
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    _owner[path] = threading.get_ident()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A place in the list of written tables, for ``drop_scratch``."""
    return len(_written)


def drop_scratch(spark: SparkSession, since: int = 0, keep: str | tuple[str, ...] = ()) -> None:
    """Delete the tables written since a mark, but those of the names ``keep``. Operators so drop what their result doesn't read;
    what it reads belongs to the caller, who drops it when the result is written."""
    names = (keep,) if isinstance(keep, str) else keep
    for path in [p for p in _written[since:] if _owner[p] == threading.get_ident() and not any(re.search(rf"/{re.escape(n)}-[0-9a-f]{{32}}$", p) for n in names)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)
        del _owner[path]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
