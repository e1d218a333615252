"""Steps of multi-job plans: materialised tables in the shared folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times its row width stay under this many bytes.
BROADCAST_BYTES = 32 << 20
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local run without the setting gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: lineage ends, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/lodegraph-{uuid.uuid4().hex}"
    for held in _SCOPES[-1:]:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, on leaving, the tables that were materialised inside: for callers that have written what they need of them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)  # noqa: SLF001


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted rows fit in BROADCAST_BYTES, else a sort-merge hint."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")
