"""Keyed writes as transformations, integrity, and versioned Parquet snapshots."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..plans.steps import materialize, sized

TABLES = {
    "symbols": schema.SYMBOLS, "edges": schema.EDGES, "files": schema.FILES, "search_tokens": schema.SEARCH_TOKENS, "idf": schema.IDF, "refs": schema.REFS,
    "postings": schema.POSTINGS, "search_stats": schema.SEARCH_STATS, "applied": schema.APPLIED,
}
#: Columns that a table is ordered by when it is written: point lookups and prefixes then skip most of it by its statistics.
ORDERED = {"symbols": "id", "postings": "token", "search_tokens": "token", "idf": "token"}


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key: a batch's last write wins. The order column is dropped."""
    fields = [c for c in rows.columns if c not in (*keys, order)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_row"))
    return best.select(*keys, "_row.*").select([c for c in rows.columns if c != order])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """old with the rows of new put in by key; columns in ``keep`` stay as they were where the key existed.

    One full outer join: unlike a union and a window it has one row per key to move, and no sort.
    new must have one row per key (``last_per_key``).
    """
    o, n = old.alias("o"), new.alias("n")
    here = F.col(f"n.{keys[0]}").isNotNull()

    def pick(c: str):  # noqa: ANN202
        if c in keys:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    return o.join(n, on, "full_outer").select([pick(c) for c in old.columns])


def without_files(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """symbols outside the files in ``paths`` (file_path)."""
    return symbols.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(symbols.columns)


def connected(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges whose two ends exist: what the foreign keys and their cascades enforce."""
    ids = symbols.select("id")
    out = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return out.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(edges.columns)


def dangling(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with an end that does not exist, for reports: one row each, with the ends that are missing."""
    marks = symbols.select("id", F.lit(True).alias("there"))
    out = edges.join(marks.select(F.col("id").alias("source_id"), F.col("there").alias("s")), "source_id", "left")
    out = out.join(marks.select(F.col("id").alias("target_id"), F.col("there").alias("t")), "target_id", "left")
    return out.filter("s is null or t is null").select(*edges.columns, F.col("s").isNull().alias("no_source"), F.col("t").isNull().alias("no_target"))


def without_file_edges(edges: DataFrame, symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """edges with neither end in the files in ``paths``: two anti joins, since an OR would join by nested loop.

    The symbols of those files are found once and counted, so the joins can spare the edges a shuffle where they are few.
    """
    gone = materialize(symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct())
    gone = sized(gone, gone.count(), 64)
    out = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return out.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(edges.columns)


class Store:
    """Versioned snapshots of the graph's tables under one root.

    A commit writes each changed table to a new directory and then puts a pointer file with the next number in place by
    one rename, which fails where that number exists; the greatest number is the current version. So readers see a whole
    version or the one before it, and a crash at any point leaves the last version. All file access goes through
    Hadoop's file system, local or not.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self._out = jvm.java.io.ByteArrayOutputStream

    def _names(self) -> list[str]:
        where = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def version(self) -> int:
        """Number of the current version; 0 if there is none."""
        return max((int(n[8:]) for n in self._names() if n.startswith("VERSION-") and n[8:].isdigit()), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def pointer(self) -> dict:
        """Table name to directory, of the current version; ``_batches`` has the last batch of each stream."""
        return self._pointer(self.version())

    def _pointer(self, version: int) -> dict:
        if not version:
            return {}
        stream, buffer = self._fs.open(self._path(f"{self.root}/VERSION-{version:012}")), self._out()
        self._io.copyBytes(stream, buffer, 4096, True)
        return json.loads(buffer.toString())

    def read(self, name: str) -> DataFrame:
        found = self.pointer().get(name)
        if found is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{found}")

    def done(self, batch: tuple[str, int]) -> bool:
        """Has this batch of the stream, or a later one, been committed?"""
        return self.pointer().get("_batches", {}).get(batch[0], -1) >= batch[1]

    def commit(self, batch: tuple[str, int] | None = None, **tables: DataFrame) -> None:
        """Write the tables and switch to them together; a stream's batch (stream, number) that was committed before is skipped."""
        version = self.version()
        now = self._pointer(version)
        if batch is not None:
            if self.done(batch):
                return
            now["_batches"] = now.get("_batches", {}) | {batch[0]: batch[1]}
        tag = uuid.uuid4().hex
        for name, df in tables.items():
            if name in ORDERED:
                df = df.repartitionByRange(ORDERED[name]).sortWithinPartitions(ORDERED[name])
            df.write.mode("overwrite").parquet(f"{self.root}/{name}-{tag}")
            now[name] = f"{name}-{tag}"
        fresh, target = self._path(f"{self.root}/next-{tag}"), self._path(f"{self.root}/VERSION-{version + 1:012}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            raise OSError(f"{self.root} was changed by someone else, or version {version + 1} cannot be written")

    def reset(self) -> None:
        """Empty every table."""
        self.commit(**{n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def vacuum(self) -> None:
        """Delete directories and pointers that the current version does not use."""
        version = self.version()
        keep = {f"VERSION-{version:012}", *(d for d in self._pointer(version).values() if isinstance(d, str))}
        for name in self._names():
            if name not in keep:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
