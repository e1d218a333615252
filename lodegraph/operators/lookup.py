"""Point lookups, name resolution and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import directory

PARTIAL_LIMIT = 20


def by_id(symbols: DataFrame, node_id: str) -> DataFrame:
    return symbols.filter(F.col("id") == node_id)


def by_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.filter(F.col("file_path") == path).orderBy("start_line", "id")


def one_by_name(symbols: DataFrame, name: str, kind: str | None = None, path: str | None = None) -> DataFrame:
    """The best symbol of a name: exported first, then by file."""
    rows = symbols.filter(F.col("name") == name)
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    rows = rows.filter(F.col("file_path") == path) if path else rows
    return rows.orderBy(F.desc("exported"), "file_path", "id").limit(1)


def by_name(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Symbols of that name; if none, of that qualified name; if none, the first 20 whose qualified name contains it.

    One scan: every row gets the tier it answers in, the least tier present is kept. ``place`` orders the result.
    """
    rows = symbols.filter(F.col("kind") == kind) if kind else symbols
    tier = F.when(F.col("name") == name, 1).when(F.col("qualified_name") == name, 2).when(F.col("qualified_name").ilike(f"%{name}%"), 3)
    rows = rows.withColumn("tier", tier).filter("tier is not null")
    # One row of the least tier present meets every candidate: no window over all of them.
    least = rows.agg(F.min("tier").alias("least"))
    rows = rows.join(F.broadcast(least), F.col("tier") == F.col("least")).drop("least")
    exact = rows.filter("tier < 3")
    partial = rows.filter("tier = 3").orderBy(F.desc("exported"), "file_path", "id").limit(PARTIAL_LIMIT)
    return exact.unionByName(partial)


def resolve(symbols: DataFrame, name: str, path: str | None = None, kind: str | None = None) -> DataFrame:
    """One row: status (ok, not_found, ambiguous), id of the symbol if ok, number of matches and of their files.

    With a path, the first match whose file contains it; without, all matches must lie in one file.
    """
    rows = by_name(symbols, name, kind)
    rows = rows.filter(F.col("file_path").contains(path)) if path else rows
    first = F.min_by("id", F.struct(~F.col("exported"), F.col("file_path"), F.col("id")))
    got = rows.agg(F.count("*").alias("matches"), F.countDistinct("file_path").alias("files"), first.alias("id"))
    ok = F.lit(bool(path)) | (F.col("files") == 1)
    status = F.when(F.col("matches") == 0, "not_found").when(ok, "ok").otherwise("ambiguous")
    return got.select(status.alias("status"), F.when(status == "ok", F.col("id")).alias("id"), "matches", "files")


def file(files: DataFrame, path: str) -> DataFrame:
    """The record of one file."""
    return files.filter(F.col("file_path") == path)


def file_tree(files: DataFrame, contains: str | None = None, language: str | None = None) -> DataFrame:
    """path, language, node_count, line_count of every file, by path."""
    rows = files.filter(F.col("file_path").contains(contains)) if contains else files
    rows = rows.filter(F.col("language") == language) if language else rows
    return rows.select(F.col("file_path").alias("path"), "language", "node_count", "line_count").orderBy("path")


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files and symbols per directory."""
    return files.groupBy(directory(F.col("file_path")).alias("dir")).agg(F.count("*").alias("files"), F.sum("node_count").cast("long").alias("symbols")).orderBy("dir")
