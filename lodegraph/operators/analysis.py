"""Counts, dead code, hotspots, complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema


def totals(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: nodes, edges, files, lines."""
    a = symbols.agg(F.count("*").alias("nodes"))
    b = edges.agg(F.count("*").alias("edges"))
    c = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("lines"))
    return a.crossJoin(b).crossJoin(c)


def counts(rows: DataFrame, key: str) -> DataFrame:
    """key and n, most frequent first."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def stats(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """The totals with maps by kind, language and edge kind; one pass over each table. The vocabularies are closed, so maps are small."""
    def as_map(rows: DataFrame, key: str, name: str, total: str, *more: Column) -> DataFrame:
        counted = rows.groupBy(key).agg(F.count("*").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(more)])
        sums = [F.coalesce(F.sum(f"m{i}"), F.lit(0)).cast("long").alias("lines") for i in range(len(more))]
        return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(total), *sums, F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, "n"))))).alias(name))

    parts = as_map(symbols, "kind", "nodes_by_kind", "nodes").crossJoin(as_map(files, "language", "files_by_language", "files", F.sum("line_count"))).crossJoin(as_map(edges, "kind", "edges_by_kind", "edges"))
    return parts.select("nodes", "edges", "files", "lines", "nodes_by_kind", "files_by_language", "edges_by_kind")


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree: one pass and one shuffle, partially added up before it."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def hotspots(symbols: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """The most connected symbols of the hotspot kinds, over edges of all kinds."""
    d = symbols.filter(F.col("kind").isin(*schema.HOTSPOT_KINDS)).join(degrees(edges), "id", "left")
    i, o = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
    d = d.select("id", "name", "kind", "file_path", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("total_degree"))
    return d.orderBy(F.desc("total_degree"), "id").limit(limit)


def dead_code(symbols: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = schema.DEAD_KINDS, include_exported: bool = True) -> DataFrame:
    """Symbols of the kinds that no impact edge points to, by file and line."""
    rows = symbols.filter(F.col("kind").isin(*kinds))
    rows = rows if include_exported else rows.filter(~F.col("exported"))
    used = edges.filter(F.col("kind").isin(*schema.IMPACT)).select(F.col("target_id").alias("id")).distinct()  # targets move once each, not once an edge
    return rows.join(used, "id", "left_anti").orderBy("file_path", "start_line", "id")


def complexity_report(symbols: DataFrame, threshold: int = 10) -> DataFrame:
    return symbols.filter(F.col("complexity") >= threshold).orderBy(F.desc("complexity"), "id")
