"""Context for a task: keyword hits, scored, widened along edges, cut and enriched; and the project overview."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import query_keywords
from ..plans.steps import materialize
from ..sources.files import snippets
from . import analysis, search
from .lookup import directory_rollup


@dataclass(frozen=True)
class Options:
    max_nodes: int = 25
    code_chars: int = 500
    include_code: bool = True
    include_graph: bool = True
    kinds: tuple[str, ...] | None = None
    file_filter: str | None = None
    per_keyword: int = 50
    seeds: int = 10
    neighbours: int = 5


def keywords(spark, query: str) -> list[str]:  # noqa: ANN001
    """Keywords of a query (a handful of words, hence on the driver)."""
    return spark.createDataFrame([(query,)], "q string").select(query_keywords(F.col("q"))).first()[0]


def node_score(words: list[str]) -> Column:
    """Points of a symbol for the words: its name above all, then qualified name, signature and docstring."""
    name, qual, sig, doc = (F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "qualified_name", "signature", "docstring"))
    total = F.lit(0)
    for w in words:
        total += F.when(name == w, 10).when(name.contains(w), 5).otherwise(0)
        for field, points in ((qual, 3), (sig, 2), (doc, 2)):
            total += F.when(field.contains(w), points).otherwise(0)
    total += F.when(F.col("exported"), 2).otherwise(0)
    total += F.when(F.col("kind").isin("class", "component", "interface"), 1).otherwise(0)
    return (total + F.when(name.rlike("^(api|app|controller|handler|index|main|route|server)"), 1).otherwise(0)).cast("double")


def candidates(symbols: DataFrame, words: list[str], options: Options, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id and score of the keyword hits, after the kind and file filters."""
    postings, stats = index or search.built(symbols)
    ranked = search.top_per_query(search.bm25(search.naming(postings, words), search.term_frame(symbols, words), stats), options.per_keyword)
    rows = symbols.join(ranked.select("id").distinct(), "id")
    rows = rows.filter(F.col("kind").isin(*options.kinds)) if options.kinds else rows
    rows = rows.filter(F.col("file_path").contains(options.file_filter)) if options.file_filter else rows
    return rows.select("id", node_score(words).alias("score"))


def expand(found: DataFrame, edges: DataFrame, symbols: DataFrame, options: Options) -> DataFrame:
    """found with neighbours of the best seeds: 0.5 for what a seed depends on, 0.4 for what depends on it.

    A symbol met several times takes the score of the first seed in rank order, dependencies first.
    """
    seeds = found.orderBy(F.desc("score"), "id").limit(options.seeds)
    # At most ``seeds`` rows are numbered in one task.
    seeds = seeds.withColumn("seed", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "seed")
    near = F.broadcast(seeds)
    edges = edges.select("source_id", "target_id")
    down = edges.join(near, F.col("source_id") == F.col("id")).select(F.col("target_id").alias("to"), "seed", F.lit(0.5).alias("s"), F.lit(0).alias("side"))
    up = edges.join(near, F.col("target_id") == F.col("id")).select(F.col("source_id").alias("to"), "seed", F.lit(0.4).alias("s"), F.lit(1).alias("side"))
    both = down.unionByName(up).groupBy("to").agg(F.min_by("s", F.struct("seed", "side")).alias("score"))
    more = both.select(F.col("to").alias("id"), "score").join(found.select("id"), "id", "left_anti").join(symbols.select("id"), "id", "left_semi")
    return found.unionByName(more)


def named_neighbours(top: DataFrame, edges: DataFrame, symbols: DataFrame, own: str, other: str, limit: int, name: str) -> DataFrame:
    """id and the qualified names of up to ``limit`` callers or callees, by id."""
    calls = edges.filter(F.col("kind").isin(*schema.CALLS)).select("source_id", "target_id").join(F.broadcast(top.select(F.col("id").alias("_n"))), F.col(own) == F.col("_n"))
    rows = calls.select("_n", F.col(other).alias("id")).join(symbols.select("id", "qualified_name"), "id")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("_n").orderBy("id"))).filter(F.col("place") <= limit)
    return first.groupBy(F.col("_n").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "qualified_name"))), lambda x: x["qualified_name"]).alias(name))


def build(symbols: DataFrame, edges: DataFrame, query: str, options: Options = Options(), files: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """place, score, the symbol's columns, callers, callees and code of the best symbols for a query; searched: candidates in all."""
    words = keywords(symbols.sparkSession, query)
    found = materialize(candidates(symbols, words, options, index)) if words else symbols.limit(0).select("id", F.lit(0.0).alias("score"))
    if options.include_graph and words:
        found = materialize(expand(found, edges, symbols, options))
    top = found.orderBy(F.desc("score"), "id").limit(options.max_nodes)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    top = top.crossJoin(F.broadcast(found.agg(F.count("*").alias("searched"))))
    out = symbols.join(F.broadcast(top), "id")
    if options.include_graph:
        for own, other, name in (("target_id", "source_id", "callers"), ("source_id", "target_id", "callees")):
            out = out.join(named_neighbours(top, edges, symbols, own, other, options.neighbours, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if options.include_code and files is not None:
        out = snippets(out, files, options.code_chars)
    return out.orderBy("place")


def overview(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The parts of a project overview: totals, languages, kinds, hotspots, directories."""
    return {
        "totals": analysis.totals(symbols, edges, files),
        "languages": analysis.counts(files, "language"),
        "kinds": analysis.counts(symbols, "kind"),
        "hotspots": analysis.hotspots(symbols, edges, 10),
        "directories": directory_rollup(files),
    }
