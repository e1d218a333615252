"""Reference resolution: each unresolved reference to its best symbol.

Candidates of a name are its ten best keyword hits; names are searched once each, however many references use
them. The best candidate has the most points, then the shortest file path, then the best search rank. A
reference that resolves to its own symbol gives no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import directory
from ..functions.text import fts_tokens
from ..plans.steps import materialize, sized
from ..schema import edge_id
from . import search

CANDIDATES = 10
#: Widths in a broadcast: of a term with its token or symbol; of a name with its terms, or with its place and symbol.
TERM_BYTES, QUERY_BYTES = 128, 512


def name_terms(names: DataFrame) -> DataFrame:
    """Terms of distinct names (ref_name) for ``bm25``, built in the cluster: names grow with the code."""
    clean = F.regexp_replace("ref_name", r"[^A-Za-z0-9_\s]", " ")
    rows = names.select(F.col("ref_name").alias("query"), fts_tokens(clean).alias("t")).filter(F.size("t") > 0)
    return rows.select("query", F.size("t").alias("n"), F.posexplode("t").alias("term_no", "term")).select("query", "term_no", "term", (F.col("term_no") == F.col("n") - 1).alias("is_prefix"))


def bm25_by_name(postings: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``search.bm25`` for many queries, by equi-joins alone: tokens meet prefixes through their own leading parts.

    Distinct terms, which names share, are expanded to the vocabulary (distinct tokens), which is far smaller than the
    postings. A token has a part for each length that a prefix has; these lengths are few. A symbol's hits are gathered in
    one row; it meets a name only through the name's rarest term, and the name's other terms are looked up in that row.
    """
    vocabulary = postings.select("token").distinct()
    terms = terms.withColumn("key", F.concat("term", F.when(F.col("is_prefix"), "*").otherwise("")))  # no term has a star
    asked = terms.select("term", "is_prefix", "key").distinct()
    wide = asked.filter("is_prefix").select("term", "key")
    lengths = sorted(r[0] for r in wide.select(F.length("term")).distinct().collect())
    parts = F.explode(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("token")), lambda n: F.substring("token", 1, n)))
    by_prefix = vocabulary.select("token", parts.alias("term")).join(wide, "term")
    exact = asked.filter("not is_prefix").select(F.col("term").alias("token"), "key")
    pairs = materialize(exact.unionByName(by_prefix.select("token", "key")))
    hits = postings.join(sized(pairs, pairs.count(), TERM_BYTES), "token").repartition("id")
    per_term = hits.groupBy("id", "key").agg(F.sum("tf").alias("f"), F.first("size").alias("size"))
    rows = materialize(per_term.groupBy("id").agg(F.first("size").alias("size"), F.collect_list(F.struct("key", "f")).alias("hits")))
    found = rows.select(F.explode("hits.key").alias("key")).groupBy("key").agg(F.count("*").alias("n_i"))
    wanted = terms.join(found, "key", "left").groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("term_no", "key", "n_i"))).alias("wanted"), F.min_by("key", F.struct("n_i", "term_no")).alias("key"), F.count_if(F.col("n_i").isNull()).alias("none")
    )
    wanted = materialize(wanted.filter("none = 0").select("query", "key", "wanted"))
    # explode_outer: explode would have the optimizer test each array's size in a filter of its own.
    met = rows.select("id", "size", "hits", F.explode_outer("hits.key").alias("key")).join(sized(wanted, wanted.count(), QUERY_BYTES), "key")
    whole = met.filter(F.size(F.array_except("wanted.key", "hits.key")) == 0).crossJoin(F.broadcast(stats))
    gains = F.transform("wanted", lambda w: search.gain(F.get(F.filter("hits", lambda h: h["key"] == w["key"]), F.lit(0))["f"], w["n_i"]))
    return whole.select("query", "id", F.aggregate(gains, F.lit(0.0), lambda x, y: x + y).alias("score"))


def points(own_path: Column, path: Column, same_name: Column, exported: Column, ref_kind: Column, kind: Column) -> Column:
    """Points of a candidate: name 10; file 8, directory 5, or up to 3 equal leading places; exported 3; importable kind 2."""
    a, b = F.split(own_path, "/"), F.split(path, "/")
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    near = F.when(own_path == path, 8).when(directory(own_path) == directory(path), 5).otherwise(F.least(shared, F.lit(3)))
    return F.when(same_name, 10).otherwise(0) + near + F.when(exported, 3).otherwise(0) + F.when((ref_kind == "imports") & kind.isin("class", "interface", "module"), 2).otherwise(0)


def resolve(refs: DataFrame, symbols: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, source_id, target_id, kind: one edge for each pair of symbols and kind that references resolve to."""
    postings, stats = index or search.built(symbols)
    asked = materialize(refs.select("from_node_id", "ref_name", "ref_kind", F.col("file_path").alias("own_path")).distinct())
    terms = materialize(name_terms(asked.select("ref_name").distinct()))
    top = materialize(search.top_per_query(bm25_by_name(postings, terms, stats), CANDIDATES).select(F.col("query").alias("ref_name"), "id", "place"))
    s = symbols.select("id", F.col("name"), F.col("file_path").alias("path"), "exported", "kind")
    # Points depend on a reference's place and not on its symbol: each place is rated once, for all symbols in it.
    places = asked.select("ref_name", "ref_kind", "own_path").distinct()
    rows = places.join(s.join(sized(top, top.count(), TERM_BYTES), "id"), "ref_name")
    score = points(F.col("own_path"), F.col("path"), F.col("name") == F.col("ref_name"), F.col("exported"), F.col("ref_kind"), F.col("kind"))
    best = Window.partitionBy("ref_name", "ref_kind", "own_path").orderBy(F.desc(score), F.length("path"), "place")
    rated = rows.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    won = materialize(rated.select(F.col("ref_name").alias("_name"), F.col("ref_kind").alias("_kind"), F.col("own_path").alias("_path"), "id"))
    same = (F.col("ref_name") == F.col("_name")) & F.col("ref_kind").eqNullSafe(F.col("_kind")) & F.col("own_path").eqNullSafe(F.col("_path"))
    found = asked.join(sized(won, won.count(), QUERY_BYTES), same).filter(F.col("id") != F.col("from_node_id"))
    out = found.select(F.col("from_node_id").alias("source_id"), F.col("id").alias("target_id"), F.col("ref_kind").alias("kind")).distinct()
    return out.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")).alias("id"), "source_id", "target_id", "kind")
