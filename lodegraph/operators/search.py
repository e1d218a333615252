"""Keyword search with BM25 over postings.

Postings and their statistics are DataFrames, built once and stored with the graph, ordered by token (``build_postings``,
``statistics``): a search reads the tokens that it names, whatever the size of the texts. A
batch of queries is a small frame of terms: every term but a query's last matches exactly, the last one as a
prefix; all terms must match; the score is Okapi BM25 with k1 1.2 and b 0.75 over all fields together, with
statistics over all symbols, before the kind filter. AND, OR and NOT are ordinary words; a term with an
underscore counts as its parts, which must all match but need not be adjacent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KEY_BYTES, counted, fts_terms, fts_tokens, merged
from ..plans.steps import materialize, sized

FIELDS = ("name", "qualified_name", "signature", "docstring")
LIMIT = 20


def build_postings(symbols: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, token, tf, size: occurrences of each token of a symbol, and the symbol's tokens in all. One shuffle, by symbol; counts within a row."""
    rows = merged(symbols.select("id", *fields), "id", fields)
    rows = counted(rows.select("id", F.concat(*[fts_tokens(F.col(f)) for f in fields]).alias("t")).withColumn("size", F.size("t")), "t")
    # explode_outer and a filter after it: explode would have the optimizer take entries twice, for each element anew.
    return rows.select("id", "size", F.explode_outer("entries").alias("e")).filter("e is not null").select("id", "e.token", F.col("e.n").alias("tf"), "size")


def statistics(symbols: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: n_all, the number of symbols, and all_tokens, the sum of their sizes."""
    return symbols.agg(F.count("*").alias("n_all")).crossJoin(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all_tokens")))


def naming(postings: DataFrame, queries: list[str]) -> DataFrame:
    """The postings of tokens that a term of the queries may match: a filter that reaches the scan and prunes by token."""
    cond = F.lit(False)
    for q in queries:
        terms = fts_terms(q)
        for t in terms[:-1]:
            cond |= F.col("token") == t
        if terms:
            cond |= F.col("token").startswith(terms[-1])
    return postings.filter(cond)


def bm25(postings: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """query, id, score for every symbol that matches all terms of a query; terms: query, term_no, term, is_prefix.

    postings may be those that the terms can match (``naming``); stats are over all of them.
    """
    exact = postings.join(F.broadcast(terms.filter("not is_prefix")), F.col("token") == F.col("term"))
    # The prefix side has one row per query: a nested-loop join with it is one pass over the postings.
    prefix = postings.join(F.broadcast(terms.filter("is_prefix")), F.col("token").startswith(F.col("term")))
    hits = exact.select("query", "term_no", "id", "tf", "size").unionByName(prefix.select("query", "term_no", "id", "tf", "size"))
    per_term = hits.groupBy("query", "term_no", "id").agg(F.sum("tf").alias("f"), F.first("size").alias("size"))
    found = per_term.groupBy("query", "term_no").agg(F.count("*").alias("n_i"))
    need = terms.groupBy("query").agg(F.count("*").alias("need"))
    scored = per_term.join(F.broadcast(found), ["query", "term_no"]).crossJoin(F.broadcast(stats))
    sums = scored.groupBy("query", "id").agg(F.sum(gain()).alias("score"), F.count("*").alias("got"))
    return sums.join(F.broadcast(need), "query").filter("got = need").select("query", "id", "score")


def gain(f: Column | None = None, n_i: Column | None = None) -> Column:
    """A term's part of the score, from f, size, n_i, n_all and all_tokens."""
    f, n_i = F.col("f") if f is None else f, F.col("n_i") if n_i is None else n_i
    idf = F.log((F.col("n_all") - n_i + 0.5) / (n_i + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("size") / (F.col("all_tokens") / F.col("n_all"))))


def term_frame(symbols: DataFrame, queries: list[str]) -> DataFrame:
    """Terms of each query, for ``bm25``; queries without a term are left out."""
    rows = [(q, i, t, i == len(ts) - 1) for q in queries for ts in [fts_terms(q)] for i, t in enumerate(ts)]
    return symbols.sparkSession.createDataFrame(rows, "query string, term_no int, term string, is_prefix boolean")


def search(symbols: DataFrame, query: str, kind: str | None = None, limit: int = LIMIT, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best symbols for a query, with score; a query without any letter or digit searches names for it as it is.

    index: postings and their statistics, where they are stored. Symbols are fetched after the cut: texts are neither
    moved nor sorted, and ids are only where hits must be told from those of other kinds, or of a stored index.
    """
    rows = symbols.filter(F.col("kind") == kind) if kind else symbols
    if not fts_terms(query):
        return name_like(rows, query, limit)
    postings, stats = index or built(symbols)
    hits = bm25(naming(postings, [query]), term_frame(symbols, [query]), stats).filter("id is not null").select("id", "score")
    if kind or index:
        hits = hits.join(rows.select("id"), "id", "left_semi")
    order = F.desc(F.round("score", 9)), "id"
    top = hits.orderBy(*order).limit(limit)  # each has a row or, where an id is repeated, more
    return rows.join(sized(top, limit, KEY_BYTES), "id").orderBy(*order).limit(limit)


def built(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings, as a table, and their statistics."""
    postings = materialize(build_postings(symbols))
    return postings, statistics(symbols, postings)


def name_like(symbols: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    """Symbols whose name contains the text in any case (% and _ stand for any), with score 0."""
    return symbols.filter(F.col("name").ilike(f"%{text}%")).withColumn("score", F.lit(0.0)).orderBy("id").limit(limit)


def top_per_query(scores: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` symbols of each query, with ``place`` from 1."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
