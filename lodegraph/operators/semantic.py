"""TF-IDF: index and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import counted as in_row
from ..functions.text import index_tokens, merged

FIELDS = ("name", "qualified_name", "signature", "docstring")
WEIGHTS = {"name": 4.0, "signature": 2.0, "docstring": 1.5}
LIMIT = 20


def _tokens(symbols: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """node_id and its tokens by field; the fields' texts move once, by symbol."""
    rows = merged(symbols.select(F.col("id").alias("node_id"), *fields), "node_id", fields)
    return rows.select("node_id", *[index_tokens(F.col(f)).alias(f) for f in fields])


def token_counts(symbols: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """node_id, source (field), token, n, and most, the greatest n of the symbol's field. All counts are taken within a row."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("source"), F.col(f).alias("tokens")) for f in fields]))
    rows = _tokens(symbols, fields).select("node_id", parts.alias("p")).select("node_id", "p.source", "p.tokens")
    rows = in_row(rows, "tokens").withColumn("most", F.array_max(F.transform("entries", lambda x: x["n"])))
    # explode_outer and a filter after it: explode would have the optimizer take entries twice, for each element anew.
    return rows.select("node_id", "source", "most", F.explode_outer("entries").alias("e")).filter("e is not null").select("node_id", "source", "e.token", "e.n", "most")


def term_frequency(counted: DataFrame) -> DataFrame:
    """node_id, token, tf, source: each count over the greatest of its symbol and field."""
    return counted.select("node_id", "token", (F.col("n") / F.col("most")).alias("tf"), "source")


def vocabulary(symbols: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``document_frequency`` of the symbols' texts: tokens are told apart within a row, so that a task holds distinct tokens only."""
    rows = _tokens(symbols, fields).select(F.array_distinct(F.concat(*fields)).alias("t"))
    return rows.select(F.explode_outer("t").alias("token")).filter("token is not null").groupBy("token").agg(F.count("*").alias("doc_count"))


def document_frequency(counted: DataFrame) -> DataFrame:
    """token and doc_count: symbols with the token in any field."""
    return counted.groupBy("token", "node_id").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("doc_count"))


def idf(df: DataFrame, n_symbols: DataFrame) -> DataFrame:
    """token, idf, doc_count; n_symbols has one row and one column n."""
    n = F.greatest(F.col("n"), F.lit(1))
    return df.crossJoin(F.broadcast(n_symbols)).select("token", (F.log((n + 1) / (F.col("doc_count") + 1)) + 1).alias("idf"), "doc_count")


def build_index(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(search_tokens, idf)."""
    return term_frequency(token_counts(symbols)), idf(vocabulary(symbols), symbols.agg(F.count("*").alias("n")))


def scores(tokens: DataFrame, idfs: DataFrame, query: str) -> DataFrame:
    """node_id and score for a query; a token that it names twice counts twice. Only the query is broadcast."""
    spark = tokens.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(index_tokens(F.col("q"))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    weighed = idfs.join(F.broadcast(asked), "token").select("token", "idf", "times")
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("source")), F.lit(1.0))
    hits = tokens.join(F.broadcast(weighed), "token")
    return hits.groupBy("node_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("times") * weight).alias("score"))


def search(symbols: DataFrame, query: str, limit: int = LIMIT, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best symbols, with score; symbols are fetched after the cut."""
    tokens, idfs = index or build_index(symbols)
    top = scores(tokens, idfs, query).orderBy(F.desc(F.round("score", 9)), "node_id").limit(limit)
    return symbols.join(F.broadcast(top), F.col("id") == F.col("node_id")).drop("node_id").orderBy(F.desc(F.round("score", 9)), "id")
