"""Harmonic packing of documents into bins of ``CAPACITY`` tokens.

A text longer than a bin is cut into full bins and a remainder, so nothing is lost. A piece of n tokens has
class floor(CAPACITY / n): its length lies in (CAPACITY / (class + 1), CAPACITY / class], so exactly
``class`` such pieces always fit together, and that is how many every bin of the class takes. Bins are
filled by counting alone, hence independently in each (class, shard); shards follow from a hash of the
document and grow in number with the table. Each leaves at most one bin part-filled per class.

Defined results
* Tokens are runs of characters other than space, tab, newline and carriage return. A row without any (null
  or empty text) takes no room: one line with piece, class and bin null and 0 tokens.
* Within a class and shard, pieces are placed in the order of a hash of doc_id and text, and of piece; pieces equal in
  both are interchangeable.
* Repeated rows are packed each; null doc_ids are packed by their text. Very long texts give many pieces.
* An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col
from .mixing import key_of, tokens_of

CAPACITY = 2048
SEED = "pack-1"
#: Rows of the table behind one shard, on average.
SHARD_ROWS = 1 << 16


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, tokens, class, bin_id, slot: one row per piece of each row of docs."""
    text = col(docs, "text")
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    rows = docs.select(col(docs, "doc_id").alias("doc_id"), tokens_of(text).alias("n"), key_of(col(docs, "doc_id"), text, SEED).alias("key"))
    shard = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(shards))
    whole = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity)))
    pieces = rows.withColumn("shard", shard).withColumn("piece", F.explode_outer(whole))  # a row without tokens has the piece null
    pieces = pieces.withColumn("tokens", F.when(F.col("piece").isNull(), 0).otherwise(F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity)))
    pieces = pieces.withColumn("class", F.when(F.col("tokens") > 0, F.floor(F.lit(capacity) / F.col("tokens"))))
    place = F.row_number().over(Window.partitionBy("class", "shard").orderBy("key", "piece")) - 1
    bin_id = F.concat(F.col("class"), F.lit("-"), F.col("shard"), F.lit("-"), F.floor(F.col("place") / F.col("class")))
    return pieces.withColumn("place", place).select("doc_id", "piece", "tokens", "class", bin_id.alias("bin_id"), F.pmod(F.col("place"), F.col("class")).alias("slot"))
