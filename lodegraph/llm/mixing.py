"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact token budgets.

Every row gets a key, the MD5 of a seed, its doc_id and its text's MD5, so the order within a source is
random, fixed and independent of the partitioning. Keys are uniform, hence their leading bits cut the key
range into equal ranges without sampling: token sums per (source, range) are added up first, their running
sums say in which range each source's budget runs out, and only that range's rows are sorted to find the
row at which it does. What remains is one cut-off key per source, joined to the documents on the side, so
text is never shuffled.

A source whose budget exceeds its tokens is repeated: whole epochs, then a part of one. Weights default to
token counts to the power 3/4 (small sources gain, large ones lose); the total defaults to the tokens
there are. The row at which a budget runs out is included and counts with the tokens left (``taken``).

Defined results
* Tokens are runs of characters other than space, tab, newline and carriage return; a null or empty text
  has none. Rows without tokens come along in every whole epoch.
* A null source is a source of its own. A source without tokens, or without weight, has budget 0 and is
  left out. Null doc_ids order by their text.
* Rows with equal keys are ordered by content hash; rows equal in every column are copies that are cut
  one by one. Very long texts count whole. An empty table gives an empty result.
* Extra columns pass through ``mix_documents`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import materialize, sized
from .common import col, fresh, locator

SEED = "mix-1"
RANGE_DIGITS = 3


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def _cuts(slim: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """Per source: epochs (whole ones), rest (tokens of the partial one), key, l1, l2 and copies of its last row, cut (tokens that row gives)."""
    reach = slim.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("reach")).agg(F.sum("tokens").alias("sum"))
    reach = materialize(reach)
    sums = reach.groupBy("source").agg(F.sum("sum").alias("have"))
    if weights is None:
        root = F.sqrt(F.col("have").cast("double"))
        sums = sums.withColumn("weight", root * F.sqrt(root))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map()
        sums = sums.withColumn("weight", F.coalesce(F.try_element_at(given.cast("map<string,double>"), F.coalesce("source", F.lit(""))), F.lit(0.0)))
    # One row per source: the window over all of them is small whatever the corpus.
    every = Window.partitionBy(F.lit(1))
    whole = F.lit(total).cast("long") if total is not None else F.sum("have").over(every)
    weight = F.when(F.col("have") > 0, F.col("weight")).otherwise(0.0)
    sums = sums.withColumn("budget", F.coalesce(F.floor(whole * weight / F.nullif(F.sum(weight).over(every), F.lit(0.0)) + 1e-6), F.lit(0)))
    sums = sums.withColumn("epochs", F.coalesce(F.floor(F.try_divide("budget", "have")), F.lit(0)).cast("long"))
    plan = sums.select("source", "epochs", (F.col("budget") - F.col("epochs") * F.col("have")).alias("rest"))
    run = reach.withColumn("end", F.sum("sum").over(Window.partitionBy("source").orderBy("reach")))
    run = run.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source")).select("r.source", "reach", (F.col("end") - F.col("sum")).alias("before"), "end", "rest")
    last = run.filter("before < rest and end >= rest").select(F.col("source").alias("s"), F.col("reach").alias("g"), "before", "rest")
    rows = slim.join(last, F.expr("source <=> s and substring(key, 1, %d) = g" % RANGE_DIGITS))
    order = Window.partitionBy("source").orderBy("key", "l1", "l2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).filter(F.col("upto") - F.col("tokens") < F.col("rest"))
    at = rows.groupBy("source").agg(F.max(F.struct("key", "l1", "l2")).alias("at"), F.first("rest").alias("rest"))
    tied = rows.alias("r").join(at.alias("a"), F.expr("r.source <=> a.source and r.key = a.at.key and r.l1 = a.at.l1 and r.l2 = a.at.l2"))
    ends = tied.groupBy("r.source").agg(F.count("*").alias("copies"), F.max(F.col("r.rest") - F.col("upto") + F.col("tokens")).alias("most"), F.min(F.col("r.rest") - F.col("upto") + F.col("tokens")).alias("cut"), F.first("at").alias("at"))
    return materialize(plan.alias("p").join(ends.alias("e"), F.expr("p.source <=> e.source"), "left").select("p.source", "epochs", "rest", "e.at.key", "e.at.l1", "e.at.l2", "copies", "cut"))


def _slim(docs: DataFrame) -> DataFrame:
    one, two = locator(docs)
    text = col(docs, "text")
    return docs.select(one.alias("l1"), two.alias("l2"), col(docs, "doc_id").alias("doc_id"), col(docs, "source").cast("string").alias("source"), tokens_of(text).alias("tokens"), key_of(col(docs, "doc_id"), text).alias("key"))


def _chosen(rows: DataFrame, cuts: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with ``first`` and ``final`` epoch appended, and ``cut`` where the final one counts in part; unchosen rows are gone.

    names maps source, key, l1, l2, epochs, cut, place to the columns' names in rows.
    """
    n = cuts.count()
    c = cuts.select(*[F.col(x).alias(f"{names['cut']}_{x}") for x in cuts.columns])
    pre = names["cut"] + "_"
    source, key, l1, l2 = (F.col(names[x]) for x in ("source", "key", "l1", "l2"))
    joined = rows.join(sized(c, n, 200), source.eqNullSafe(F.col(pre + "source")))
    ck, c1, c2 = (F.col(pre + x) for x in ("key", "l1", "l2"))
    at = F.coalesce((key == ck) & (l1 == c1) & (l2 == c2), F.lit(False))
    below = F.coalesce(F.struct(key.alias("a"), l1.alias("b"), l2.alias("c")) < F.struct(ck.alias("a"), c1.alias("b"), c2.alias("c")), F.lit(False))
    whole = F.col(pre + "epochs")
    rest = joined.filter(~at).withColumn(names["epochs"], whole + F.when(below, 1).otherwise(0)).withColumn(names["place"], F.lit(None).cast("long"))
    # The rows at the cut: one per source, or its copies; only these meet in a window.
    place = F.row_number().over(Window.partitionBy(source).orderBy(key))
    tied = joined.filter(at).withColumn(names["place"], F.when(place == F.col(pre + "copies"), F.col(pre + "cut")))
    tied = tied.withColumn(names["epochs"], whole + F.when(place <= F.col(pre + "copies"), 1).otherwise(0))
    both = rest.unionByName(tied)
    return both.filter(F.col(names["epochs"]) > 0)


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """doc_id, source, epoch (from 1), tokens and taken, one row each time a row of docs is used."""
    slim = materialize(_slim(docs))
    cuts = _cuts(slim, weights, total)
    names = {x: x for x in ("source", "key", "l1", "l2", "epochs", "place")} | {"cut": "c"}
    used = _chosen(slim, cuts, names)
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))))
    taken = F.when((F.col("epoch") == F.col("epochs")) & F.col("place").isNotNull(), F.least("place", "tokens")).otherwise(F.col("tokens"))
    return used.select("doc_id", "source", "epoch", "tokens", taken.alias("taken"))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """The rows of docs that ``mixture`` uses, as often as it uses them, columns unchanged."""
    cuts = _cuts(materialize(_slim(docs)), weights, total)
    names = {x: fresh(f"mix_{x}_", docs) for x in ("source", "key", "l1", "l2", "epochs", "place", "cut")}
    one, two = locator(docs)
    rows = docs.withColumns({names["source"]: col(docs, "source").cast("string"), names["key"]: key_of(col(docs, "doc_id"), col(docs, "text")), names["l1"]: one, names["l2"]: two})
    used = _chosen(rows, cuts, names)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["epochs"])))
    return used.withColumn(names["place"], again).select([F.col(f"`{c}`") for c in docs.columns])
