"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent.

The model (``subword``) learns from at most ``LABELLED_ROWS`` labelled documents of up to LONGEST_SAMPLE characters,
drawn by the hash of their doc_id and in turn from both classes, so that a rare class counts whole; every document is
then scored over its whole text in one map-only pass.

Defined results
* A text that is null or holds nothing but white space has no feature: score 0, rejected.
* Labels other than 0 and 1, null labels and labels of unknown documents are not used. A doc_id labelled
  both ways is not used either. If only one class or none is left, there is nothing to learn: every
  score is null and every document is kept.
* Repeated rows and rows that share a doc_id are scored one by one; for training, a shared doc_id counts
  once, with its least text. Very long texts are scored whole, in pieces whose sums are added. An empty table gives
  an empty result.
* A score of exactly LEAST_SCORE is kept; equal texts have equal scores.
* Extra columns pass through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import materialize, sized
from .common import LONGEST_SAMPLE, col, fresh, hash_sample
from .subword import Model, Spec, train

#: Bound on the labelled documents that the classifier is fitted to.
LABELLED_ROWS = 3000
#: Least probability of being good at which a document stays.
LEAST_SCORE = 0.3
SPEC = Spec(buckets=1 << 16, dim=16, chars=(3, 4), pairs=True, rate=1.0, epochs=8)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``rows`` labelled documents, in turn from each class in hash order of doc_id."""
    one = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    one = materialize(one.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("id", "y"))
    ids = docs.select(col(docs, "doc_id").cast("long").alias("id"))
    known = materialize(ids.join(sized(one, one.count(), 32), "id").distinct())
    # Twice the bound: some texts may be null or long.
    pick = hash_sample(known, F.col("id"), 2 * rows, "y")
    text = docs.select(col(docs, "doc_id").cast("long").alias("id"), col(docs, "text").alias("t")).filter(F.length("t") <= LONGEST_SAMPLE)
    found = text.join(F.broadcast(pick), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    got = found.withColumn("place", place).orderBy("place", "y").limit(rows).collect()
    return [r["t"] for r in got], [r["y"] for r in got]


def fit(docs: DataFrame, labels: DataFrame, spec: Spec = SPEC) -> Model | None:
    """A model of good (1) against poor (0) documents, or None where one class has no example."""
    texts, y = labelled(docs, labels)
    return train(texts, y, spec) if len(set(y)) == 2 else None


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    p = model.proba(texts)[:, 1]
    return np.where([bool(t and t.strip()) for t in texts], p, 0.0)


def scorer(model: Model) -> Callable:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(scores(model, text.to_pylist()))

    return score


def with_score(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    model = fit(docs, labels)
    return docs.withColumn(name, F.lit(None).cast("double") if model is None else scorer(model)(col(docs, "text")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality_score (probability of being good) and keep, for every row of docs."""
    slim = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"))
    out = with_score(slim, labels, "quality_score")
    return out.select("doc_id", F.round("quality_score", 6).alias("quality_score"), F.coalesce(F.col("quality_score") >= LEAST_SCORE, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that ``classify`` rejects, columns unchanged."""
    name = fresh("quality_", docs)
    out = with_score(docs, labels, name)
    return out.filter(F.coalesce(F.col(name) >= LEAST_SCORE, F.lit(True))).select([F.col(f"`{c}`") for c in docs.columns])
