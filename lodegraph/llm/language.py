"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

The model is fitted to at most ``LABELLED_ROWS`` documents of up to LONGEST_SAMPLE characters that carry a language,
drawn by hash and in turn from each language, so that a rare one counts whole. Three in four train it; the rest calibrate it: a temperature is chosen by likelihood, and the threshold is the
confidence that all but ``REJECT_SHARE`` of the correctly named calibration documents reach, kept within
``THRESHOLD_RANGE``. A document below the threshold is ``und``.

Defined results
* A null text, or one without any letter, is ``und`` with confidence 0.
* A null language in the table only keeps the row out of training. With no labelled document at all,
  every row is ``und`` with confidence 0; with a single language, rejection alone can tell.
* Of languages with equal probabilities the first in code point order is named; a confidence of exactly the threshold
  is not rejected.
* Repeated rows and equal doc_ids are scored one by one; very long texts are scored whole, in pieces whose sums are
  added; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST_SAMPLE, col, hash_sample
from .subword import Model, Spec, train

LABELLED_ROWS = 3000
REJECT_SHARE = 0.001
THRESHOLD_RANGE = (0.5, 0.9)
UNKNOWN = "und"
SPEC = Spec(buckets=1 << 16, dim=16, chars=(2, 3), pairs=False, lower=True, rate=1.0, epochs=6)


def calibrate(model: Model, texts: list[str], langs: list[str]) -> Model:
    """Set the temperature and the rejection threshold from documents the model has not seen."""
    if not texts:
        model.threshold = THRESHOLD_RANGE[0]
        return model
    y = np.array([model.classes.index(v) if v in model.classes else -1 for v in langs])
    z = model.logits(texts)
    known = y >= 0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 16, 49):
        s = z[known] / t
        s = s - s.max(1, keepdims=True)
        loss = -(s[np.arange(len(s)), y[known]] - np.log(np.exp(s).sum(1))).mean() if len(s) else 0.0
        best = min(best, (float(loss), float(t)))
    model.temperature = best[1]
    p = model.proba(texts)
    right = p.max(1)[known & (p.argmax(1) == y)]
    cut = float(np.quantile(right, REJECT_SHARE)) if len(right) else THRESHOLD_RANGE[0]
    model.threshold = min(max(cut, THRESHOLD_RANGE[0]), THRESHOLD_RANGE[1])
    return model


def fit(docs: DataFrame, rows: int = LABELLED_ROWS) -> Model | None:
    """A calibrated model, or None if no document carries a language."""
    slim = docs.select(col(docs, "doc_id").alias("id"), col(docs, "text").alias("t"), col(docs, "lang").alias("y")).filter((F.length("t") <= LONGEST_SAMPLE) & F.col("y").isNotNull())
    got = hash_sample(slim, F.struct("id", "t"), rows, "y").collect()
    if not got:
        return None
    part = np.arange(len(got)) % 4 == 3
    model = train([r["t"] for r, c in zip(got, part) if not c], [r["y"] for r, c in zip(got, part) if not c], SPEC)
    return calibrate(model, [r["t"] for r, c in zip(got, part) if c], [r["y"] for r, c in zip(got, part) if c])


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    p = model.proba(texts)
    best, top = p.argmax(1), p.max(1)
    top = np.where([bool(t) and any(map(str.isalpha, t)) for t in texts], top, 0.0)
    return [model.classes[b] if c >= model.threshold else UNKNOWN for b, c in zip(best, top)], top


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang (as the table has it), predicted and confidence, for every row of docs."""
    slim = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "lang").alias("lang"), col(docs, "text").alias("text"))
    model = fit(slim)
    if model is None:
        return slim.select("doc_id", "lang", F.lit(UNKNOWN).alias("predicted"), F.lit(0.0).alias("confidence"))

    @F.arrow_udf("struct<predicted string, confidence double>")
    def name(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            lang, p = predict(model, text.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.round(p, 6))], ["predicted", "confidence"])

    return slim.withColumn("p", name("text")).select("doc_id", "lang", "p.predicted", "p.confidence")
