"""Documents and awkward rows for the corpus operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "nat rel sim tor vek wuz".split()]


def prose(seed, n=60, words=WORDS):
    rnd = random.Random(seed)
    return " ".join(rnd.choices(words, k=n))


def docs(spark, rows, schema=DOCS):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *(None, "en", "a")[len(r) - 1 :])[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, len(text) if text else 0))
    return spark.createDataFrame(full, schema)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, shared doc_ids, and columns whose names clash."""
    from pyspark.sql import functions as F

    long = prose(99, 60000)
    base = docs(spark, [
        (1, prose(1), "en", "a"), (1, prose(1), "en", "a"), (2, prose(1), "en", "a"), (None, prose(1), "en", "a"), (3, None, "en", "a"), (3, None, "en", "a"), (4, "", "en", "a"), (5, "", None, None),
        (6, "   \n\t", "de", None), (7, long, "fr", "b"), (8, long, "fr", "b"), (None, None, None, None), (9, "?!", "en", "b"), (9, prose(4), "en", "b"), (10, "Żółw 数据 🎉 ok", "xx", "b"),
    ])
    names = ["l1", "L2", "digest", "kept", "tokens", "key", "cell", "f1", "doc", "epochs", "place", "w", "act", "n", "quality_", "l1_", "Mix_Source_"]
    return base.withColumns({c: F.lit(i) for i, c in enumerate(names)}).withColumn("a.b", F.lit("dot")).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))


def empty(df):
    return df.filter("false")
