"""Tokenisers as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import BROADCAST_BYTES, materialize

#: A key's width in a broadcast.
KEY_BYTES = 64

_SHARED = """a about all an and are as at be been being both but by can class could dare did do does each few for from function
get had has have he i if in is it its just may me might more most must my need new no not of on only or other our out own same set
shall she should so some such than that the these they this those to too up very was we were will with would you your""".split()
#: Words that TF-IDF leaves out.
INDEX_STOP_WORDS = frozenset(_SHARED) | frozenset("const enum every export false import interface let null require return struct true type undefined var void".split())
#: Words that a context query leaves out.
QUERY_STOP_WORDS = frozenset(_SHARED) | frozenset(
    """above add after again because before below between build change code create during file files fix further her here him how
    implement into make method modify nor off once over then them there through under update use using what when where which
    while who whom whose why write""".split()
)


def _split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def index_tokens(text: Column) -> Column:
    """Tokens for TF-IDF, repeats kept: camel case and _ - . / \\ : split; 2 to 39 characters; no stop words."""
    words = F.split(F.lower(F.regexp_replace(_split_camel(F.coalesce(text, F.lit(""))), r"[_\-./\\:]", " ")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & (F.length(w) < 40) & ~w.isin(*sorted(INDEX_STOP_WORDS)))


def merged(rows: DataFrame, key: str, fields: tuple[str, ...], nulls: bool = True) -> DataFrame:
    """key and the fields: one row for each key; the texts of a repeated one are joined by blanks, which part tokens.

    Repeated keys are counted first, from the keys alone: a text moves only if its key is repeated, all others stay in
    the row they are in, where a task needs no memory for them. Nulls are one key, or, without ``nulls``, none: their
    rows stay as they are.
    """
    named = rows if nulls else rows.filter(F.col(key).isNotNull())
    again = named.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key"))
    n = again.count()
    single = rows.select(key, *[F.coalesce(f, F.lit("")).alias(f) for f in fields])
    if not n:
        return single
    if n * KEY_BYTES > BROADCAST_BYTES:
        joined = _joined(named, key, fields)
        return joined if nulls else joined.unionByName(single.filter(F.col(key).isNull()))
    again = F.broadcast(materialize(again))
    same = F.col(key).eqNullSafe(F.col("_key"))
    return single.join(again, same, "left_anti").unionByName(_joined(rows.join(again, same, "left_semi"), key, fields))


def _joined(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """A window and not an aggregate: texts are sorted by key once, after they have moved, and held for one key at a time."""
    same = Window.partitionBy(key)
    lists = rows.select(key, *[F.array_join(F.collect_list(f).over(same), " ").alias(f) for f in fields], F.row_number().over(same.orderBy(key)).alias("_no"))
    return lists.filter("_no = 1").drop("_no")


def counted(rows: DataFrame, tokens: str) -> DataFrame:
    """rows with the array ``tokens`` replaced by ``entries``: each distinct token of the row with n, its number, by token.

    Counting stays within the row, whose sorted tokens are cut into runs: a task holds one row's tokens at a time. The
    steps are columns of their own, or the optimizer would sort anew for each element.
    """
    t, at = F.col("_t"), F.col("_at")
    sorted_ = rows.withColumn("_t", F.sort_array(tokens)).drop(tokens)
    runs = sorted_.withColumn("_at", F.filter(F.transform(t, lambda w, i: F.when((i == 0) | (w != F.get(t, i - 1)), i)), lambda i: i.isNotNull()))
    entry = F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("n")))
    return runs.withColumn("entries", entry).drop("_t", "_at")


def query_keywords(text: Column) -> Column:
    """Keywords of a context query: distinct, in order of first use."""
    words = F.split(F.lower(F.regexp_replace(_split_camel(text), "_", " ")), r"[\s,;:.!?/\\]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(QUERY_STOP_WORDS))))


def _folds() -> tuple[str, str]:
    """Lower-case letters with diacritics, of all scripts, and the plain letters they fold to."""
    pairs = []
    for c in map(chr, range(0xC0, 0x10000)):
        plain = unicodedata.normalize("NFD", c)
        if len(plain) > 1 and c == c.lower() and unicodedata.category(c)[0] == "L" and all(map(unicodedata.combining, plain[1:])):
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folds()
_MARKS = "[\\u0300-\\u036f]"


def fts_tokens(text: Column) -> Column:
    """Tokens for keyword search, repeats kept: runs of letters and digits, lower case, without diacritics."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Folding looks up each letter; text of one byte a letter has none to fold.
    folded = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(F.regexp_replace(low, _MARKS, ""), _ACCENTED, _PLAIN))
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def fts_terms(query: str) -> list[str]:
    """Terms of a keyword query after its special characters are blanked; the last one is a prefix."""
    import re

    clean = re.sub(r"[^A-Za-z0-9_\s]", " ", query).strip()
    folded = "".join(c for c in unicodedata.normalize("NFD", clean.lower()) if not unicodedata.combining(c))
    return [t for t in re.split(r"[^0-9a-z]+", folded) if t]
