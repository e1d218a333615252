"""Exact deduplication against a history, through a minimal perfect hash of its distinct digests.

Rows are reduced to (locator, doc_id, SHA-256 of the text). The history's distinct digests are split into
shards by their leading bits, and each shard gets a minimal perfect hash (a cascade of bit arrays: a
digest that lands alone in a level is placed there, the rest go on). Its slots hold the full 32-byte
digest and the locator of the winning row. The batch's distinct digests go to the same shards, find their
slot and are compared byte for byte: a match is a repeat of the history; what does not match is no
member and is grouped on its own. Text never takes part in a shuffle. The hash (``index``) is a table: it can be
written, and read for every batch to come.

Winner of a group: the least doc_id (nulls last, then the row's content hash), in the history if any of
its rows has the text, else in the batch.

Defined results
* A null text equals nothing: each such row is kept, with itself as winner. The empty text is a text.
* Of rows equal in every column one stays. Rows that share a doc_id are still separate rows.
* doc_ids are integers; one that isn't is treated as null. Very long texts are digested whole. An empty history or an empty batch is fine.
* Extra columns pass through ``keep_first`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import materialize
from .common import col, drop_rows, locator, min_by_order
from .textvec import mix

#: Distinct digests in a shard, on average.
SHARD_DIGESTS = 1 << 15
GAMMA = 2.0


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each digest (four 64-bit words) in a level's array; all 256 bits and the level take part."""
    h = np.full(len(words), level * 2 + 1, np.uint64)
    for i in range(4):
        h = mix(h + words[:, i])
    return (h % np.uint64(size)).astype(np.int64)


def words_of(digests: list[bytes] | bytes) -> np.ndarray:
    return np.frombuffer(digests if isinstance(digests, bytes) else b"".join(digests), "<u8").reshape(-1, 4)


def build(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits, for distinct digests; every digest ends alone in some level."""
    sizes, bits = [], []
    while len(words):
        size = int(len(words) * GAMMA) + 64
        at = _place(words, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        words = words[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest: below the number of members, different for each member; -1 if it falls through."""
    rank = np.cumsum(bits) - bits
    out = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _place(words[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


_SHARD = "shard int, shards int, sizes array<int>, bits binary, digests binary, winners array<struct<doc_id:bigint,l1:bigint,l2:bigint>>"
_FOUND = "digest binary, member boolean, w struct<doc_id:bigint,l1:bigint,l2:bigint>"


def _build_shard(rows: pa.Table) -> pa.Table:
    digests = b"".join(rows.column("digest").to_pylist())
    words = words_of(digests)
    sizes, bits = build(words)
    order = np.argsort(slots(words, sizes, bits))
    kept = np.frombuffer(digests, np.uint8).reshape(-1, 32)[order].tobytes()
    winners = rows.column("w").combine_chunks().take(pa.array(order))
    return pa.table({
        "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
        "shards": pa.array([rows.column("shards")[0].as_py()], pa.int32()),
        "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "digests": pa.array([kept], pa.binary()),
        "winners": pa.ListArray.from_arrays(pa.array([0, len(winners)], pa.int32()), winners),
    })


def _look_up(shard: pa.Table, rows: pa.Table) -> pa.Table:
    own = rows.column("w").combine_chunks()
    digests = rows.column("digest").combine_chunks()
    member = np.zeros(len(rows), bool)
    if shard.num_rows and len(rows):
        sizes = shard.column("sizes")[0].as_py()
        bits = np.unpackbits(np.frombuffer(shard.column("bits")[0].as_py(), np.uint8))[: sum(sizes)].astype(bool)
        held = np.frombuffer(shard.column("digests")[0].as_py(), np.uint8).reshape(-1, 32)
        raw = b"".join(digests.to_pylist())
        at = slots(words_of(raw), sizes, bits)
        member = (at >= 0) & (held[np.maximum(at, 0)] == np.frombuffer(raw, np.uint8).reshape(-1, 32)).all(1)
        winners = shard.column("winners").combine_chunks().values
        both = pa.concat_arrays([own, winners.cast(own.type)])
        own = both.take(pa.array(np.where(member, len(own) + np.maximum(at, 0), np.arange(len(own)))))
    return pa.table({"digest": digests, "member": pa.array(member), "w": own})


def _digests(docs: DataFrame) -> DataFrame:
    """l1, l2, doc_id and digest of every row, as a table."""
    one, two = locator(docs)
    return materialize(docs.select(one.alias("l1"), two.alias("l2"), col(docs, "doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(col(docs, "text"), 256)).alias("digest")))


def _distinct(rows: DataFrame) -> DataFrame:
    """digest, w (doc_id, l1, l2 of its winner) and n of every digest, as a table."""
    order = (F.col("doc_id"), F.col("l1"), F.col("l2"))
    return materialize(rows.filter("digest is not null").groupBy("digest").agg(min_by_order(F.struct("doc_id", "l1", "l2"), *order).alias("w"), F.count("*").alias("n")))


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    of = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return distinct.select(of.alias("shard"), F.lit(shards).alias("shards"), "digest", "w")


def index(history: DataFrame) -> DataFrame:
    """The minimal perfect hash of a history's distinct texts: a table, one row a shard, to be written and kept."""
    distinct = _distinct(_digests(history))
    shards = max(1, -(-distinct.count() // SHARD_DIGESTS))
    return materialize(_sharded(distinct, shards).groupBy("shard").applyInArrow(_build_shard, _SHARD))


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, batch): by a hash of the doc_id, half of the rows have come before; the others, and null doc_ids, come now."""
    old = F.coalesce(F.md5(col(docs, "doc_id").cast("string")) < "8", F.lit(False))
    return docs.filter(old), docs.filter(~old)


def _verdicts(docs: DataFrame, history: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows: l1, l2, doc_id, digest; verdicts: digest, member, w) of a batch against the hash of a history."""
    rows = _digests(docs)
    distinct = _distinct(rows)
    shards = history.agg(F.max("shards")).first()[0] if history is not None else None
    if shards is None:
        return rows, distinct.select("digest", F.lit(False).alias("member"), "w")
    batch = _sharded(distinct, shards).drop("shards")
    return rows, materialize(history.groupBy("shard").cogroup(batch.groupBy("shard")).applyInArrow(_look_up, _FOUND))


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest (hex), winner_id (doc_id of the group's kept row, in the history or here), kept.

    history is the ``index`` of what came before; without one the docs are only compared with each other.
    """
    rows, verdicts = _verdicts(docs, history)
    place = F.row_number().over(Window.partitionBy("digest", "l1", "l2").orderBy("doc_id"))
    text = rows.filter("digest is not null").join(verdicts, "digest").withColumn("place", place)
    kept = ~F.col("member") & (F.col("l1") == F.col("w.l1")) & (F.col("l2") == F.col("w.l2")) & (F.col("place") == 1)
    none = rows.filter("digest is null").select("doc_id", F.lit(None).cast("string").alias("digest"), F.col("doc_id").alias("winner_id"), F.lit(True).alias("kept"))
    return text.select("doc_id", F.lower(F.hex("digest")).alias("digest"), F.col("w.doc_id").alias("winner_id"), kept.alias("kept")).unionByName(none)


def of_both_halves(docs: DataFrame) -> DataFrame:
    """``exact_duplicates`` of a whole table: of its history by itself, and of the batch against it."""
    history, batch = halves(docs)
    return exact_duplicates(history).unionByName(exact_duplicates(batch, index(history)))


def keep_first(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """docs without the rows that ``exact_duplicates`` does not keep, columns unchanged."""
    rows, verdicts = _verdicts(docs, history)
    wins = ~F.col("member") & (F.col("l1") == F.col("w.l1")) & (F.col("l2") == F.col("w.l2"))
    placed = materialize(rows.filter("digest is not null").join(verdicts, "digest").select("l1", "l2", wins.alias("wins")))
    losers = materialize(placed.filter("not wins").select("l1", "l2").distinct())
    repeated = materialize(placed.filter("wins").groupBy("l1", "l2").agg(F.count("*").alias("n")).filter("n > 1").select("l1", "l2"))
    return drop_rows(docs, losers, repeated)
