"""SimHash near-duplicate removal over a segment-popcount embedding.

A text's fingerprint has 128 bits: its distinct words (lower case, letters and digits) vote on every bit with a
weight that grows with their length. Scripts written without spaces vote by pairs of neighbouring characters, and
texts of fewer than ``MIN_WORDS`` words by their letters' trigrams: a word more or less would be all or nothing there.

All pairs of distinct fingerprints within Hamming distance ``MAX_DISTANCE`` are found, none is left to chance:

1. The bits are cut into ``GROUPS`` groups with radii that add up to MAX_DISTANCE - GROUPS + 1. A pair within the
   distance is within the radius in one group at least, else its distance were greater.
2. A group's bits are cut into segments and mapped to the segments' bit counts. Flipping one bit moves one count by
   one, so the Manhattan distance of two such vectors bounds the Hamming distance from below. The counts are the
   cells of a grid: a fingerprint is a member of its own cell and a guest of the cells after it within the radius,
   so that two that may be near meet in exactly one cell. More fingerprints take more segments, which keeps cells
   to about CELL_ROWS. A cell that is fuller still is cut into blocks, and each pair of blocks meets.
3. Within a cell members are sorted by their bits of the group, those of each other member or guest are looked up
   with every set of up to radius flips, and the exact distance decides. A pair counts in the first group that finds it.

A cell returns, per fingerprint, its number of links and one edge towards a representative of what it is connected
to there, hence no more rows than it was given. Groups of near duplicates are the connected components of the
edges. The kept row of a group has the least doc_id (nulls last, then the row's content hash).

Defined results
* A null text, or one without any letter or digit, has no fingerprint: kept, in no group, without links.
* Very long texts are fingerprinted whole, piece by piece; what counts as short has no bearing on them.
* Equal texts and repeated rows share a fingerprint and therefore a group; of rows equal in every
  column one stays. A null doc_id takes part like any other and loses ties.
* An empty table gives an empty result. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import materialize, sized
from .common import col, drop_rows, locator, min_by_order
from .textvec import SLICE_CHARS, codes, is_word, mix, owners, pieces, slices, span_hashes, spans, unspaced

BITS = 128
MAX_DISTANCE = 20
GROUPS = 7
MIN_WORDS = 8
#: Members and guests that a cell, or a pair of blocks of a fuller one, holds.
CELL_ROWS = 1 << 19
#: Pairs looked at together within a task.
CHUNK = 1 << 20
#: Distinct words that vote together.
VOTERS = 1 << 14


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the distinct words of one text, read piece by piece."""
    hashes, weights = [], []
    for a, b in pieces(text):
        _, h, weight = _votes(codes([text[a:b].lower()])[0])
        h, first = np.unique(h, return_index=True)
        hashes.append(h)
        weights.append(weight[first])
    h, first = np.unique(np.concatenate(hashes), return_index=True)
    return h, np.concatenate(weights)[first]


def _votes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and weight of every word, and of every pair of characters of scripts without spaces."""
    word, bare = is_word(cp), unspaced(cp)
    parts = [spans(word & ~bare)]
    if bare.any():
        pair = np.flatnonzero(bare[:-1] & bare[1:])
        parts += [(pair[pair % 2 == k], pair[pair % 2 == k] + 2) for k in (0, 1)]  # neighbours overlap, so each half by itself
        lone = np.flatnonzero(bare & ~np.append(bare[1:], False) & ~np.insert(bare[:-1], 0, False))
        parts.append((lone, lone + 1))
    h = np.concatenate([span_hashes(cp, s, e) for s, e in parts])
    s, e = (np.concatenate(x) for x in zip(*parts))
    return s, h, np.sqrt(np.maximum(e - s - 2, 0.25)).astype(np.float32)


def _trigrams(cp: np.ndarray, starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every letter with its two neighbours, a gap between words being one space, in the documents marked."""
    word = is_word(cp)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    use = of[doc] & (word | np.insert(word[:-1], 0, False))
    c, d, letter = np.where(word, cp, 32)[use].astype(np.uint64), doc[use], word[use]
    same = d[1:] == d[:-1]
    space = np.uint64(32)
    before, after = np.where(np.insert(same, 0, False), np.roll(c, 1), space), np.where(np.append(same, False), np.roll(c, -1), space)
    return d[letter], mix(mix(mix(before + np.uint64(5)) + c) + after)[letter]


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """[texts, 2] int64 fingerprints and a mask of the texts that have one."""
    out = np.zeros((len(texts), 2), np.int64)
    has = np.zeros(len(texts), bool)
    for a, b in slices(texts):
        if len(texts[a] or "") > SLICE_CHARS:
            h, weight = _words(texts[a])
            d = np.zeros(len(h), np.int64)
        else:
            cp, starts = codes([t.lower() if t else t for t in texts[a:b]])
            s, h, weight = _votes(cp)
            d = owners(starts, s)
            few = np.bincount(d, minlength=b - a) < MIN_WORDS
            if few.any():
                td, th = _trigrams(cp, starts, few)
                many = ~few[d]
                d, h, weight = np.append(d[many], td), np.append(h[many], th), np.append(weight[many], np.ones(len(th), np.float32))
            order = np.lexsort((h, d))
            h, d, weight = h[order], d[order], weight[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d, weight = h[first], d[first], weight[first]
        if not len(h):
            continue
        whole = np.bincount(d, weights=weight, minlength=b - a)
        for half in range(2):
            total = np.zeros((b - a, 64))
            for at in range(0, len(h), VOTERS):
                cut = slice(at, at + VOTERS)
                votes = np.unpackbits(mix(h[cut] + np.uint64(1 + 7919 * half)).view(np.uint8).reshape(-1, 8), axis=1)
                head = np.flatnonzero(np.diff(d[cut], prepend=-1))
                total[d[cut][head]] += np.add.reduceat(votes * weight[cut, None], head, axis=0, dtype=np.float64)
            out[a:b, half] = np.packbits(total * 2 > whole[:, None], axis=1).view(np.int64)[:, 0]
        has[a + np.unique(d)] = True
    return out, has


def radii() -> list[int]:
    """The radius of each group: they add up to MAX_DISTANCE - GROUPS + 1."""
    return [(MAX_DISTANCE - GROUPS + 1 + i) // GROUPS for i in range(GROUPS)]


def cut(n: int, parts: int) -> list[tuple[int, int]]:
    """n bits in ``parts`` ranges of nearly equal size."""
    at = [n * i // parts for i in range(parts + 1)]
    return list(itertools.pairwise(at))


def bits_of(f: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits [lo, hi) of [rows, 2] uint64 fingerprints as numbers; the range has 64 bits at most."""
    x = f[:, 0] >> np.uint64(lo) if lo < 64 else f[:, 1] >> np.uint64(lo - 64)
    if lo < 64 < hi:
        x = x | f[:, 1] << np.uint64(64 - lo)
    return (x & np.uint64((1 << hi - lo) - 1)).astype(np.int64)


def segments_for(n: int) -> int:
    """Segments of a group such that the fullest cell holds about CELL_ROWS of n unrelated fingerprints; at least one."""
    width = BITS // GROUPS
    for segments in range(1, width):
        share = 1.0
        for lo, hi in cut(width, segments):
            share *= comb(hi - lo, (hi - lo) // 2) / 2 ** (hi - lo)
        if n * share <= CELL_ROWS:
            return segments
    return width


@cache
def moves(segments: int, radius: int) -> np.ndarray:
    """Every step of Manhattan length up to ``radius`` whose first change is upwards, and no step at all, which is first."""
    out = [s for s in _steps(segments, radius) if next((x for x in s if x), 0) >= 0]
    return np.array(sorted(out, key=lambda s: sum(map(abs, s))), np.int64)


def _steps(n: int, radius: int) -> Iterator[tuple[int, ...]]:
    if not n:
        yield ()
        return
    for x in range(-radius, radius + 1):
        for rest in _steps(n - 1, radius - abs(x)):
            yield (x, *rest)


def cells(f: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(group, rows, their cells, whether these are guests) of [rows, 2] uint64 fingerprints."""
    for g, ((lo, hi), radius) in enumerate(zip(cut(BITS, GROUPS), radii())):
        parts = [(lo + a, lo + b) for a, b in cut(hi - lo, segments)]
        counts = np.stack([np.bitwise_count(bits_of(f, *p)) for p in parts], axis=1).astype(np.int64)
        most = np.array([b - a for a, b in parts])
        scale = np.concatenate([[1], np.cumprod(most[:-1] + 1)])
        for step in moves(segments, radius):
            to = counts + step
            rows = np.flatnonzero(((to >= 0) & (to <= most)).all(1))
            yield g, rows, to[rows] @ scale, bool(step.any())


@cache
def flips(width: int, radius: int) -> np.ndarray:
    """Every number of ``width`` bits with up to ``radius`` ones, zero first."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(range(width), k)], np.int64)


def _sorted(keys: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], f[order], order


def met(keys: np.ndarray, f: np.ndarray, own: tuple, group: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near fingerprints: of f (any order; None: the sorted ones themselves) and of the sorted ``own``."""
    lo, hi = cut(BITS, GROUPS)[group]
    okeys, of, order = own
    same = f is None
    if same:
        keys, f = okeys, of
    if not len(okeys) or not len(keys):
        return
    start = np.zeros((1 << hi - lo) + 1, np.int32)
    np.cumsum(np.bincount(okeys, minlength=len(start) - 1), out=start[1:])
    masks = flips(hi - lo, radii()[group])
    many = max(1, CHUNK // len(keys))
    for m in range(0, len(masks), many):
        probe = keys[None, :] ^ masks[m : m + many, None]
        n = start[probe + 1] - start[probe]
        if same:  # each pair once: the key looked up is the greater one, or the place where keys are equal
            n[probe < keys] = 0
        which = np.flatnonzero(n)
        n, first, row = n.ravel()[which], start[probe.ravel()[which]], which % len(keys)
        ends = np.cumsum(n, dtype=np.int64)
        at = 0
        while at < len(n):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            k = n[at:to]
            b = np.repeat(row[at:to], k)
            a = np.arange(len(b)) + np.repeat(first[at:to] - (ends[at:to] - k - done), k)
            ok = np.bitwise_count(of[a, 0] ^ f[b, 0]) <= MAX_DISTANCE
            if same:
                ok &= (a > b) | (okeys[a] != keys[b])
            a, b = a[ok], b[ok]
            one, two = of[a, 0] ^ f[b, 0], of[a, 1] ^ f[b, 1]
            ok = np.bitwise_count(one) + np.bitwise_count(two) <= MAX_DISTANCE
            a, b, x = a[ok], b[ok], np.stack([one[ok], two[ok]], axis=1)
            for (i, j), radius in zip(cut(BITS, GROUPS)[:group], radii()):  # found in an earlier group already?
                ok = np.bitwise_count(bits_of(x, i, j)) > radius
                a, b, x = a[ok], b[ok], x[ok]
            if len(a):
                yield order[a], order[b] if same else b
            at = to


class Links:
    """Links among n rows: their number for each row, and the least row that each is connected to."""

    def __init__(self, n: int) -> None:
        self.count, self.root = np.zeros(n, np.int64), np.arange(n)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count += np.bincount(a, minlength=len(self.count)) + np.bincount(b, minlength=len(self.count))
        self._held.append((a, b))
        self._size += len(a)
        if self._size > CHUNK:
            self.unite()

    def unite(self) -> None:
        if self._held:
            a, b = (np.concatenate(x) for x in zip(*self._held))
            while True:
                a, b = self.root[a], self.root[b]
                apart = a != b
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
                while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                    self.root = up
        self._held, self._size = [], 0


_CELL = "g int, cell long, i int, j int, guest boolean, side int, f1 long, f2 long"
_LINKS = "f1 long, f2 long, r1 long, r2 long, links long"


def _meet(rows: pa.Table) -> pa.Table:
    """Links within one cell, or between two blocks (sides 0 and 1) of it; two guests of a cell don't concern it."""
    f = np.stack([np.asarray(rows.column(c).combine_chunks()) for c in ("f1", "f2")], axis=1)
    order = np.lexsort((f[:, 1], f[:, 0]))  # the same whatever order the rows come in
    u = f[order].view(np.uint64)
    guest, side = (np.asarray(rows.column(c).combine_chunks())[order] for c in ("guest", "side"))
    group = rows.column("g")[0].as_py()
    keys = bits_of(u, *cut(BITS, GROUPS)[group])
    links = Links(len(u))

    def between(one: np.ndarray, two: np.ndarray | None) -> None:
        own = _sorted(keys[one], u[one])
        for a, b in met(None, None, own, group) if two is None else met(keys[two], u[two], own, group):
            links.add(one[a], one[b] if two is None else two[b])

    if side.any():
        zero, one = np.flatnonzero(~guest & (side == 0)), np.flatnonzero(~guest & (side == 1))
        between(zero, np.flatnonzero(side == 1))
        between(one, np.flatnonzero(guest & (side == 0)))
    else:
        member = np.flatnonzero(~guest)
        between(member, None)
        between(member, np.flatnonzero(guest))
    links.unite()
    k = np.flatnonzero(links.count)
    r = f[order][links.root[k]]
    f = f[order][k]
    return pa.table({"f1": f[:, 0], "f2": f[:, 1], "r1": r[:, 0], "r2": r[:, 1], "links": links.count[k]})


def near_links(prints: DataFrame, n: int) -> DataFrame:
    """(f1, f2, r1, r2, links) of n distinct fingerprints (f1, f2): what each cell found.

    The links of a fingerprint add up over its rows; (f1, f2) and (r1, r2) are connected, and these edges connect
    whatever the links connect.
    """
    segments = segments_for(n)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([np.asarray(batch.column(i)) for i in range(2)], axis=1)
            for g, rows, cell, guest in cells(f.view(np.uint64), segments):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g, np.int32)), pa.array(cell), pa.array(np.full(len(rows), guest)), pa.array(f[rows, 0]), pa.array(f[rows, 1])], ["g", "cell", "guest", "f1", "f2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([np.asarray(batch.column(i)) for i in range(2)], axis=1).view(np.uint64)
            for g, _, cell, _ in cells(f, segments):
                u, k = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), g, np.int32)), pa.array(u), pa.array(k)], ["g", "cell", "k"])

    slim = prints.select("f1", "f2")
    load = slim.mapInArrow(count, "g int, cell long, k long").groupBy("g", "cell").agg(F.sum("k").alias("k"))
    full = materialize(load.filter(F.col("k") > CELL_ROWS).select("g", "cell", F.ceil(2 * F.col("k") / CELL_ROWS).cast("int").alias("blocks")))
    placed = slim.mapInArrow(emit, "g int, cell long, guest boolean, f1 long, f2 long")
    placed = placed.join(sized(full, full.count(), 64), ["g", "cell"], "left").withColumn("mine", F.pmod(F.xxhash64("f1", "f2"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    placed = placed.select("g", "cell", "guest", "f1", "f2", "mine", other)
    placed = placed.select("g", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "guest", (F.col("mine") > F.col("other")).cast("int").alias("side"), "f1", "f2")
    return placed.groupBy("g", "cell", "i", "j").applyInArrow(_meet, _LINKS)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the distinct pairs (u, v), u and v not equal: root is the least node of its component.

    Alternating large-star and small-star contraction; each round is materialised, and the number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = materialize(small)
        # Finished once every node hangs on one root and no root hangs on another.
        roots = after.groupBy("u").agg(F.count("*").alias("n"))
        more = roots.filter("n > 1").limit(1).count() or after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        edges = after
        if not more:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _decide(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprinted rows: l1, l2, doc_id, f1, f2), (f1, f2, w1, w2, keep_id, links) for fingerprints in groups of several rows."""
    one, two = locator(docs)
    slim = docs.select(one.alias("l1"), two.alias("l2"), col(docs, "doc_id").cast("long").alias("doc_id"), col(docs, "text").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, has = fingerprints(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(f[:, 0], mask=~has), pa.array(f[:, 1], mask=~has)], ["l1", "l2", "doc_id", "f1", "f2"])

    rows = materialize(slim.mapInArrow(mark, "l1 long, l2 long, doc_id long, f1 long, f2 long"))
    order = (F.col("doc_id"), F.col("l1"), F.col("l2"))
    prints = materialize(rows.filter("f1 is not null").groupBy("f1", "f2").agg(min_by_order(F.struct("doc_id", "l1", "l2"), *order).alias("w"), F.count("*").alias("n")))
    found = materialize(near_links(prints, prints.count()))
    edges = found.filter("f1 <> r1 or f2 <> r2").select(F.struct("f1", "f2").alias("u"), F.struct(F.col("r1").alias("f1"), F.col("r2").alias("f2")).alias("v"))
    roots = components(edges.distinct())
    links = found.groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    grouped = prints.join(roots.select("node.f1", "node.f2", "root"), ["f1", "f2"], "left").filter("root is not null or n > 1").withColumn("root", F.coalesce("root", F.struct("f1", "f2")))
    best = grouped.groupBy("root").agg(min_by_order(F.col("w"), F.col("w.doc_id"), F.col("w.l1"), F.col("w.l2")).alias("keep"))
    named = grouped.join(best, "root").select("f1", "f2", F.col("keep.doc_id").alias("keep_id"), F.col("keep.l1").alias("w1"), F.col("keep.l2").alias("w2"))
    return rows, materialize(named.join(links, ["f1", "f2"], "left").withColumn("links", F.coalesce("links", F.lit(0))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, group_id (doc_id of the group's kept row, its own if alone), links, kept.

    links is the number of other fingerprints within the distance; rows of the same fingerprint aren't counted.
    """
    rows, groups = _decide(docs)
    found = rows.join(groups, ["f1", "f2"], "left")
    place = F.row_number().over(Window.partitionBy("l1", "l2").orderBy("doc_id"))
    alone = found.filter("w1 is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept"))
    inside = found.filter("w1 is not null").withColumn("place", place)
    return alone.unionByName(inside.select("doc_id", F.col("keep_id").alias("group_id"), "links", ((F.col("l1") == F.col("w1")) & (F.col("l2") == F.col("w2")) & (F.col("place") == 1)).alias("kept")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that ``near_duplicates`` does not keep, columns unchanged."""
    rows, groups = _decide(docs)
    inside = rows.join(groups, ["f1", "f2"])
    wins = (F.col("l1") == F.col("w1")) & (F.col("l2") == F.col("w2"))
    losers = materialize(inside.filter(~wins).select("l1", "l2").distinct())
    repeated = materialize(inside.filter(wins).groupBy("l1", "l2").agg(F.count("*").alias("n")).filter("n > 1").select("l1", "l2"))
    return drop_rows(docs, losers, repeated)
