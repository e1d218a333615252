"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector x to the integers floor((a_i . x + b_i) / width), with Gaussian a_i
(2-stable) and uniform b_i. A query visits its own bucket and perturbed ones: moving coordinate i by -1 or
+1 costs the squared distance to that side of its slot, a set of moves costs their sum, and sets are
visited by rising cost, which is the order of estimated success.

The index is fitted to the vectors there are. The true neighbours, among all rows, of at most ``FIT_QUERIES`` queries
are found by one scan. The width is twice the median distance of the last of them. Of the numbers of hashes and probes
in HASHES and PROBES that find at least the share ``FIT_RECALL`` of these true neighbours, the one is taken that compares least, measured
on FIT_ROWS rows. So hashes get more as neighbours get nearer, be it by clusters or by the number of rows; and where
vectors have so little structure that a bucket's share must be large, recall is held and cost is not.

Every row is indexed. Members and probes of a bucket meet in one group, or in several where a bucket has more
of either than a worker should hold: each block of members meets each block of probes, so nothing is left out.
Distances within a group are one matrix product in single precision; all members that may be among a query's ``k``
nearest within its error bound are measured exactly, and the query keeps its ``k`` nearest there. Its lists from all
buckets and tables are merged, repeats dropped, and reranked by exact distance; ties go to the lower vec_id.

Defined results
* A null or empty vector, one with a null or non-finite entry, or one whose length isn't the table's
  commonest (the least of several), is not indexed and has no line; nor has a null vec_id.
* Rows with equal vec_ids count once, with the least vector. Equal vectors under different ids are neighbours
  at distance 0. A vector is not its own neighbour.
* A table with one vector or none gives an empty result; one with k vectors or fewer gives what is found of the rest.
* Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import materialize, sized
from .common import col, hash_sample
from .textvec import mix

K = 10
TABLES = 3
HASHES = tuple(range(1, 13))
PROBES = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64)
FIT_QUERIES, FIT_ROWS, FIT_RECALL = 200, 4000, 0.95
#: Members and probes that meet in one group at most, on average over the blocks of a bucket.
MEMBER_BLOCK, PROBE_BLOCK = 1 << 14, 1 << 15
#: Decimal places of a distance; those equal in them are ties.
PLACES = 6
#: Queries whose lists are merged together.
MERGE = 4096
SEED = 42


def planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(a: [tables, hashes, dim], b: [tables, hashes], as shares of the width), for the most hashes there may be."""
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((TABLES, max(HASHES), dim)), rng.random((TABLES, max(HASHES)))


def perturbations(gaps: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` cheapest sets of moves for one query: rows of -1, 0, +1 per coordinate, the empty set first.

    gaps[i] is the distance of coordinate i to the lower end of its slot, as a share of the width. Sets come from a
    heap: each set leads to the one that shifts its last move to the next dearer one, and the one that adds that.
    """
    m = len(gaps)
    cost = np.concatenate([gaps**2, (1 - gaps) ** 2])
    order = np.argsort(cost, kind="stable")
    c = cost[order].tolist()
    moves = [(int(o) % m, -1 if o < m else 1) for o in order]
    out = np.zeros((probes, m), np.int64)
    done, heap = 1, [(c[0], (0,))]
    while heap and done < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - c[last] + c[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + c[last + 1], (*chosen, last + 1)))
        coords = [moves[x][0] for x in chosen]
        if len(set(coords)) == len(coords):
            for x in chosen:
                out[done, moves[x][0]] = moves[x][1]
            done += 1
    return out[:done]


def all_perturbations(gaps: np.ndarray, probes: int) -> np.ndarray:
    """``perturbations`` of many queries at once, [queries, probes, coordinates]; listed outright while that is small."""
    m = gaps.shape[1]
    if 3**m > 1024:
        return np.stack([perturbations(g, probes) for g in gaps])
    sets = np.array(list(itertools.product((0, -1, 1), repeat=m)), np.int64)
    cost = gaps**2 @ (sets == -1).T + (1 - gaps) ** 2 @ (sets == 1).T
    return sets[np.argsort(cost, axis=1, kind="stable")[:, : min(probes, len(sets))]]


@dataclass
class Plan:
    """Planes a (divided by the width) and shifts b of every table, and the buckets that a query visits in each."""

    a: np.ndarray
    b: np.ndarray
    probes: int

    def slots(self, x: np.ndarray, table: int) -> np.ndarray:
        """The vectors' coordinates in one table, in slots: the whole part names the slot."""
        return x @ self.a[table].T + self.b[table]

    def own(self, x: np.ndarray, table: int) -> np.ndarray:
        """Each vector's bucket."""
        return keys_of(np.floor(self.slots(x, table)).astype(np.int64))

    def visited(self, x: np.ndarray, table: int) -> np.ndarray:
        """The buckets that each query visits, [queries, probes], its own first."""
        t = self.slots(x, table)
        home = np.floor(t).astype(np.int64)
        return keys_of(home[:, None, :] + all_perturbations(t - home, self.probes))


def keys_of(slots: np.ndarray) -> np.ndarray:
    """64-bit keys of buckets: rows of whole numbers."""
    h = np.zeros(slots.shape[:-1], np.uint64)
    for i in range(slots.shape[-1]):
        h = mix(h + slots[..., i].astype(np.uint64) + np.uint64(i + 1))
    return h.view(np.int64)


def fitted(q: np.ndarray, near: np.ndarray, owner: np.ndarray, far: np.ndarray, some: np.ndarray) -> Plan:
    """The cheapest plan that finds FIT_RECALL of the true neighbours: near[i] of query owner[i], at distance far[i].

    Its cost is the share of the rows ``some`` that a query meets, over all tables. If none does, the last one, which
    finds most.
    """
    last = np.zeros(len(q))
    np.maximum.at(last, owner, far)
    width = 2 * float(np.median(last[last > 0])) if (last > 0).any() else 1.0
    a, b = planes(q.shape[1])
    best = (np.inf, Plan(a[:, :1] / width, b[:, :1], max(PROBES)))
    for hashes in HASHES:
        most = Plan(a[:, :hashes] / width, b[:, :hashes], max(PROBES))
        seen = [most.visited(q, t) for t in range(TABLES)]
        home = [most.own(near, t) for t in range(TABLES)]
        rows = [np.unique(most.own(some, t), return_counts=True) for t in range(TABLES)]
        for probes in sorted({min(p, seen[0].shape[1]) for p in PROBES}):
            hit = np.zeros(len(near), bool)
            cost = 0.0
            for t in range(TABLES):
                hit |= (seen[t][owner, :probes] == home[t][:, None]).any(1)
                at = np.minimum(np.searchsorted(rows[t][0], seen[t][:, :probes]), len(rows[t][0]) - 1)
                cost += np.where(rows[t][0][at] == seen[t][:, :probes], rows[t][1][at], 0).sum() / len(q) / len(some)
            cost += 1e-3 * TABLES * probes  # a probe costs something too
            if hit.mean() >= FIT_RECALL and cost < best[0]:
                best = (cost, Plan(a[:, :hashes] / width, b[:, :hashes], probes))
    return best[1]


def _vectors(column: pa.Array) -> np.ndarray:
    """[rows, dim] float32 from a column of packed vectors of equal length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def nearest(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k nearest members other than itself: ids and exact distances, -1 and inf where there are fewer."""
    k = min(k, len(ids))
    found, far = np.full((len(qids), k), -1, np.int64), np.full((len(qids), k), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = (x * x).sum(1)
        longest = np.sqrt((x.astype(np.float64) ** 2).sum(1).max())
        for a in range(0, len(qids), 512):
            part, own = q[a : a + 512], qids[a : a + 512]
            d = norm - 2 * (part @ x.T)
            self = own[:, None] == ids
            d[self] = np.inf
            top = np.argpartition(d, k - 1, axis=1)[:, :k]
            # d lacks the query's squared length and is off by up to err: every member that may be among the k nearest is kept.
            square = (part.astype(np.float64) ** 2).sum(1)
            err = (x.shape[1] + 4) * 2.0**-23 * (longest + np.sqrt(square)) ** 2
            kth = np.take_along_axis(d, top, 1).max(1).astype(np.float64)
            limit = (np.sqrt(np.maximum(kth + square + err, 0)) + 10.0**-PLACES) ** 2 - square + err
            near = ~(d > limit[:, None]) & ~self
            gap = x[top].astype(np.float64) - part[:, None, :]
            mine = np.take_along_axis(self, top, 1)
            found[a : a + 512] = np.where(mine, -1, ids[top])
            far[a : a + 512] = np.where(mine, np.inf, np.sqrt((gap * gap).sum(2)))
            for i in np.flatnonzero(near.sum(1) > k):
                c = np.flatnonzero(near[i])
                gap = x[c].astype(np.float64) - part[i]
                dist = np.sqrt((gap * gap).sum(1))
                best = np.lexsort((ids[c], np.round(dist, PLACES)))[:k]
                found[a + i], far[a + i] = ids[c[best]], dist[best]
    return found, far


def merged(qids: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, neighbour, rank, distance) from flat lists: repeats dropped, the k nearest of each query ranked."""
    keep = ids >= 0
    qids, ids, far = qids[keep], ids[keep], far[keep]
    order = np.lexsort((far, ids, qids))
    qids, ids, far = qids[order], ids[order], far[order]
    new = np.ones(len(qids), bool)
    new[1:] = (qids[1:] != qids[:-1]) | (ids[1:] != ids[:-1])
    qids, ids, far = qids[new], ids[new], np.round(far[new], PLACES)
    order = np.lexsort((ids, far, qids))
    qids, ids, far = qids[order], ids[order], far[order]
    rank = np.arange(len(qids)) - np.searchsorted(qids, qids) + 1
    keep = rank <= k
    return qids[keep], ids[keep], rank[keep], far[keep]


def _truth(rows: DataFrame, qids: np.ndarray, q: np.ndarray, k: int) -> list:
    """(q: place in qids, id, d, v) of the k nearest rows of each query, by one scan."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, q.shape[1]), np.float32))
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.slice(at, 8192)
                ids = np.asarray(part.column(0))
                x = np.asarray(part.column(1).flatten(), np.float32).reshape(len(part), -1)
                found, far = nearest(ids, x, qids, q, k)
                which, d, i = np.repeat(np.arange(len(qids)), found.shape[1]), far.ravel(), found.ravel()
                where = np.argsort(ids, kind="stable")
                ok = i >= 0
                v = x[where[np.searchsorted(ids[where], i[ok])]]
                which, i, d, v = np.append(held[0], which[ok]), np.append(held[1], i[ok]), np.append(held[2], d[ok]), np.concatenate([held[3], v])
                order = np.lexsort((i, d, which))
                which = which[order]
                order = order[np.arange(len(which)) - np.searchsorted(which, which) < k]
                held = (np.append(held[0], np.repeat(np.arange(len(qids)), found.shape[1])[ok])[order], i[order], d[order], v[order])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2]), pa.array([r.tobytes() for r in held[3]], pa.binary())], ["q", "id", "d", "v"])

    top = Window.partitionBy("q").orderBy("d", "id")
    found = rows.mapInArrow(scan, "q int, id long, d double, v binary")
    return found.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k).collect()


def neighbours(embeddings: DataFrame, queries: Column | None = None, k: int = K) -> DataFrame:
    """vec_id, neighbour_id, rank (from 1) and distance of the k nearest found neighbours, among all rows, of each row
    that fulfils the condition ``queries`` (on a column named id); of every row without one."""
    v = col(embeddings, "embedding").cast("array<float>")
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size(v) > 0)
    rows = embeddings.select(col(embeddings, "vec_id").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & good)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "vec_id long, neighbour_id long, rank int, distance double"
    none = embeddings.sparkSession.createDataFrame([], schema)
    if not sizes:
        return none
    dim = sizes[0]["dim"]
    rows = materialize(rows.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")))
    asked = rows if queries is None else rows.filter(queries)
    sample = hash_sample(asked, F.col("id"), FIT_QUERIES).collect()
    truth = _truth(rows, np.array([r["id"] for r in sample]), np.array([r["v"] for r in sample], np.float32), k) if sample else []
    if not truth:
        return none
    some = np.array([r["v"] for r in hash_sample(rows, F.hash("id"), FIT_ROWS).collect()], np.float32)
    near = np.frombuffer(b"".join(r["v"] for r in truth), np.float32).reshape(len(truth), dim)
    plan = fitted(np.array([r["v"] for r in sample], np.float32), near, np.array([r["q"] for r in truth]), np.array([r["d"] for r in truth]), some)

    def hashed(visits: bool):  # noqa: ANN202
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    part = batch.slice(at, 2048)
                    ids = np.asarray(part.column(0))
                    x = np.asarray(part.column(1).flatten(), np.float32).reshape(len(part), dim)
                    packed = pa.array([r.tobytes() for r in x], pa.binary())
                    for t in range(TABLES):
                        keys = plan.visited(x, t) if visits else plan.own(x, t)[:, None]
                        at_row = np.repeat(np.arange(len(ids)), keys.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at_row), t, np.int32)), pa.array(keys.ravel()), pa.array(ids[at_row]), packed.take(pa.array(at_row))], ["t", "bucket", "id", "v"])

        return (asked if visits else rows).mapInArrow(emit, "t int, bucket long, id long, v binary")

    def loads(visits: bool):  # noqa: ANN202
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Members, or probes, per bucket, added up within the batch."""
            for batch in batches:
                x = np.asarray(batch.column(1).flatten(), np.float32).reshape(len(batch), dim)
                for t in range(TABLES):
                    found = [np.unique((plan.visited if visits else plan.own)(x[at : at + 2048], t), return_counts=True) for at in range(0, len(x), 2048)]
                    for u, n in found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(u), pa.array(n)], ["t", "bucket", "n"])

        return (asked if visits else rows).mapInArrow(count, "t int, bucket long, n long").groupBy("t", "bucket")

    # Only buckets that are visited and hold something go on.
    load = loads(False).agg(F.ceil(F.sum("n") / MEMBER_BLOCK).alias("mb")).join(loads(True).agg(F.ceil(F.sum("n") / PROBE_BLOCK).alias("pb")), ["t", "bucket"])
    load = materialize(load)
    n_load = load.count()

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row goes to one block of its own side and meets all blocks of the other."""
        mine = F.pmod(F.xxhash64("id"), F.col(own)).alias("mine")
        placed = side.join(sized(load, n_load, 64), ["t", "bucket"]).select("t", "bucket", "id", "v", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("yours"))
        i, j = ("mine", "yours") if own == "mb" else ("yours", "mine")
        return placed.select("t", "bucket", F.col(i).alias("i"), F.col(j).alias("j"), "id", "v")

    def meet(members: pa.Table, queries: pa.Table) -> pa.Table:
        ids, qids = np.asarray(members.column("id").combine_chunks()), np.asarray(queries.column("id").combine_chunks())
        if not len(ids) or not len(qids):
            found, far = np.zeros((len(qids), 0), np.int64), np.zeros((len(qids), 0))
        else:
            found, far = nearest(ids, _vectors(members.column("v")), qids, _vectors(queries.column("v")), k)
        cut = pa.array(np.arange(len(qids) + 1, dtype=np.int32) * found.shape[1])
        return pa.table({"q": pa.array(qids), "ids": pa.ListArray.from_arrays(cut, pa.array(found.ravel())), "far": pa.ListArray.from_arrays(cut, pa.array(far.ravel()))})

    keys = ["t", "bucket", "i", "j"]
    lists = spread(hashed(False), "mb", "pb").groupBy(keys).cogroup(spread(hashed(True), "pb", "mb").groupBy(keys)).applyInArrow(meet, "q long, ids array<long>, far array<double>")
    parts = max(1, -(-asked.count() // MERGE))

    def merge(lists: pa.Table) -> pa.Table:
        ids = lists.column("ids").combine_chunks()
        n = np.diff(np.asarray(ids.offsets))
        q, i, rank, far = merged(np.repeat(np.asarray(lists.column("q").combine_chunks()), n), np.asarray(ids.flatten()), np.asarray(lists.column("far").combine_chunks().flatten()), k)
        return pa.table({"vec_id": pa.array(q), "neighbour_id": pa.array(i), "rank": pa.array(rank.astype(np.int32)), "distance": pa.array(far)})

    return lists.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts))).groupBy("part").applyInArrow(merge, schema)
