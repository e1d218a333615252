import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import exact_dedup, near_dedup, suffix_dedup, textvec
from lodegraph.llm.common import table
from lodegraph.llm.queries import oracle_sql, queries

from ..comparing import SF, assert_same, connect
from .helpers import awkward, docs, empty, prose


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, name):
    assert_same(queries()[name](spark, SF), connect(), oracle_sql()[name])


# Exact


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_hash_is_minimal_and_perfect(n):
    words = np.random.default_rng(n).integers(0, 1 << 63, (n, 4)).astype(np.uint64)
    sizes, bits = exact_dedup.build(words)
    at = exact_dedup.slots(words, sizes, bits)
    assert sorted(at.tolist()) == list(range(n))
    others = exact_dedup.slots(words + np.uint64(1), sizes, bits)
    assert ((others >= -1) & (others < max(n, 1))).all()  # may fall on a slot: only the bytes there decide


def brute_exact(rows):
    best = {}
    for i, (doc_id, text) in enumerate(rows):
        if text is not None:
            best[text] = min(best.get(text, (doc_id is None, doc_id or 0, i)), (doc_id is None, doc_id or 0, i))
    return best


def test_batch_against_history(spark, monkeypatch, tmp_path):
    """Repeats of a stored history go, wherever the border lies; the others are grouped by themselves."""
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 7)
    rnd = random.Random(1)
    rows = [(i, prose(rnd.randrange(60), 5)) for i in range(300)]
    for cut in (0, 100, 299):
        exact_dedup.index(docs(spark, rows[:cut])).write.parquet(f"{tmp_path}/{cut}")
        got = exact_dedup.exact_duplicates(docs(spark, rows[cut:]), spark.read.parquet(f"{tmp_path}/{cut}")).collect()
        best = brute_exact(rows)
        assert sorted((r["doc_id"], r["winner_id"]) for r in got) == [(i, best[t][1]) for i, t in rows[cut:]]
        assert all(r["kept"] == (r["doc_id"] == r["winner_id"]) and r["digest"] == hashlib.sha256(rows[r["doc_id"]][1].encode()).hexdigest() for r in got)
        kept = exact_dedup.keep_first(docs(spark, rows[cut:]), spark.read.parquet(f"{tmp_path}/{cut}"))
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in rows[cut:] if best[t][1] == i]


def test_history_wins_over_lesser_ids(spark):
    index = exact_dedup.index(docs(spark, [(50, "a b"), (40, "a b"), (60, None), (70, "")]))
    got = exact_dedup.exact_duplicates(docs(spark, [(1, "a b"), (2, None), (3, "c"), (4, "c"), (None, ""), (5, "")]), index).collect()
    assert sorted(((r["doc_id"] or 0, r["winner_id"], r["kept"]) for r in got)) == [(0, 70, False), (1, 40, False), (2, 2, True), (3, 3, True), (4, 3, False), (5, 70, False)]


def test_awkward_exact(spark):
    d = awkward(spark)
    got = exact_dedup.of_both_halves(d).collect()
    assert len(got) == d.count()
    by = defaultdict(list)
    for r in got:
        by[r["digest"]].append(r["kept"])
    assert all(sum(v) == 1 for k, v in by.items() if k is not None) and all(by[None]) and len(by[None]) == 3
    kept = exact_dedup.keep_first(d)
    assert kept.columns == d.columns
    assert kept.filter("text is null").count() == 3  # both copies of a row without text stay
    assert kept.filter("text is not null").count() == kept.filter("text is not null").select("text").distinct().count()
    assert kept.filter(F.col("text") == prose(1)).first()["doc_id"] == 1
    assert exact_dedup.keep_first(d, exact_dedup.index(d)).filter("text is not null").count() == 0
    assert exact_dedup.keep_first(d, exact_dedup.index(empty(d))).count() == kept.count()
    assert exact_dedup.of_both_halves(empty(d)).count() == 0 == exact_dedup.keep_first(empty(d)).count()


# Near


def edited(text, seed, share):
    rnd = random.Random(seed)
    return " ".join(prose(rnd.random(), 1) if rnd.random() < share else w for w in text.split())


SYLLABLES = [x + y for x in "bcdfgklm" for y in "aeiou"]
WIDE = [a + b for a in SYLLABLES for b in SYLLABLES]


def test_lower_bound_and_fingerprint_by_loops():
    text = "Alpha beta, gamma DELTA epsilon zeta eta theta; iota kappa alpha"
    f, has = near_dedup.fingerprints([text, None, "?!", text.upper().replace(",", " ")])
    assert has.tolist() == [True, False, False, True] and (f[0] == f[3]).all()
    bits = np.unpackbits(f.view(np.uint8).reshape(len(f), 16), axis=1)
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 2, (2, 128))
        for size in (2, 32):
            assert np.abs(a.reshape(-1, size).sum(1) - b.reshape(-1, size).sum(1)).sum() <= (a != b).sum()
    assert 0 < bits[0].sum() < 128


def test_long_and_short_texts(monkeypatch):
    """A text read in pieces has the fingerprint of the text read at once; short texts differ by their letters."""
    long = " ".join(f"{prose(i, 40, WIDE)}\n" for i in range(60)) + " 数据库系统的设计与实现。" * 30
    one = near_dedup.fingerprints([long])[0]
    for limit in (300, 5000):
        monkeypatch.setattr(near_dedup, "SLICE_CHARS", limit)
        monkeypatch.setattr(near_dedup, "VOTERS", 50)
        monkeypatch.setattr(near_dedup, "pieces", lambda t, n=limit: textvec.pieces(t, n))
        assert (near_dedup.fingerprints([long])[0] == one).all() or bits_apart(near_dedup.fingerprints([long])[0][0], one[0]) <= 1
    monkeypatch.undo()
    texts = ["That it.", "that is!", "THAT, it", "a", "a", "数据库系统的设计与实现是计算机科学的一个重要课题", "数据库系统的设计与实现是计算机科学的一个主要课题", "今天的天气非常好我们一起去公园散步看花吧朋友们"]
    f, has = near_dedup.fingerprints(texts)
    assert has.all() and (f[0] == f[2]).all() and (f[3] == f[4]).all() and bits_apart(f[0], f[1]) > 20
    assert bits_apart(f[5], f[6]) <= 24 < 40 < bits_apart(f[5], f[7])
    alone = np.concatenate([near_dedup.fingerprints([t])[0] for t in texts])
    assert (alone == f).all()  # whatever else is in the batch


def bits_apart(a, b):
    return sum(((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(a, b))


def brute_links(f):
    """Number of other fingerprints within the distance, and the pairs."""
    u = f.view(np.uint64)
    near = [np.flatnonzero(np.bitwise_count(u[:, 0] ^ x[0]) + np.bitwise_count(u[:, 1] ^ x[1]) <= near_dedup.MAX_DISTANCE) for x in u]
    return [len(n) - 1 for n in near], {(i, int(j)) for i, n in enumerate(near) for j in n if j > i}


def clustered(n, seed):
    """Distinct fingerprints: unrelated ones, pairs at every distance up to 24, and a cluster of 300 around one."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, 128), np.uint8)
    for i in range(0, n // 2, 2):
        bits[i + 1] = bits[i]
        bits[i + 1, rng.permutation(128)[: i // 2 % 25]] ^= 1
    for i in range(n - 300, n):
        bits[i] = bits[n - 1]
        bits[i, rng.permutation(128)[: rng.integers(0, 12)]] ^= 1
    return np.unique(np.packbits(bits, axis=1).view(np.int64), axis=0)


@pytest.mark.parametrize("cell_rows", [1 << 19, 500])
def test_every_link_is_found(spark, monkeypatch, cell_rows):
    """2,600 fingerprints in coarse cells, in fine ones, and in cells cut into blocks: the links of the brute force."""
    monkeypatch.setattr(near_dedup, "CELL_ROWS", cell_rows)
    f = clustered(2600, cell_rows)
    count, pairs = brute_links(f)
    prints = spark.createDataFrame([tuple(map(int, x)) for x in f], "f1 long, f2 long")
    rows = near_dedup.near_links(prints, len(f)).collect()
    got = defaultdict(int)
    place = {tuple(map(int, x)): i for i, x in enumerate(f)}
    root = list(range(len(f)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in rows:
        got[r["f1"], r["f2"]] += r["links"]
        a, b = top(place[r["f1"], r["f2"]]), top(place[r["r1"], r["r2"]])
        root[max(a, b)] = min(a, b)
    assert [got[k] for k in place] == count and sum(count) > 40000
    found = [top(i) for i in range(len(f))]
    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(i) for i in range(len(f))] == found  # connected by the returned edges alone


def test_radii_and_segments():
    assert sum(near_dedup.radii()) == near_dedup.MAX_DISTANCE - near_dedup.GROUPS + 1
    assert [near_dedup.segments_for(n) for n in (10, 10**7, 10**9)] == [1, 3, 11]
    for segments, radius in ((1, 2), (3, 2), (2, 3)):
        steps = near_dedup.moves(segments, radius)
        every = [s for s in np.ndindex(*[2 * radius + 1] * segments) if sum(abs(x - radius) for x in s) <= radius]
        assert len(steps) == (len(every) + 1) // 2 and not steps[0].any()


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    """The whole query on a table of the driver: groups, links and kept rows from all pairs."""
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 2000)
    d = table(spark, SF.replace("0.001", "0.1"), "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect())
    f, has = near_dedup.fingerprints([t for _, t in rows])
    u, inverse = np.unique(f, axis=0, return_inverse=True)
    count, pairs = brute_links(u)
    label = np.arange(len(u))
    a, b = np.array(sorted(pairs)).T
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (before == label).all():
            break
    first = {}
    for (doc_id, _), k, ok in zip(rows, inverse, has):
        first.setdefault(label[k] if ok else -1 - doc_id, doc_id)
    want = {(doc_id, first[label[k]] if ok else doc_id, count[k] if ok else 0, not ok or first[label[k]] == doc_id) for (doc_id, _), k, ok in zip(rows, inverse, has)}
    got = [tuple(r) for r in near_dedup.near_duplicates(d).collect()]
    assert len(got) == len(rows) > 5000 and set(got) == want and sum(count) > 2000


def test_components(spark):
    rnd = random.Random(4)
    arcs = {tuple(sorted(rnd.sample(range(400), 2))) for _ in range(250)} | {(i, i + 1) for i in range(500, 560)}
    root = {x: x for a in arcs for x in a}
    for _ in range(100):
        for a, b in arcs:
            root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame(list(arcs), "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)


def test_near_copies_are_grouped_and_others_left(spark):
    base = {i: prose(i, 200, WIDE) for i in range(30)}
    rows = [(i, t) for i, t in base.items()] + [(100 + i, edited(t, i, 0.03)) for i, t in base.items()] + [(200 + i, t) for i, t in base.items()]
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert len(got) == 90
    assert sum(got[i] == (i, True) for i in range(30)) == 30 and all(got[200 + i] == (i, False) for i in range(30))
    assert sum(got[100 + i] == (i, False) for i in range(30)) >= 28


def test_awkward_near(spark):
    d = awkward(spark)
    got = near_dedup.near_duplicates(d).collect()
    assert len(got) == d.count()
    assert all(r["kept"] and r["group_id"] == r["doc_id"] for r in got if r["doc_id"] in (3, 4, 5, 6))
    assert sorted((r["doc_id"], r["kept"]) for r in got if r["doc_id"] in (1, 2)) == [(1, False), (1, True), (2, False)]
    kept = near_dedup.keep_one_of_each(d)
    assert kept.columns == d.columns and kept.filter(F.col("text") == prose(1)).count() == 1
    assert kept.filter("doc_id in (7, 8)").count() == 1 and kept.filter("text is null").count() == 3
    assert kept.count() == sum(r["kept"] for r in got)
    short = near_dedup.near_duplicates(docs(spark, [(1, "That it."), (2, "That is."), (3, "that it")])).collect()
    assert {r["doc_id"]: r["group_id"] for r in short} == {1: 1, 2: 2, 3: 1}
    assert near_dedup.near_duplicates(empty(d)).count() == 0 == near_dedup.keep_one_of_each(empty(d)).count()


# Suffix arrays


def test_blocks_and_pieces_of_long_texts(spark, monkeypatch):
    """Small blocks and pieces give the stretches of the brute force."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    monkeypatch.setattr(suffix_dedup, "SLICE_CHARS", 500)
    monkeypatch.setattr(suffix_dedup, "slices", lambda texts: textvec.slices(texts, 500))
    shared = prose("shared", 130)
    rows = [(i, prose(f"{i}l", 300) + "\t" + shared + " \n" + prose(f"{i}r", 150)) for i in range(4)] + [(9, "same " * 700)]
    every = [(d, r) for d, t in rows for r in _runs_of(t)]
    assert all(k + suffix_dedup.PASSAGE - 1 <= 64 + suffix_dedup.PASSAGE - 1 for _, (_, k) in every)
    for d, t in rows:
        at = sorted(r for x, r in every if x == d)
        assert [s for s, k in at for s in range(s, s + k)] == list(range(len(t.split()) - suffix_dedup.PASSAGE + 1))
    assert {tuple(r) for r in suffix_dedup.repeated_passages(docs(spark, rows)).collect()} == brute_stretches(rows)


def _runs_of(text):
    return [(int(s), int(k)) for _, start, count, _, _ in suffix_dedup._blocks(*suffix_dedup.word_hashes([text])) for s, k in zip(start, count)]


def test_suffix_array_by_sorting():
    rnd = random.Random(2)
    for _ in range(1500):
        t = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randrange(0, 40))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    t = [1, 2] * 3000
    assert suffix_dedup.suffix_array(t) == [i for i in range(5998, -1, -2)] + [i for i in range(5999, 0, -2)]


def brute_stretches(rows, n=suffix_dedup.PASSAGE):
    seen = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        w = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].append((at, doc_id, i))
    hits = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for at, doc_id, i in places:
                hits[at, doc_id].add(i)
    out = set()
    for (_, doc_id), starts in hits.items():
        for i in sorted(starts):
            if i - 1 not in starts:
                j = i
                while j + 1 in starts:
                    j += 1
                out.add((doc_id, i, j - i + n))
    return out


@pytest.mark.parametrize(("shard", "hot"), [(1, 20000), (3000, 4), (3000, 1)])
def test_passages_by_brute_force(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", shard)
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rnd = random.Random(8)
    shared = [prose(f"s{i}", k) for i, k in enumerate((49, 50, 51, 70, 120, 300))]
    rows = []
    for i in range(60):
        parts = [prose(f"{i}a", rnd.randrange(0, 90)), rnd.choice(shared), prose(f"{i}b", rnd.randrange(0, 90))]
        rows.append((i, "\n ".join(p for p in parts if p)))
    rows += [(60, rows[3][1]), (61, edited(rows[5][1], 1, 0.03)), (62, "same " * 130), (63, prose("x", 40) + " " + "same " * 60), (64, prose("only", 400)), (65, prose("z", 80) + " " + prose("z", 80))]
    got = [tuple(r) for r in suffix_dedup.repeated_passages(docs(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_stretches(rows)


def test_awkward_passages(spark):
    d = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = {tuple(r) for r in suffix_dedup.repeated_passages(d).collect()}
    assert got == brute_stretches(rows) and (7, 0, 60000) in got and (None, 0, 60) in got
    assert suffix_dedup.repeated_passages(empty(d)).count() == 0
