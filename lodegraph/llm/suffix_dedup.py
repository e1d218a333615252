"""Repeated passages by suffix arrays that are built with linear-time grouping.

A passage is ``PASSAGE`` consecutive words, a word being a run of characters other than space, tab, newline
and carriage return. Reported are, per document, the maximal stretches all of whose passages occur at least
twice in the corpus, in other documents or the same one.

1. Each window of PASSAGE words has one anchor: the ``ANCHOR``-word gram in it with the least hash (the first
   of equals). Equal windows have equal anchors, so windows that share no anchor need not meet. Neighbouring
   windows with the same anchor form a run; a run's context is its words. Runs are shuffled as four numbers
   (anchor, hash of the context, document, place); anchors that occur once leave here.
2. Equal contexts are repeats of each other altogether; one of them goes on, and only where its anchor has
   other contexts as well. Their words are fetched from the documents concerned.
3. Contexts with the same anchor meet in a shard. The shard's contexts, joined by separators that occur once,
   form one string over the integers, whose suffix array is built by grouping: suffixes are grouped by their
   Lyndon prefixes, groups are processed in descending order with previous-smaller pointers, and the order
   within groups is then emitted along these pointers, without recursive renaming. A window is repeated if
   it shares PASSAGE words with its neighbour in the suffix array. An anchor with over HOT_CONTEXTS distinct
   contexts would not fit one task: its windows get a finer anchor, the 2, then 4, 8, 16 and finally all grams with
   the least hashes in the window instead of the one, and their runs meet by that. Equal windows stay together.
4. Repeated windows go back to every run with that context, and are merged per document.

Words are compared by 64-bit hashes in anchors and contexts (128 bits for a context's or a document's identity).

Defined results
* A null text, an empty one, or one of fewer than PASSAGE words has no stretch and no line in the result.
* Repeated rows repeat all their passages; they share one set of lines. Rows with equal doc_ids and
  different texts are searched separately and reported under that doc_id; null doc_ids likewise.
* Very long texts are searched whole, in blocks of windows. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import materialize, sized
from .common import col
from .textvec import _P, SLICE_CHARS, codes, mix, pieces, slices, span_hashes, spans

PASSAGE = 50
ANCHOR = 20
#: Contexts in a shard, on average; a shard's suffix array holds about 65 words of each.
SHARD_CONTEXTS = 3000
#: Anchors with more distinct contexts than a task should hold are split.
HOT_CONTEXTS = 20000
#: Windows of one document looked at together.
BLOCK = 1 << 17


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the first word of every text (one more than texts)."""
    if len(texts) == 1 and len(texts[0] or "") > SLICE_CHARS:
        words = np.concatenate([word_hashes([texts[0][a:b]])[0] for a, b in pieces(texts[0], SLICE_CHARS - 1)])
        return words, np.array([0, len(words)])
    cp, starts = codes(texts)
    s, e = spans(~((cp == 32) | (cp == 10) | (cp == 9) | (cp == 13)))
    return span_hashes(cp, s, e), np.searchsorted(s, starts)


def gram_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n words from each place on (places with fewer left are absent)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, seed, np.uint64)
    for k in range(n):
        h = (h + words[k : k + len(h)]) * _P
    return mix(h)


def _prefix(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    pow_ = np.full(len(words) + 1, _P)
    pow_[0] = 1
    np.multiply.accumulate(pow_, out=pow_)
    inv = np.full(len(words) + 1, np.uint64(pow(int(_P), -1, 1 << 64)))
    inv[0] = 1
    np.multiply.accumulate(inv, out=inv)
    s = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(seed)) * pow_[:-1], out=s[1:])
    return s, inv


def runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, context hash) of every run of windows that share an anchor."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    g = gram_hashes(words, ANCHOR, 3)
    width = PASSAGE - ANCHOR + 1
    if len(words) < PASSAGE:
        return none
    # Least gram of `width` consecutive ones, by doubling; ties go to the first.
    best, span = np.arange(len(g)), 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best, span = np.where(g[a] <= g[b], a, b), span * 2
    if span < width:
        a, b = best[: len(best) - (width - span)], best[width - span :]
        best = np.where(g[a] <= g[b], a, b)
    doc = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    last = len(words) - PASSAGE + 1
    valid = doc[:last] == doc[PASSAGE - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    chosen = best[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    start = at[head]
    end = start + count + PASSAGE - 1
    s, inv = _prefix(words, 29)
    context = mix((s[end] - s[start]) * inv[start] + count.astype(np.uint64))
    return doc[start], start - first[doc[start]], count, g[chosen[head]], context


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of integers from 0 up, in linear time by grouping suffixes by Lyndon prefix."""
    n = len(text) + 1
    codes_ = np.zeros(n, np.int64)  # the end is the unique least symbol
    codes_[:-1] = np.asarray(text, np.int64) + 1
    order = np.argsort(codes_, kind="stable")
    ranked = codes_[order]
    head = np.searchsorted(ranked, codes_)
    slot: list[int] = order.tolist()  # suffixes, group after group
    group: list[int] = head.tolist()  # first slot of each suffix's group
    place_ = np.empty(n, np.int64)
    place_[order] = np.arange(n)
    where: list[int] = place_.tolist()
    size: list[int] = np.bincount(head, minlength=n).tolist()
    prev = [-1] * n
    top = n
    while top:
        low = group[slot[top - 1]]
        members = slot[low:top] if top - low == 1 else sorted(slot[low:top])
        top = low
        # Nearest suffix to the left in a lower group; members come from left to right, so pointers of
        # members further left, and of all higher groups, can be followed.
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if not counts:
            continue
        if len(counts) == 1:
            levels = [list(counts)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, c in counts.items():
                by_count.setdefault(c, []).append(j)
            levels = [by_count[c] for c in sorted(by_count, reverse=True)]
        for level in levels:
            split: dict[int, list[int]] = {}
            for j in level:
                split.setdefault(group[j], []).append(j)
            for g, js in split.items():
                rest = size[g] - len(js)
                if not rest:
                    continue
                new = g + rest
                size[g], size[new] = rest, len(js)
                back = new + len(js) - 1
                for j in js:  # swap to the tail of the group, which becomes the next higher group
                    a, other = where[j], slot[back]
                    slot[a], slot[back] = other, j
                    where[other], where[j] = a, back
                    group[j] = new
                    back -= 1
    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # next slot of the group that starts here
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return out[1:]


def repeated_windows(contexts: list[np.ndarray]) -> list[np.ndarray]:
    """For each context, a mask over its windows: does the window occur at another place of the contexts?"""
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    total = int(starts[-1])
    text = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[starts[1:] - 1] = False
    text[~inside] = np.arange(len(contexts))
    text[inside] = np.unique(np.concatenate(contexts), return_inverse=True)[1] + len(contexts)
    sa = np.array(suffix_array(text.tolist()), np.int64)
    # Neighbours that share PASSAGE words: no separator can lie within, each occurs once.
    a, b = sa[:-1], sa[1:]
    alive = np.flatnonzero((a <= total - PASSAGE) & (b <= total - PASSAGE))
    for k in range(PASSAGE):
        alive = alive[text[a[alive] + k] == text[b[alive] + k]]
    hit = np.zeros(total, bool)
    hit[a[alive]] = True
    hit[b[alive]] = True
    return [hit[s : s + max(n - PASSAGE + 1, 0)] for s, n in zip(starts, sizes)]


def _blocks(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``runs`` of a slice; a document that is a slice by itself is cut into blocks of windows."""
    if len(first) > 2:
        yield runs(words, first)
        return
    for at in range(0, max(len(words) - PASSAGE + 1, 1), BLOCK):
        part = words[at : at + BLOCK + PASSAGE - 1]
        doc, start, *rest = runs(part, np.array([0, len(part)]))
        yield doc, start + at, *rest


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d1, d2, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
        for a, b in slices(texts):
            for doc, start, count, anchor, context in _blocks(*word_hashes(texts[a:b])):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(d1[a:b][doc]), pa.array(d2[a:b][doc]), pa.array((start << 24) | count)], ["anchor", "context", "d1", "d2", "place"])


def _emit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wanted = batch.column(0).to_pylist(), batch.column(1)
        at = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        flat = wanted.flatten()
        anchor, context, place = (np.asarray(flat.field(i)) for i in range(3))
        for a, b in slices(texts):
            words, first = word_hashes(texts[a:b])
            data = []
            for i in range(a, b):
                for p in place[at[i] : at[i + 1]]:
                    s = first[i - a] + (p >> 24)
                    data.append(words[s : s + (p & 0xFFFFFF) + PASSAGE - 1].tobytes())
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at[a] : at[b]]), pa.array(context[at[a] : at[b]]), pa.array(data, pa.binary())], ["anchor", "context", "words"])


def _search(shard: pa.Table) -> pa.Table:
    contexts = [np.frombuffer(w, np.uint64) for w in shard.column("words").to_pylist()]
    out: tuple[list, list, list] = ([], [], [])
    for k, hit in enumerate(repeated_windows(contexts)):
        s, e = spans(np.append(hit, False))
        out[0].extend([k] * len(s))
        out[1].extend(s.tolist())
        out[2].extend((e - s).tolist())
    take = pa.array(out[0], pa.int64())
    return pa.table({"anchor": shard.column("anchor").take(take), "context": shard.column("context").take(take), "off": pa.array(out[1], pa.int64()), "count": pa.array(out[2], pa.int64())})


def finer_runs(words: np.ndarray, grams: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, windows, anchor, context hash) of every run of a context's windows that share their ``grams`` least gram hashes."""
    width = PASSAGE - ANCHOR + 1
    for at in range(0, len(words) - PASSAGE + 1, 4096):
        part = words[at : at + 4096 + PASSAGE - 1]
        least = np.sort(np.lib.stride_tricks.sliding_window_view(gram_hashes(part, ANCHOR, 3), width), axis=1)
        key = np.full(len(least), grams, np.uint64)
        for k in range(min(grams, width)):
            key = mix(key + least[:, k])
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(head, len(key)))
        s, inv = _prefix(part, 31)
        context = mix((s[head + count + PASSAGE - 1] - s[head]) * inv[head] + count.astype(np.uint64))
        yield from zip((head + at).tolist(), count.tolist(), key[head].view(np.int64).tolist(), context.view(np.int64).tolist())


def _contexts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(anchor, context, words) of the contexts in ``asked``, read from the documents that ``one`` names."""
    wanted = materialize(asked.groupBy("one.d1", "one.d2").agg(F.collect_list(F.struct("anchor", "context", "one.place")).alias("wanted")))
    some = rows.select("d1", "d2", "text").join(sized(wanted.select("d1", "d2"), wanted.count(), 64), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    return some.join(wanted, ["d1", "d2"]).select("text", "wanted").mapInArrow(_emit_words, "anchor long, context long, words binary")


def _searched(contexts: DataFrame, n: int) -> DataFrame:
    """(anchor, context, off, count): the repeated windows of n contexts, anchors of which fit a task."""
    shards = max(1, -(-n // SHARD_CONTEXTS))
    return contexts.withColumn("shard", F.pmod(F.col("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(_search, "anchor long, context long, off long, count long")


def _split(contexts: DataFrame, grams: int) -> DataFrame:
    """``_searched`` for contexts (anchor, context, words) of hot anchors: by finer anchors, doubling ``grams`` while some are hot."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column(2).to_pylist()):
                words = np.frombuffer(packed, np.uint64)
                found = list(finer_runs(words, grams))
                off, count, anchor, context = (np.array(x, np.int64) for x in zip(*found))
                at = pa.array(np.full(len(off), i))
                text = pa.array([words[o : o + k + PASSAGE - 1].tobytes() for o, k, _, _ in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(off), pa.array(count), pa.array(anchor), pa.array(context), text], ["anchor", "context", "off", "count", "a2", "c2", "words"])

    sub = materialize(contexts.mapInArrow(emit, "anchor long, context long, off long, count long, a2 long, c2 long, words binary"))
    kinds = sub.groupBy("a2", "c2").agg(F.count("*").alias("n"), F.min("words").alias("words"))
    kinds = materialize(kinds.select(F.col("a2").alias("anchor"), F.col("c2").alias("context"), "n", "words"))
    per_anchor = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    last = grams >= PASSAGE - ANCHOR + 1  # all grams: equal windows only
    parts = _found(kinds, per_anchor if last else per_anchor.filter(F.col("kinds") <= HOT_CONTEXTS))
    hot = per_anchor.filter(F.col("kinds") > HOT_CONTEXTS)
    if not last and hot.limit(1).count():
        parts = parts.unionByName(_split(kinds.join(hot, "anchor", "left_semi").select("anchor", "context", "words"), 2 * grams))
    some = parts.select(F.col("anchor").alias("a2"), F.col("context").alias("c2"), F.col("off").alias("o2"), F.col("count").alias("k2"))
    part = sub.join(some, ["a2", "c2"]).select("anchor", "context", (F.col("off") + F.col("o2")).alias("off"), F.col("k2").alias("count"))
    twice = kinds.filter("n > 1").select(F.col("anchor").alias("a2"), F.col("context").alias("c2"))
    return part.unionByName(sub.join(twice, ["a2", "c2"]).select("anchor", "context", "off", "count"))


def _found(kinds: DataFrame, anchors: DataFrame) -> DataFrame:
    asked = kinds.join(anchors.select("anchor"), "anchor", "left_semi").select("anchor", "context", "words")
    return _searched(asked, asked.count())


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word (from 0) and n_words of every maximal stretch of repeated passages."""
    text, doc_id = col(docs, "text"), col(docs, "doc_id")
    # A row's identity: rows of equal doc_id and text have the same passages.
    one, two = (F.xxhash64(F.lit(seed), doc_id.isNull(), doc_id, text) for seed in (17, 91))
    rows = docs.select(one.alias("d1"), two.alias("d2"), doc_id.alias("doc_id"), text.alias("text")).filter("text is not null")
    every = materialize(rows.select("d1", "d2", "text").mapInArrow(_emit_runs, "anchor long, context long, d1 long, d2 long, place long"))
    # Counted with partial sums, then joined: an anchor may have a third of all runs.
    often = materialize(every.join(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchor", "left_semi"))
    groups = materialize(often.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "place")).alias("one")))
    kinds = materialize(groups.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    asked = materialize(groups.join(kinds.filter(F.col("kinds") <= HOT_CONTEXTS).select("anchor"), "anchor", "left_semi"))
    parts = _searched(_contexts(asked, rows), asked.count())
    hot = groups.join(kinds.filter(F.col("kinds") > HOT_CONTEXTS).select("anchor"), "anchor", "left_semi")
    if kinds.filter(F.col("kinds") > HOT_CONTEXTS).limit(1).count():
        parts = parts.unionByName(_split(_contexts(hot, rows), 2))
    part = often.join(parts, ["anchor", "context"]).select("d1", "d2", (F.shiftright("place", 24) + F.col("off")).alias("s"), F.col("count"))
    whole = often.join(groups.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("d1", "d2", F.shiftright("place", 24).alias("s"), F.col("place").bitwiseAND(F.lit(0xFFFFFF)).alias("count"))
    hits = part.unionByName(whole).select("d1", "d2", "s", (F.col("s") + F.col("count") + PASSAGE - 1).alias("e"))
    return _named(_merged(hits), rows)


def _merged(hits: DataFrame) -> DataFrame:
    """Union of the word ranges [s, e) of each doc; ranges merge where their windows follow on each other."""
    order = Window.partitionBy("d1", "d2").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.coalesce((F.col("s") > reach - PASSAGE + 1).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy("d1", "d2", "island").agg(F.min("s").alias("start_word"), (F.max("e") - F.min("s")).alias("n_words")).drop("island")


def _named(stretches: DataFrame, rows: DataFrame) -> DataFrame:
    names = rows.select("d1", "d2", "doc_id").distinct()
    return stretches.join(names, ["d1", "d2"]).select("doc_id", "start_word", "n_words").distinct()
