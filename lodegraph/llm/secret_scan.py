"""Secret scan: character Markov models of random strings against ordinary identifiers.

Candidates are runs of at least ``MIN_LENGTH`` characters of A-Z a-z 0-9 + / _ = -. Second-order character
models are trained from labelled samples: one for each kind of random string (lower and upper hexadecimal,
base 32, base 62, base 64), drawn by a seeded generator, and one for ordinary strings: identifiers of the
standard library, words of a bounded sample of documents, their usual joinings (snake, camel, upper case,
paths), plain numbers, and rules of one repeated character. A candidate is reported if the log-likelihood
ratio of the likeliest random kind (kinds have equal weight) to the ordinary model exceeds ``LEAST_SCORE``
nats, the odds against a random string being a secret a priori. Three characters that have occurred in the string
before are no evidence for a random one: repeating a rare word doesn't make a secret. Where the whole candidate isn't, the same is asked of
its best segment of at least ``MIN_LENGTH`` characters, less the logarithm of the number of its segments: ordinary
characters glued to a secret don't cancel it. It is reported up to the marks or ends around it that close its outer
letters and digits. What is left on both sides of a reported segment is searched again. A run of more than WINDOW
characters is searched in windows that overlap by OVERLAP; finds that overlap are one, with the greater score.

Defined results
* A null or empty text has no candidate and no line; a document has one line per find.
* Of equally good segments of a run the first to end is taken, and of those the shortest.
* Repeated rows and rows with equal or null doc_ids are scanned one by one. Very long texts are scanned
  whole, piece by piece. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import builtins
import itertools
import keyword
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST_SAMPLE, col, hash_sample
from .textvec import SLICE_CHARS, codes, owners, pieces, slices, spans

#: Shorter strings are out of question: of eight random characters one in ten already fails to reach LEAST_SCORE.
MIN_LENGTH = 8
#: Characters of a window of a long run, those it shares with the next, and those looked at together.
WINDOW, OVERLAP, BATCH_CHARS = 1 << 16, 1 << 11, 1 << 18
LEAST_SCORE = 14.0
#: Bound on the documents, of up to LONGEST_SAMPLE characters, whose words count as labelled ordinary strings.
SAMPLE_ROWS = 300
SAMPLES = 20000
SEED = 5

_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_ALNUM = 62  # the symbols up to it are letters and digits, those above it marks
_S = len(_CHARS) + 1  # symbol 0: before the first character
_SYMBOL = np.zeros(129, np.int64)
for _i, _c in enumerate(_CHARS):
    _SYMBOL[ord(_c)] = _i + 1
KINDS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _CHARS[:62], _CHARS[:64])


def random_samples(n: int, seed: int = SEED) -> list[list[str]]:
    """Labelled random strings, n of each kind, 20 to 64 characters long."""
    rng = np.random.default_rng(seed)
    return [["".join(rng.choice(list(kind), int(rng.integers(20, 65)))) for _ in range(n)] for kind in KINDS]


def ordinary_samples(words: list[str], n: int, seed: int = SEED) -> list[str]:
    """Labelled ordinary strings: n joinings of words, a tenth as many numbers, and rules of one repeated character."""
    rng = np.random.default_rng(seed + 1)
    names = [w for x in (sys.stdlib_module_names, dir(builtins), keyword.kwlist, *(dir(t) for t in (str, dict, list, int, np.ndarray))) for w in x]
    base = sorted({p for w in [*names, *words] for p in w.replace("_", " ").split() if p.isascii() and p.isalpha()})
    out = []
    for style in rng.integers(0, 8, n):
        w = [base[i] for i in rng.integers(0, len(base), int(rng.integers(1, 6)))]
        out.append(("_".join(w).lower(), "".join(map(str.title, w)), "-".join(w), "/".join(w).lower(), "_".join(w).upper(), "".join(w).lower(), "=".join(w[:2]), "".join(w).upper())[style])
    out += ["".join(rng.choice(list("0123456789-"), int(rng.integers(4, 30)), p=[0.095] * 10 + [0.05])) for _ in range(n // 10)]
    return out + [c * int(rng.integers(4, 80)) for c in _CHARS for _ in range(n // 2000)]


def train(samples: list[str], smooth: float) -> np.ndarray:
    """log P(character | the two before it), as a flat table; backed by the first-order model."""
    joined = "".join(samples)
    size = np.array([len(s) for s in samples])
    c = _SYMBOL[np.frombuffer(joined.encode("ascii"), np.uint8)]
    first = np.cumsum(size) - size
    one, two = _before(c, first[size > 0])
    pair = np.bincount(one * _S + c, minlength=_S * _S).reshape(_S, _S).astype(float)
    pair[:, 1:] += 0.5
    pair /= pair.sum(1, keepdims=True)
    triple = np.bincount((two * _S + one) * _S + c, minlength=_S**3).reshape(_S, _S, _S).astype(float)
    triple += smooth * pair[None]
    return np.log(np.maximum(triple / triple.sum(2, keepdims=True), 1e-9)).ravel()


def _before(c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each, 0 before the first of a string."""
    one, two = np.zeros_like(c), np.zeros_like(c)
    one[1:] = c[:-1]
    one[first] = 0
    two[1:] = one[:-1]
    two[first] = 0
    return one, two


class Scanner:
    """Trained models; ``score`` takes strings, ``find`` whole texts."""

    def __init__(self, words: list[str]) -> None:
        n = SAMPLES
        self.table = np.stack([train(s, 40.0) for s in random_samples(n // len(KINDS))] + [train(ordinary_samples(words, n), 5.0)]).astype(np.float32)

    def _ratios(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[kinds, characters]: what each character adds to the log-likelihood ratio of each kind."""
        one, two = _before(c, first)
        each = self.table[:, (two * _S + one) * _S + c].astype(np.float64)
        return each[:-1] - each[-1]

    def _once(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``_ratios``, where a character that has come after the same two in its string before counts against, not for."""
        one, two = _before(c, first)
        string = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
        again = np.ones(len(c), bool)
        again[np.unique(((string * _S + two) * _S + one) * _S + c, return_index=True)[1]] = False
        out = self._ratios(c, first)
        return np.where(again, np.minimum(out, 0), out)

    def score(self, strings: list[str]) -> np.ndarray:
        size = np.array([len(s) for s in strings])
        first = np.cumsum(size) - size
        return _whole(self._once(_SYMBOL[np.frombuffer("".join(strings).encode("ascii"), np.uint8)], first), first)

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, score) of every reported string."""
        if len(texts) == 1 and len(texts[0] or "") > SLICE_CHARS:
            found = [(s + a, e + a, score) for a, b in pieces(texts[0]) for _, s, e, score in [self.find_in(*codes([texts[0][a:b]]))]]
            s, e, score = (np.concatenate(x) for x in zip(*found))
            return np.zeros(len(s), np.int64), s, e, score
        return self.find_in(*codes(texts))

    def find_in(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``find`` in texts as code points."""
        s, e = spans(_SYMBOL[np.minimum(cp, 128)].astype(bool))
        long = e - s >= MIN_LENGTH
        s, e = s[long], e[long]
        # A run beyond WINDOW is searched in windows that overlap; what is found in several is put together.
        n = np.maximum(-(-(e - s - OVERLAP) // (WINDOW - OVERLAP)), 1)
        run = np.repeat(np.arange(len(s)), n)
        a = s[run] + (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW - OVERLAP)
        b = np.minimum(a + WINDOW, e[run])
        cut = np.searchsorted(np.cumsum(b - a), np.arange(0, int((b - a).sum()), BATCH_CHARS), side="right")
        found = [self._search(cp, a[i:j], b[i:j]) for i, j in itertools.pairwise([*cut, len(a)]) if j > i]
        a, b, score = (np.concatenate(x) for x in zip(*found)) if found else (s[:0], s[:0], np.zeros(0))
        order = np.lexsort((b, a))
        a, b, score = a[order], b[order], score[order]
        if len(a):
            new = np.append(True, a[1:] >= np.maximum.accumulate(b)[:-1])
            head = np.flatnonzero(new)
            a, b, score = a[head], np.maximum.reduceat(b, head), np.maximum.reduceat(score, head)
        doc = owners(starts, a)
        return doc, a - starts[doc], b - starts[doc], score

    def _search(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, score) of what is reported in the runs [s, e) of the code points."""
        at, first = _laid(s, e)
        ratios = self._ratios(_SYMBOL[cp[at]], first)
        # Repeats only lower a score, so strings that don't reach the least one without that are done with.
        maybe = (_whole(ratios, first) > LEAST_SCORE) | (best_segments(ratios, first, first + e - s)[0] > LEAST_SCORE)
        s, e = s[maybe], e[maybe]
        if not len(s):
            return s, e, np.zeros(0)
        at, first = _laid(s, e)
        sym = _SYMBOL[cp[at]]
        ratios = self._once(sym, first)
        score = _whole(ratios, first)
        hit = score > LEAST_SCORE
        found = [(s[hit], e[hit], score[hit])]
        # Parts of the other runs; what a found part leaves on both sides is searched again.
        lo, hi = first[~hit], (first + e - s)[~hit]
        mark, i = sym > _ALNUM, np.arange(len(at))
        left = np.maximum.accumulate(np.where(mark, i, -1)) + 1  # after the last mark
        right = np.minimum.accumulate(np.where(mark, i, len(at))[::-1])[::-1]  # the next mark
        while len(lo):
            score, a, b = best_segments(ratios, lo, hi)
            hit = score > LEAST_SCORE
            lo, hi, a, b, score = lo[hit], hi[hit], a[hit], b[hit], score[hit]
            a = np.where(mark[a], a, np.maximum(lo, left[a]))
            b = np.where(mark[b - 1], b, np.minimum(hi, right[b - 1]))
            found.append((at[a], at[b - 1] + 1, score))
            lo, hi = np.concatenate([lo, b]), np.concatenate([a, hi])
            long = hi - lo >= MIN_LENGTH
            lo, hi = lo[long], hi[long]
        return tuple(np.concatenate(x) for x in zip(*found))


def _laid(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all characters of the strings [s, e), one after the other, and where each string starts among them."""
    first = np.cumsum(e - s) - (e - s)
    return np.arange(int((e - s).sum())) + np.repeat(s - first, e - s), first


def _whole(ratios: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The score of each string as a whole."""
    return np.add.reduceat(ratios, first, axis=1).max(0) - np.log(len(KINDS))


def best_segments(ratios: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, start and end of the best segment of MIN_LENGTH characters or more in each piece [lo, hi) of the characters.

    The score is the segment's ratio to the ordinary model, all segments of a piece being equally likely a priori.
    """
    size = hi - lo
    first = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(lo)), size)
    at = np.arange(int(size.sum())) + np.repeat(lo - first, size)
    best, start, end = np.full(len(lo), -np.inf), lo.copy(), hi.copy()
    where = np.arange(len(at))
    fits = at + MIN_LENGTH <= hi[piece]
    stop = np.minimum(at + MIN_LENGTH, hi[piece])
    for ratio in ratios:
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        # Each piece lies below the ones before it, so the running minimum starts anew with it.
        low = total[at] - piece * (np.ptp(total) + 1)
        begin = at[np.maximum.accumulate(np.where(low <= np.minimum.accumulate(low), where, 0))]
        value = np.where(fits, total[stop] - total[begin], -np.inf)
        top = np.maximum.reduceat(value, first)
        at_top = np.flatnonzero(value == top[piece])
        at_top = at_top[np.unique(piece[at_top], return_index=True)[1]]
        better = top > best
        best[better], start[better], end[better] = top[better], begin[at_top][better], stop[at_top][better]
    starts = size - MIN_LENGTH + 1.0
    return best - np.log(len(KINDS)) - np.log(starts * (starts + 1) / 2), start, end


def fit(docs: DataFrame) -> Scanner:
    slim = docs.select(col(docs, "doc_id").alias("id"), col(docs, "text").alias("t")).filter(F.length("t") <= LONGEST_SAMPLE)
    rows = hash_sample(slim, F.struct("id", "t"), SAMPLE_ROWS).collect()
    return Scanner(sorted({w.strip(".,;:!?") for r in rows for w in r["t"].split()}))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start (character, from 0), secret and score, one row per string reported."""
    scanner = fit(docs)
    slim = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), col(docs, "text").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                doc, s, e, score = scanner.find(texts[a:b])
                found = [texts[a + d][i:j] for d, i, j in zip(doc, s, e)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), pa.array(s), pa.array(found, pa.string()), pa.array(np.round(score, 3))], ["doc_id", "start", "secret", "score"])

    return slim.mapInArrow(find, "doc_id long, start long, secret string, score double")
