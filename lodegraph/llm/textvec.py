"""Vectorised text kernels over a batch of whole documents.

A batch is one numpy array of Unicode code points plus the start of every
document. Words, word hashes and character n-gram hashes are then array
expressions: no Python loop runs per character or per word. Batches are cut
into slices of whole documents (``slices``), and a document beyond that size
into pieces between words (``pieces``), so the working set stays small however
long the batch or the document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.array([c in " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0  　" for c in map(chr, range(0x3001))])
_WORD: np.ndarray | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of documents of about ``limit`` characters; at least one document each."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def pieces(text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of the text of about ``limit`` characters, each but the last ending with a space, tab or line end.

    A word is never cut: where ``limit`` characters hold no such place, the piece reaches to the next one.
    """
    a = 0
    while len(text) - a > limit:
        b = max(text.rfind(c, a, a + limit) for c in " \n\t\r") + 1
        if not b:
            found = [x for x in (text.find(c, a + limit) for c in " \n\t\r") if x >= 0]
            if not found:
                break
            b = min(found) + 1
        yield a, b
        a = b
    yield a, len(text)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a space after each, and the starts (one more than texts)."""
    joined = " ".join([t or "" for t in texts]) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=starts[1:])
    return cp, starts


def is_space(cp: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(cp, 0x3000)] & (cp <= 0x3000)


def is_word(cp: np.ndarray) -> np.ndarray:
    """Letters, digits and underscores; everything beyond the basic plane counts as a letter."""
    global _WORD
    if _WORD is None:
        _WORD = np.array([c.isalnum() or c == "_" for c in map(chr, range(0x10000))] + [True])
    return _WORD[np.minimum(cp, 0x10000)]


def unspaced(cp: np.ndarray) -> np.ndarray:
    """Letters of scripts that don't put spaces between words: Thai, Lao, Khmer, Burmese, kana, Han ideographs."""
    out = np.zeros(len(cp), bool)
    for lo, hi in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        out |= (cp >= lo) & (cp <= hi)
    return out & is_word(cp)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True; the last element must be False."""
    d = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        _POW, _INV = np.full(n, _P), np.full(n, inv)
        _POW[0] = _INV[0] = 1
        np.multiply.accumulate(_POW, out=_POW)
        np.multiply.accumulate(_INV, out=_INV)
    return _POW[:n], _INV[:n]


def span_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, from prefix sums of a polynomial modulo 2**64.

    Spans ascend and don't overlap. The sums are taken block by block; a span across blocks adds up its parts.
    """
    total = np.zeros(len(start), np.uint64)
    for at in range(0, len(cp), SLICE_CHARS):
        block = cp[at : at + SLICE_CHARS]
        i, j = np.searchsorted(end, at, side="right"), np.searchsorted(start, at + len(block))
        if i == j:
            continue
        pow_, inv = _powers(SLICE_CHARS + 1)
        s = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(0x51ED27)) * pow_[: len(block)], out=s[1:])
        a, b = np.maximum(start[i:j] - at, 0), np.minimum(end[i:j] - at, len(block))
        part = (s[b] - s[a]) * inv[a]
        if start[i] < at:  # what came before this block
            part[:1] *= np.uint64(pow(int(_P), int(at - start[i]), 1 << 64))
        total[i:j] += part
    return mix(total + (end - start).astype(np.uint64))


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document of each position."""
    return np.searchsorted(starts, at, side="right") - 1
