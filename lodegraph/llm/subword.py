"""Supervised subword embeddings in numpy: hashed words, word pairs and character n-grams, averaged, then softmax.

The document vector is the mean of the learned vectors of its features, and the class scores are a
linear map of it. Scoring uses the identity mean(E[f]) @ W = mean((E @ W)[f]): the product E @ W is
taken once after training, so a feature costs one gather of ``classes`` numbers. Texts are always
used whole; a very long one is read in pieces between words, whose sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .textvec import SLICE_CHARS, codes, is_space, mix, owners, pieces, slices, span_hashes, spans


@dataclass(frozen=True)
class Spec:
    """What a document is turned into and how the model is trained."""

    buckets: int = 1 << 16
    dim: int = 16
    chars: tuple[int, ...] = (3, 4)
    pairs: bool = True
    lower: bool = False
    epochs: int = 8
    rate: float = 0.4
    seed: int = 7


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of words a each followed by b. A word followed by itself is one feature whatever the word: repetition is learned as such."""
    return np.where(a == b, np.uint64(0xD0B1E), mix(a * np.uint64(3) + b))


def features(texts: list[str | None], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature occurrence, documents ascending within each kind."""
    return _features(texts, spec)[:2]


def parts(texts: list[str | None], spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``features`` of a slice of documents, in parts: one, or one for each piece of a document that is a slice by itself."""
    if len(texts) != 1 or len(texts[0] or "") <= SLICE_CHARS:
        yield features(texts, spec)
        return
    last = np.zeros(0, np.uint64)
    for a, b in pieces(texts[0]):
        d, f, words = _features([texts[0][a:b]], spec)
        yield d, f
        if spec.pairs and len(words):
            if len(last):  # the pair across the cut
                yield np.zeros(1, np.int64), (_pairs(last, words[:1]) & np.uint64(spec.buckets - 1)).astype(np.int64)
            last = words[-1:]


def _features(texts: list[str | None], spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features``, and the hashes of all words in order."""
    if spec.lower:
        texts = [t.lower() if t else t for t in texts]
    cp, starts = codes(texts)
    space = is_space(cp)
    s, e = spans(~space)
    words = span_hashes(cp, s, e)
    doc = owners(starts, s)
    docs, hashes = [doc], [words]
    if spec.pairs and len(words) > 1:
        same = doc[1:] == doc[:-1]
        hashes.append(_pairs(words[:-1][same], words[1:][same]))
        docs.append(doc[1:][same])
    if len(cp) > 1:
        edge = np.where(space, 32, cp).astype(np.uint64)
        word_of = np.cumsum(space)
        lead = np.empty(len(cp) + 1, np.uint64)
        lead[0], lead[1:] = 32, edge  # a space before the first word
        gap = np.concatenate([[0], word_of])
        at = np.concatenate([[0], np.repeat(np.arange(len(starts) - 1), np.diff(starts))])
        for n in spec.chars:
            if len(lead) < n:
                continue
            m = len(lead) - n + 1
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h + lead[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            # a space may stand at either end of an n-gram but not inside it
            ok = (gap[n - 2 : n - 2 + m] == gap[:m]) if n > 2 else np.ones(m, bool)
            ok &= ~((lead[:m] == 32) & (lead[n - 1 :] == 32)) if n == 2 else True
            ok &= ~(lead[1 : 1 + m] == 32) if n > 2 else (lead[:m] != 32 if n == 1 else True)
            hashes.append(mix(h[ok]))
            docs.append(at[1 : m + 1][ok] if n > 1 else at[:m][ok])
    return np.concatenate(docs), (np.concatenate(hashes) & np.uint64(spec.buckets - 1)).astype(np.int64), words


def bags(texts: list[str | None], spec: Spec) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document, its distinct buckets and their shares of the document's features."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in slices(texts):
        found = [np.unique(d * spec.buckets + f, return_counts=True) for d, f in parts(texts[a:b], spec)]
        key, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate([n for _, n in found]), minlength=len(key))
        d, f = key // spec.buckets, (key % spec.buckets).astype(np.int32)
        cut = np.searchsorted(d, np.arange(b - a + 1))
        for i in range(b - a):
            n = count[cut[i] : cut[i + 1]].astype(np.float32)
            out.append((f[cut[i] : cut[i + 1]].copy(), n / np.float32(max(n.sum(), 1))))
    return out


@dataclass
class Model:
    """Class scores per bucket, E @ W, as float32 [buckets, classes]; temperature divides the logits."""

    spec: Spec
    classes: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Mean score of each text's features; a text without features has the bias alone."""
        out = np.zeros((len(texts), len(self.classes)))
        for a, b in slices(texts):
            n = np.zeros(b - a)
            for d, f in parts(texts[a:b], self.spec):
                n += np.bincount(d, minlength=b - a)
                for c in range(len(self.classes)):
                    out[a:b, c] += np.bincount(d, weights=self.table[f, c], minlength=b - a)
            out[a:b] /= np.maximum(n, 1)[:, None]
        return (out + self.bias) / self.temperature

    def proba(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(texts)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[str], labels: list, spec: Spec) -> Model:
    """Stochastic gradient descent, one document a step, classes weighted to count alike, rate falling to zero."""
    classes = sorted(set(labels))
    y = np.array([classes.index(v) for v in labels], dtype=np.int64)
    rng = np.random.default_rng(spec.seed)
    emb = rng.uniform(-1, 1, (spec.buckets, spec.dim)).astype(np.float32) / spec.dim
    w = np.zeros((spec.dim, len(classes)), np.float32)
    bias = np.zeros(len(classes), np.float32)
    if len(texts):
        weight = len(y) / (len(classes) * np.maximum(np.bincount(y, minlength=len(classes)), 1))
        weight = np.minimum(weight, 10.0)
        docs = bags(texts, spec)
        total, step = spec.epochs * len(docs), 0
        for _ in range(spec.epochs):
            for i in rng.permutation(len(docs)):
                f, share = docs[i]
                rate = spec.rate * (1 - step / total) * weight[y[i]]
                step += 1
                if not len(f):
                    continue
                h = share @ emb[f]
                z = h @ w + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = w @ p
                w -= rate * np.outer(h, p).astype(np.float32)
                bias -= 0.1 * rate * p.astype(np.float32)
                # every occurrence's vector moves by the gradient of the mean, scaled by sqrt to keep rare features alive
                emb[f] -= (rate * len(f) ** 0.5) * share[:, None] * back.astype(np.float32)
    return Model(spec, classes, (emb @ w).astype(np.float32), bias)
