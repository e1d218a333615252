import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import language, quality, subword, textvec
from lodegraph.llm.common import hash_sample, table
from lodegraph.llm.subword import Spec, features, train

from ..comparing import SF
from .helpers import awkward, docs, empty, prose

SF01 = SF.replace("sf0.001", "sf0.01")


def brute_features(text, spec):
    """Features of one text, by loops: words, pairs of words, and n-grams of each word between spaces."""
    words = text.split()
    out = [("word", w) for w in words]
    out += [("same",) if a == b else ("pair", a, b) for a, b in zip(words, words[1:])] if spec.pairs else []
    for w in words:
        padded = f" {w} "
        out += [("gram", padded[i : i + n]) for n in spec.chars for i in range(len(padded) - n + 1)]
    return out


@pytest.mark.parametrize(("chars", "pairs"), [((3, 4), True), ((2, 3), False)])
def test_features_equal_loops(chars, pairs):
    """Vectorised features fall together exactly as the strings they stand for do."""
    spec = Spec(buckets=1 << 40, chars=chars, pairs=pairs)
    texts = ["the cat cat sat", "", None, "a", "a bb ccc", "ünï cödé 数据", "x  y\n\nz"]
    d, f = features(texts, spec)
    for i, t in enumerate(texts):
        own = sorted(np.unique(f[d == i], return_counts=True)[1].tolist())
        want = brute_features(t or "", spec)
        assert own == sorted(want.count(x) for x in set(want))
        alone = features([t], spec)[1]
        assert sorted(alone.tolist()) == sorted(f[d == i].tolist())  # whatever else is in the batch


def test_scores_are_the_softmax_of_the_mean_vector():
    m = train(["good text here", "bad!! bad!!"], [1, 0], Spec(buckets=1 << 12))
    d, f = features(["good words"], m.spec)
    z = m.table[f].mean(0) + m.bias
    assert np.allclose(m.proba(["good words"])[0], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-6)


def brute_train(texts, labels, spec, bucket):
    """Training by loops over the strings' features; bucket maps a feature to its bucket."""
    classes = sorted(set(labels))
    y = [classes.index(v) for v in labels]
    rng = np.random.default_rng(spec.seed)
    emb = rng.uniform(-1, 1, (spec.buckets, spec.dim)).astype(np.float32) / spec.dim
    w, bias = np.zeros((spec.dim, len(classes))), np.zeros(len(classes))
    step, total = 0, spec.epochs * len(texts)
    for _ in range(spec.epochs):
        for i in rng.permutation(len(texts)):
            found = [bucket[x] for x in brute_features(texts[i], spec)]
            rate = spec.rate * (1 - step / total) * min(len(y) / (len(classes) * y.count(y[i])), 10)
            step += 1
            if not found:
                continue
            h = np.mean([emb[f] for f in found], axis=0)
            p = np.exp(h @ w + bias)
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            for f in set(found):
                emb[f] -= rate * len(set(found)) ** 0.5 * found.count(f) / len(found) * back
    return classes, emb, w, bias


def brute_probabilities(texts, model, spec, bucket):
    classes, emb, w, bias = model
    out = []
    for t in texts:
        found = [bucket[x] for x in brute_features(t or "", spec)]
        z = (np.mean([emb[f] for f in found], axis=0) if found else np.zeros(spec.dim)) @ w + bias
        out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    return np.array(out)


def buckets_of(texts, spec):
    """The bucket of every feature of the texts, read off texts in which it stands alone."""
    out = {}
    for t in texts:
        words = (t or "").split()
        for k in range(len(words)):
            for part in (words[k : k + 1], words[k : k + 2]):
                want, got = brute_features(" ".join(part), spec), features([" ".join(part)], spec)[1].tolist()
                n = len(part)
                order = want[:n] + (want[n : n + len(part) - 1] if spec.pairs else []) + [("gram", g) for c in spec.chars for w in part for g in [f" {w} "[i : i + c] for i in range(len(w) + 3 - c)]]
                out.update(zip(order, got))
    return out


def test_whole_quality_answer_by_brute_force(spark):
    """Every row of the query's answer from features, training and scoring by loops."""
    texts = [(i, (prose(i, 12) if i % 3 else prose(i, 9).upper() + "!! !!")) for i in range(36)] + [(90, ""), (91, None), (92, "unseen words"), (93, prose(0, 9).upper() + "!! !!")]
    y = [(i, int(i % 3 > 0)) for i in range(30)]
    got = quality.classify(docs(spark, texts), spark.createDataFrame(y, "doc_id long, quality int")).collect()
    train_texts, labels = quality.labelled(docs(spark, texts), spark.createDataFrame(y, "doc_id long, quality int"))
    assert sorted(zip(train_texts, labels)) == sorted((t, dict(y)[i]) for i, t in texts if i in dict(y))
    bucket = buckets_of([t for _, t in texts], quality.SPEC)
    p = brute_probabilities([t for _, t in texts], brute_train(train_texts, labels, quality.SPEC, bucket), quality.SPEC, bucket)[:, 1]
    want = {i: float(q) if t else 0.0 for (i, t), q in zip(texts, p)}
    assert {r["doc_id"] for r in got} == set(want) and all(abs(r["quality_score"] - want[r["doc_id"]]) < 2e-3 for r in got)
    assert all(r["keep"] == (want[r["doc_id"]] >= quality.LEAST_SCORE) for r in got) and {r["keep"] for r in got} == {True, False}


def test_whole_language_answer_by_brute_force(spark):
    tongues = {"en": ["the", "house", "water", "and", "they"], "de": ["und", "das", "haus", "wasser", "nicht"], "fr": ["le", "maison", "eau", "pas", "avec"]}
    texts = [(i, prose(i, 10, tongues[k]), k) for i in range(60) for k in [list(tongues)[i % 3]]] + [(70, "Wasser und Eau", None), (71, None, None), (72, "123 ###", None), (73, "", "en")]
    got = language.identify(docs(spark, texts)).collect()
    rows = sorted(texts[:60] + texts[63:], key=lambda r: r[0])
    model = language.fit(docs(spark, texts))
    slim = docs(spark, rows).selectExpr("doc_id as id", "text as t", "lang as y").filter("y is not null")
    drawn = [(r["t"], r["y"]) for r in hash_sample(slim, F.struct("id", "t"), 3000, "y").collect()]
    part = [r for i, r in enumerate(drawn) if i % 4 != 3]
    bucket = buckets_of([(t or "").lower() for _, t, _ in texts], language.SPEC)
    brute = brute_train([t.lower() for t, _ in part], [k for _, k in part], language.SPEC, bucket)
    p = brute_probabilities([(t or "").lower() for _, t, _ in texts], brute, language.SPEC, bucket)
    z = np.log(p) / model.temperature
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    for (i, t, _), q in zip(texts, p):
        r = next(r for r in got if r["doc_id"] == i)
        if not t or t.startswith("123"):
            assert (r["predicted"], r["confidence"]) == ("und", 0)
        else:
            assert abs(r["confidence"] - q.max()) < 5e-3 and r["predicted"] in (brute[0][int(q.argmax())], "und") and (r["predicted"] == "und") == (r["confidence"] < model.threshold)
    assert sum(r["predicted"] == r["lang"] for r in got) >= 58


def test_rare_classes_are_drawn_whole(spark):
    rows = [(i, f"text {i}", "en" if i % 100 else "rare") for i in range(3000)]
    got = hash_sample(docs(spark, rows), F.col("doc_id"), 200, "lang").collect()
    assert len(got) == 200 and sum(r["lang"] == "rare" for r in got) == 30
    texts, y = quality.labelled(docs(spark, rows), spark.createDataFrame([(i, int(i % 100 > 0)) for i in range(3000)], "doc_id long, quality int"), 100)
    assert len(texts) == 100 and y.count(0) == 30


def test_pieces_of_a_long_text_add_up(monkeypatch):
    texts = ["  ".join(prose(i, 400) for i in range(3)) + "\n\nß É x x\tx ", "short one"]
    for spec in (quality.SPEC, language.SPEC):
        m = train([t[:300] for t in texts], [0, 1], spec)
        whole, bags = m.logits(texts), subword.bags(texts, spec)
        with monkeypatch.context() as c:
            c.setattr(subword, "SLICE_CHARS", 700)
            c.setattr(subword, "slices", lambda t: textvec.slices(t, 700))
            c.setattr(subword, "pieces", lambda t: textvec.pieces(t, 700))
            assert np.allclose(m.logits(texts), whole) and all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for a, b in zip(subword.bags(texts, spec), bags))


LIMITED = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
from lodegraph.llm import language, near_dedup, quality, secret_scan, subword, suffix_dedup
models = [subword.train(["ab cd", "xy zw"], [0, 1], s) for s in (quality.SPEC, language.SPEC)]
scanner = secret_scan.Scanner(["station", "reading"])
text = ("The quick brown fox jumps over the lazy dog and walks away %d. " * 1000 % tuple(range(1000))) * (50_000_000 // 63_000)
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for m in models:
    m.proba([text])
near_dedup.fingerprints([text])
scanner.find([text])
for block in suffix_dedup._blocks(*suffix_dedup.word_hashes([text])):
    pass
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


def test_fifty_million_characters_in_500_mb():
    import os
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", LIMITED.format(root=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))], capture_output=True, text=True, check=True)
    size, more = map(int, out.stdout.split())
    assert size > 49_000_000 and more < 500


def test_held_out_quality(spark):
    """Trained on half of the labelled documents, right on the others; clean ones stay."""
    d, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    half = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = quality.classify(d, half).join(labels.join(half, "doc_id", "left_anti"), "doc_id").collect()
    assert len(got) > 100
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.1


def test_awkward_quality(spark):
    labels = table(spark, SF, "labels")
    train_docs = table(spark, SF, "documents")
    model = quality.fit(train_docs, labels)
    d = awkward(spark)
    rows = quality.classify(d, labels.filter("false")).collect()
    assert len(rows) == d.count() and all(r["keep"] and r["quality_score"] is None for r in rows)
    s = quality.scores(model, [None, "", "  \n", "That is ordinary."])
    assert s[:3].tolist() == [0, 0, 0] and 0 < s[3] < 1
    both = docs(spark, [(i, prose(i) if i % 2 else prose(i).upper() + "!!") for i in range(40)])
    y = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (2, None), (77, 1), (None, 1), (3, 7)], "doc_id long, quality int")
    kept = quality.keep_good(awkward(spark).unionByName(both, allowMissingColumns=True), y)
    assert kept.columns == d.columns
    assert not kept.filter("text is null or trim(text) = ''").count()
    assert kept.filter(F.upper("text") == F.col("text")).filter("length(text) > 100").count() == 0
    assert quality.classify(empty(d), y).count() == 0 == quality.keep_good(empty(d), y).count()


def test_one_class_teaches_nothing(spark):
    d = docs(spark, [(1, "x y"), (2, "z")])
    y = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_good(d, y).count() == 2


def test_held_out_language(spark):
    rows = table(spark, SF01, "documents").select("text", "lang").orderBy("doc_id").collect()
    train_rows, test_rows = rows[::2], [r for r in rows[1::2] if len(r["text"].split()) >= 5]
    cut = len(train_rows) * 3 // 4
    m = train([r["text"] for r in train_rows[:cut]], [r["lang"] for r in train_rows[:cut]], language.SPEC)
    m = language.calibrate(m, [r["text"] for r in train_rows[cut:]], [r["lang"] for r in train_rows[cut:]])
    got, p = language.predict(m, [r["text"] for r in test_rows])
    right = [a == r["lang"] for a, r in zip(got, test_rows)]
    assert sum(right) / len(right) >= 0.98
    assert sum(a not in ("und", r["lang"]) for a, r in zip(got, test_rows)) <= 0.01 * len(got)
    # Calibrated: mean confidence is close to accuracy.
    assert abs(p.mean() - np.mean(right)) < 0.03
    assert language.predict(m, ["12345 67890", None, "", "*** ###"])[0] == ["und"] * 4


def test_awkward_language(spark):
    d = awkward(spark)
    rows = language.identify(d).collect()
    assert len(rows) == d.count()
    assert all(r["predicted"] == "und" and r["confidence"] == 0 for r in language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language.identify(empty(d)).count() == 0
    assert language.identify(docs(spark, [(1, "one two"), (2, None)])).count() == 2
