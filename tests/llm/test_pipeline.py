import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from lodegraph.llm import near_dedup, quality

from .helpers import DOCS, WORDS, awkward, docs, prose
from .test_dedup import WIDE, edited
from .test_others import brute_mix, check_bins
from .test_quality_language import brute_probabilities, brute_train, buckets_of


def test_stages_by_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    good = [(i, prose(f"g{i}", 120, WIDE), "en", rnd.choice("abbb")) for i in range(80)]
    bad = [(100 + i, " ".join(w + rnd.choice(["###", "$$$", "%%%"]) for w in prose(f"b{i}", 60, WORDS).split()), "en", "a") for i in range(40)]
    rows = good + bad + [(200 + i, good[i][1], "en", "b") for i in range(15)] + [(300 + i, edited(good[20 + i][1], i, 0.03), "en", "a") for i in range(15)]
    where = str(tmp_path)
    docs(spark, rows).write.parquet(f"{where}/documents.parquet")
    labels = [(r[0], 1, 0) for r in good[:60]] + [(r[0], 0, 0) for r in bad[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    frames = [spark.read.parquet(f"{where}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frames[-1], where).write.parquet(f"{where}/{i}")
        frames.append(spark.read.parquet(f"{where}/{i}"))
    texts = {r[0]: r[1] for r in rows}
    ids = [[r["doc_id"] for r in f.collect()] for f in frames]
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    # 1: features, training and scores by loops over the labelled documents
    train_texts, y = quality.labelled(frames[0], spark.read.parquet(f"{where}/labels.parquet"))
    assert sorted(zip(train_texts, y)) == sorted((texts[r[0]], r[1]) for r in labels)
    bucket = buckets_of(texts.values(), quality.SPEC)
    p = brute_probabilities([texts[d] for d in ids[0]], brute_train(train_texts, y, quality.SPEC, bucket), quality.SPEC, bucket)[:, 1]
    want = {d for d, s in zip(ids[0], p) if s >= quality.LEAST_SCORE}
    assert set(ids[1]) == want and not want & {r[0] for r in bad} and {r[0] for r in good} <= want
    # 2: of each text the least doc_id of those that came before, else of the others
    first = {}
    for d in sorted(ids[1], key=lambda d: (hashlib.md5(str(d).encode()).hexdigest() >= "8", d)):
        first.setdefault(texts[d], d)
    assert sorted(ids[2]) == sorted(first.values()) and len(ids[2]) < len(ids[1])
    # 3: components of all pairs within the distance
    f, has = near_dedup.fingerprints([texts[d] for d in ids[2]])
    print_ = {d: int(a) % 2**64 << 64 | int(b) % 2**64 for d, (a, b) in zip(ids[2], f)}
    root = {d: d for d in ids[2]}
    for _ in range(5):
        for a in ids[2]:
            for b in ids[2]:
                if (print_[a] ^ print_[b]).bit_count() <= near_dedup.MAX_DISTANCE:
                    root[a] = root[b] = min(root[a], root[b])
    assert sorted(ids[3]) == sorted(set(root.values())) and len(ids[3]) < len(ids[2])
    # 4 and 5
    rows3 = [(r["doc_id"], r["text"], r["source"]) for r in frames[3].collect()]
    assert Counter(ids[4]) == Counter(x[0] for x in brute_mix(rows3, None, None))
    sizes = Counter()
    for d in ids[4]:
        sizes[d] += len(texts[d].split())
    check_bins(frames[5].collect(), dict(sizes), 2048)
    assert sorted(map(tuple, cp.run(spark, where).collect())) == sorted(map(tuple, frames[5].collect()))


@pytest.mark.parametrize("make", ["awkward", "empty"])
def test_awkward_stages(spark, tmp_path, make):
    d = awkward(spark) if make == "awkward" else spark.createDataFrame([], DOCS)
    spark.createDataFrame([(1, 1, 0), (9, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = d.columns
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or d.columns == columns
    assert (d.count() > 0) == (make == "awkward")
