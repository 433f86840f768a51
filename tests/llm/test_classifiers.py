"""Held-out quality of the two learners, and their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import common, language_id, quality_classifier
from arbora.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_word_hashes():
    texts = [b"a b a", None, b"", b"  ", b"b\ta\n", b"ab", "ü a".encode(), b"x" * 3_000_000 + b" a", b"a"]
    h, n = common.word_hashes(texts)
    assert n.tolist() == [3, 0, 0, 0, 2, 1, 2, 2, 1]
    a, b = h[0], h[1]
    assert h.tolist()[:5] == [a, b, a, b, a] and h[-1] == h[-2] == h[7] == a and len({int(x) for x in h}) == 5
    many = [f"w{i}".encode() for i in range(200_000)]
    big, _ = common.word_hashes([b" ".join(many)])
    again, _ = common.word_hashes(many)
    assert (big == again).all() and len(np.unique(big)) == 200_000


def test_quality_held_out(spark):
    scored = QUERIES["op8_quality_classifier"](spark, DATA)
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (rows.predicted == rows.quality).mean() > 0.93
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.5), (3, "a b " * 9000, 0.5), (3, "a b", 0.5)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    w = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, w, "p")
    assert out.count() == 5 and out.where("p is null").count() == 0
    assert (quality_classifier.fit(docs, labels.limit(0)) == 0).all()
    assert quality_classifier.score(docs.limit(0), w, "p").count() == 0
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    a = quality_classifier.score_texts([b"x y", b"y z w"], w)
    assert a == pytest.approx([quality_classifier.score_texts([t], w)[0] for t in (b"x y", b"y z w")])


def test_language_held_out(spark):
    found = QUERIES["op10_language_id"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98 and found.count() == docs.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_profiles_against_plain_count(spark):
    rows = [(1, "the cat! the hat", "en"), (2, "le chat, le Ça", "fr"), (3, None, "en"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.fit(docs)
    assert sorted(got) == ["en", "fr"]
    count = {}
    for word in ("the", "cat", "the", "hat"):
        for g in list(word):
            count[g] = count.get(g, 0) + 1
    padded = " the cat the hat "
    for k in (2, 3):
        for i in range(len(padded) - k + 1):
            count[padded[i : i + k]] = count.get(padded[i : i + k], 0) + 1

    def code(g):
        v = 0
        for c in g:
            v = v << 21 | (0 if c == " " else ord(c))
        return v | (1 << 63 if len(g) == 2 else 0)

    want = sorted(((-n, code(g)) for g, n in count.items()))
    assert got["en"].tolist() == [c for _, c in want]
    profiles = language_id.Profiles(got)
    assert profiles.nearest(b"the cat the hat") == ("en", 1.0)
    assert profiles.nearest(None) == profiles.nearest(b"12 !? ...") == ("und", 0.0)
    assert language_id.Profiles({}).nearest(b"abc") == ("und", 0.0)
    out = language_id.predict(docs, got, "p")
    assert {r["doc_id"]: r["p"]["lang"] for r in out.collect()} == {1: "en", 2: "fr", 3: "und", 4: out.where("doc_id = 4").first()["p"]["lang"]}
    assert language_id.predict(docs.limit(0), got, "p").count() == 0 and language_id.fit(docs.limit(0)) == {}


def test_ranked_keeps_ties_whole():
    codes, counts = np.arange(5000, dtype=np.uint64), np.ones(5000, dtype=np.int64)
    counts[4000] = 2
    assert language_id.ranked(codes, counts, 3).tolist() == [4000, 0, 1]


def test_training_against_plain_updates():
    """Follow-the-regularised-leader one text and one weight at a time, in plain Python."""
    import math

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "C1", "dd", "!!", "e-f"], rng.integers(0, 12))).encode() for _ in range(25)]
    labels = rng.integers(0, 2, 25).tolist()
    alpha, beta, l1, l2, bias = 0.5, 1.0, 0.0005, 0.5, 1 << quality_classifier.BITS
    z, g2 = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(g2.get(i, 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(4):
        for r in order.permutation(25):
            index, n = quality_classifier.features([texts[r]])
            x = {bias: 1.0}
            for i in index.ravel().tolist():
                x[i] = x.get(i, 0.0) + 1 / n[0]
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                w, g = weight(i), (p - labels[r]) * v
                sigma = (math.sqrt(g2.get(i, 0.0) + g * g) - math.sqrt(g2.get(i, 0.0))) / alpha
                z[i], g2[i] = z.get(i, 0.0) + g - sigma * w, g2.get(i, 0.0) + g * g
    found = quality_classifier.train_ftrl(texts, labels, 4, alpha, beta, l1, l2)
    assert set(np.flatnonzero(found)) == {i for i in z if weight(i)}
    assert all(found[i] == pytest.approx(weight(i)) for i in z)
    for t, p in zip(texts, quality_classifier.score_texts(texts, found), strict=True):
        index, n = quality_classifier.features([t])
        dot = sum(weight(i) for i in index.ravel().tolist()) / max(n[0], 1) + weight(bias)
        assert p == pytest.approx(1 / (1 + math.exp(-dot)))


def test_out_of_place_distance():
    """Distances against a plain walk over both ranked lists."""
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé f") for _ in range(300)).encode() for _ in range(6)]
    profiles = {f"l{i}": language_id.ranked(*language_id.grams(t)) for i, t in enumerate(texts[:3])}
    model = language_id.Profiles(profiles)
    for t in texts:
        own = language_id.ranked(*language_id.grams(t)).tolist()
        far = {}
        for lang, profile in profiles.items():
            place = {g: r for r, g in enumerate(profile.tolist())}
            far[lang] = sum(abs(place[g] - r) if g in place else language_id.PROFILE for r, g in enumerate(own))
        best = min(far, key=lambda k: (far[k], k))
        assert model.nearest(t) == (best, pytest.approx(1 - far[best] / (language_id.PROFILE * len(own))))
