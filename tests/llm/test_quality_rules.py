"""Measures against a plain count, cutoffs against exact binomial sums."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arbora.llm import quality_rules as q


def slow(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if count[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def test_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "a " * 50, "x\nx\n x\nx\n\n\n", "#*$%&|<> é🙂 ü", "|||", " lead\x0b\x0cand\rtail ", "a b c d e f " * 700 + "z"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(120))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = q.measures(df).collect()
    assert len(got) == len(texts)
    for r in got:
        for name, value in slow(texts[r["id"]]).items():
            assert r[name] == value, (name, texts[r["id"]], r)


@pytest.mark.parametrize("n,rate,level", [(40, 0.1, 0.05), (500, 0.01, 0.003), (500, 0.01, 0.02), (3000, 0.0125, 0.001), (5, 0.01, 0.05)])
def test_critical_counts(spark, n, rate, level):
    df = spark.createDataFrame([("s", n)], "stratum string, n long")
    got = q._critical_counts(df, rate, F.lit(level)).collect()
    tail, want = 0.0, None
    for k in range(n + 1):
        tail += math.comb(n, k) * rate**k * (1 - rate) ** (n - k)
        if tail > level:
            break
        want = k
    assert ([r["most"] for r in got] or [None]) == [want]


def test_guarantee_and_verdict(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(400)}" + ("#" if bad and rng.random() < 0.5 else "") for _ in range(40)]
        docs.append((i, " ".join(words), ["en", None][i % 2]))
        labels.append((i, 0 if bad else 1))
    docs += [(9000, None, "en"), (9001, "short", "en"), (9002, docs[1][1], "xx"), (9002, docs[1][1], "xx"), (None, docs[1][1], None)]
    labels += [(None, 1), (1, None), (77777, 1), (5, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = q.judge(d, l).select("id", "kept", "base_failed").collect()
    assert len(rows) == len(docs)
    kept = {r["id"]: r["kept"] for r in rows}
    good = [kept[i] for i in range(3000) if i % 5]
    bad = [kept[i] for i in range(3000) if i % 5 == 0 and i != 5]
    assert sum(good) / len(good) > 0.96 and sum(bad) / len(bad) < 0.05
    assert not kept[9000] and not kept[9001] and kept[9002] and kept[None]
    empty = q.judge(d.limit(0), l.limit(0))
    assert empty.count() == 0
    free = {r["id"]: r["kept"] for r in q.judge(d, l.limit(0)).collect()}
    assert free[5] and not free[9001]
