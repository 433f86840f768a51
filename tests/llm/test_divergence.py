"""The divergence audit against a plain count, and its edge cases."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=3, top=200):
    docs = [((g or ""), (s or ""), Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for _, t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        own = [(s, c) for g, s, c in docs if g == lang]
        inside = Counter(t for _, c in own for t in c)
        kept = sorted(t for t, n in inside.items() if n >= min_docs)
        count = {s: Counter() for s, _ in own}
        for s, c in own:
            count[s].update({t: n for t, n in c.items() if t in set(kept)})
        whole = sum(count.values(), Counter())
        p = lambda c, t, n: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept))
        size = {s: sum(c.values()) for s, c in count.items()}
        for s in count:
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(o, sum(f(p(count[s], t, size[s]), p(count[o], t, size[o])) for t in kept)) for o in count if o != s]
            terms = [(t, f(a, b)) for t in kept if count[s][t] for a, b in [(p(count[s], t, size[s]), p(whole, t, sum(size.values())))] if a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


ROWS = [
    (1, "The cat THE dog", "en", "a"), (2, "the Cat_dog; été", "en", "b"), (3, "the ÉTÉ été x\U0001f642", "en", "a"), (4, None, "en", "c"), (5, "", None, None),
    (6, "the the été\tdog\x00cat", "en", "b"), (7, "the cat", None, "a"), (8, "cat", None, "a"), (9, "cat cat", None, None), (9, "cat cat", None, None), (10, "zzz", "solo", "s"),
    (11, "Dog's end-of-line\r\ncat1cat", "en", "a"), (None, "the", "en", "a"), (12, "one", "none", "p"), (13, "two", "none", "q"),
]


@pytest.mark.parametrize("held,bucket,matrix", [(400_000, 300_000, 1 << 20), (3, 2, 2)])
def test_against_plain(spark, monkeypatch, held, bucket, matrix):
    """With any size of buckets and of what tasks hold."""
    for name, value in (("HELD", held), ("BUCKET", bucket), ("MATRIX", matrix)):
        monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    clashes = {c: F.lit(1) for c in ("term", "n", "docs", "cells", "a.b", "bucket", "item", "value")}
    assert got(divergence.audit(df.withColumns(clashes))) == plain(ROWS)


def test_ranks_stop_at_the_limit_and_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TOP_TERMS", 2)
    rows = [(i, "b a c d" if i < 3 else "e e f f g g", "x", "s" if i < 3 else "t") for i in range(6)]
    out = got(divergence.audit(spark.createDataFrame(rows, SCHEMA)))
    assert out == plain(rows, top=2)
    assert [(r[3], r[5]) for r in out if r[1:3] == ("s", "term")] == [("a", 1), ("b", 2)]


def test_empty_and_long(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(["word and " * 400_000, "x" * 2_000_000, "\U0001f642 " * 300_000, "word"] * 3)]
    rows = spark.createDataFrame(long, SCHEMA).repartition(4)
    terms = {(r["source"], r["term"].decode()[:4]): r["n"] for r in divergence.term_counts(rows).where(F.length("term") > 0).collect()}
    assert terms["a", "word"] == 1_200_000 and terms["a", "\U0001f642"] == 900_000 and terms["b", "xxxx"] == 3
    assert divergence.document_terms(("A b-" * 700_000).encode()) == Counter({b"a": 700_000, b"b": 700_000})


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    n = np.array([0, 10**10, 9 * 10**12])
    assert divergence.share(n, 10**13, 7).tolist() == [1 + 10**9 * (int(c) + 1) // (10**13 + 7) for c in n]


def test_repeated_marker_rows(spark):
    """A group without any term takes part with smoothed shares."""
    rows = [(1, "a b", "l", "s"), (2, "a b", "l", "s"), (3, "a", "l", "s"), (4, "--", "l", "t")]
    out = got(divergence.audit(spark.createDataFrame(rows, SCHEMA)))
    assert out == plain(rows) and any(r[1] == "t" and r[2] == "pair" for r in out)
    assert pa.types.is_binary(divergence._OUT.field("item").type)
