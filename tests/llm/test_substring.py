"""Removed words against a count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from arbora.llm import substring


def slow(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    draw = lambda n, v=500: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared, line = draw(90), draw(12)
    texts = [" ".join(draw(rng.randrange(10, 120))) for _ in range(30)]
    texts += [" ".join(draw(20) + shared[rng.randrange(20) : 90 - rng.randrange(20)] + draw(25)) for _ in range(12)]
    texts += [" ".join(draw(15) + line + draw(15) + line + draw(7)) for _ in range(10)]
    texts += ["a b " * 60, "a b " * 60 + "c", "x " * 200, " ".join(shared), "\n".join(shared), " ".join(shared), "  ", "", None, "one", texts[3], texts[3], texts[4].upper()]
    texts += [" ".join(draw(3000, 50)) for _ in range(2)]
    return texts


@pytest.mark.parametrize("window,group", [(35, 20_000), (35, 3), (8, 20_000), (20, 5)])
def test_against_all_windows(spark, monkeypatch, window, group):
    monkeypatch.setattr(substring, "GROUP_ROWS", group)
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(3)
    got = {r["id"]: r for r in substring.deduplicate(df, window, keep_text=True).collect()}
    want = slow(texts, window)
    for i, w in enumerate(want):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == w, (i, texts[i][:50] if texts[i] else texts[i])
        assert sum(s["stop"] - s["start"] for s in got[i]["spans"]) == w[1]
        assert len(got[i]["kept"].split()) == w[0] - w[1]
    assert len(got) == len(texts)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.deduplicate(df).count() == 0


def test_nothing_is_left_behind(spark):
    import os

    before = {t.name for t in spark.catalog.listTables()}, set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    df = spark.createDataFrame([(1, "a b " * 60, {"x": 1})], "doc_id long, text string, `a.b` map<string,int>")
    assert substring.deduplicate(df).count() == 1
    after = {t.name for t in spark.catalog.listTables()}, set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    assert before[0] == after[0] and not [x for x in after[1] - before[1] if x.startswith("arbora_")]


def plain_nodes(runs, window):
    """{repeated words: places} of the repeats that cannot be extended to either side, from all substrings."""
    words = [w.split(b" ") for _, w in runs]
    places = {}
    for r, ((n, _), w) in enumerate(zip(runs, words, strict=True)):
        for i in range(n):
            for j in range(i + window, len(w) + 1):
                places.setdefault(tuple(w[i:j]), []).append((r, i))
    out = {}
    for text, at in places.items():
        after = {words[r][i + len(text)] if i + len(text) < len(words[r]) else (r, i) for r, i in at}
        before = {words[r][i - 1] if i else (r,) for r, i in at}
        if len(at) > 1 and len(after) > 1 and len(before) > 1:
            out[text] = sorted(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_deep_nodes_are_the_maximal_repeats(seed):
    rng = random.Random(seed)
    window, runs = 3, []
    for _ in range(rng.randrange(2, 9)):
        n = rng.randrange(1, 12)
        runs.append((n, b" ".join(rng.choice([b"a", b"ab", b"b", b"\x01c"]) for _ in range(n + window - 1))))
    words = [w.split(b" ") for _, w in runs]
    leaves, shared = substring.suffix_tree(runs, window)
    nodes = substring.deep_nodes(shared)
    # those whose leaves do not all follow one and the same word
    found = [(depth, sorted(leaves[low:high])) for depth, low, high in nodes if len({words[r][i - 1] if i else (r,) for r, i in leaves[low:high]}) > 1]
    assert substring.deepest_nodes(shared) == [max((d for d, low, high in nodes if low <= i < high), default=0) for i in range(len(leaves))]
    assert {tuple(words[at[0][0]][at[0][1] : at[0][1] + depth]): at for depth, at in found} == plain_nodes(runs, window)
    assert len(found) == len({tuple(words[at[0][0]][at[0][1] : at[0][1] + depth]) for depth, at in found})


@pytest.mark.parametrize("seed", range(6))
def test_spans_of_a_part(seed):
    rng = random.Random(seed)
    window, runs = 4, []
    for _ in range(12):
        n = rng.randrange(1, 9)
        runs.append((n, b" ".join(rng.choice([b"a", b"ab", b"b"]) for _ in range(n + window - 1))))
    runs += runs[:2]
    words = [w.split(b" ") for _, w in runs]
    count = Counter(tuple(w[i : i + window]) for (n, _), w in zip(runs, words, strict=True) for i in range(n))
    for (n, _), w, spans in zip(runs, words, substring.subtree_repeats([(*r, 1) for r in runs], window), strict=True):
        want = {p for i in range(n) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        assert {p for a, b in spans for p in range(a, b)} == want


def test_a_string_of_several_places_is_a_node():
    """What is repeated is decided in the part's tree, for strings of several places too."""
    one, two = (3, b"a b c d e", 1), (1, b"q r s", 2)
    assert substring.subtree_repeats([one], 3) == [[]]
    assert substring.subtree_repeats([two], 3) == [[(0, 3)]]
    assert substring.subtree_repeats([one, two, (2, b"b c d x", 1)], 3) == [[(1, 4)], [(0, 3)], [(0, 3)]]
    assert substring.subtree_repeats([one, one], 3) == [[(0, 5)], [(0, 5)]]


def test_halves_keep_every_window_once():
    window, n, before = 35, 17, 20
    words = [b"w%d" % i for i in range(n + window - 1)]
    rows = [(0, 0, window - substring.GRAM, 1, 2, 100, n, before, b" ".join(words), 3)]
    while rows[0][1] < rows[0][2]:
        rows = [h for r in rows for h in substring.halves(r, window)]
        assert sorted(p for r in rows for p in range(r[5], r[5] + r[6])) == list(range(100, 100 + n))
        assert all(r[1] <= r[7] - i <= r[2] for r in rows for i in range(r[6]))
        assert all(r[9] == 3 for r in rows)
        assert all(r[8].split(b" ") == words[r[5] - 100 : r[5] - 100 + r[6] + window - 1] for r in rows)
