"""Wu-Manber search against a plain scan of all windows."""

import random
import re

from arbora.llm import decontaminate


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def slow(text, items, window):
    words, hit, ids = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[i : i + size]:
                    hit.update(range(at, at + size))
                    ids.add(item)
    return len(words), len(hit), sorted(x for x in ids if x is not None)


def corpus(seed):
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(["the", "of", "Ünd", "a", "b9", "c-d", "E", "f"]) for _ in range(n))
    items = [(i, draw(rng.choice([1, 2, 4, 5, 6, 9, 12]))) for i in range(14)] + [(3, draw(6)), (None, draw(5)), (77, None), (78, ""), (79, "...")]
    texts = [draw(rng.randrange(60)) for _ in range(60)] + [None, "", "?!", items[0][1], (items[2][1] or "").upper(), "x " * 3000 + items[5][1]]
    return items, texts


def check(spark, window, **limits):
    items, texts = corpus(window)
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(docs, bench, "h", window).select("doc_id", "h.*").collect()
    for r in got:
        want = slow(texts[r["doc_id"]], [(None if i is None else str(i), t) for i, t in items], window)
        assert (r["n_words"], r["n_hit"], r["items"]) == want, r
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]
    kept = decontaminate.decontaminate(docs, bench, window)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in got if not r["n_hit"]}


def test_one_pass(spark):
    check(spark, 5)
    check(spark, 10)


def test_joined_patterns(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 120)
    check(spark, 5)


def test_a_benchmark_of_fifty_blocks(spark, monkeypatch):
    """Both plans find the same, and the larger benchmark is never collected."""
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60)))) for i in range(1500)]
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(80))) + (" " + items[rng.randrange(1500)][1] if i % 3 == 0 else "") for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(tuple, decontaminate.annotate(docs, bench, "h").select("doc_id", "h.*").collect()))
    want = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", sum(len(t) for _, t in items) // 50)
    monkeypatch.setattr(decontaminate, "_search_udf", None)
    assert rows() == want and sum(r[2] > 0 for r in want) > 60


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", {"k": 1})], "`doc.id` long, text string, hits string, `text_k1` map<string,int>")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(docs, bench, "h").select("h.n_words", "h.n_hit").first() == (2, 0)
    assert decontaminate.annotate(docs.limit(0), bench, "h").count() == 0
