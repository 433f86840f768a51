"""SimHash classes against a brute-force twin."""

import random

import pytest
import xxhash

from arbora.functions.lineage import durable
from arbora.llm import simhash
from arbora.llm.components import connected_components


def slow_fp(text):
    words = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).encode()
    words = [w for w in words.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """(id, fp) rows -> component of each row by union-find over all pairs."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (key, _) in enumerate(pairs):
        groups.setdefault(find(i), []).append(key)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [least[find(i)] for i in range(len(pairs))]


TEXTS = ["", None, "   \t\n", "one", "One", "two words", "a b c", "a b c d", "Grüße aus Köln am Rhein", "x " * 300, "  lead and trail \x0b\x0c here  "]


def test_fingerprint_matches_plain_rule():
    for t in TEXTS:
        raw = None if t is None else t.encode()
        assert simhash.simhash_bytes(raw) % 2**64 == slow_fp(t)


def test_classes(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("the of and erst wh in on at re th ou ha".split()) + str(rng.randrange(40)) for _ in range(80)) for _ in range(25)]
    texts = TEXTS + base + [b + " tail" for b in base] + [b.replace(" ", "  ", 1) for b in base[:9]] + base[:6]
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(texts)] + [(None, "", "x")]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want_fp = sorted((r[0] or -1, slow_fp(r[1])) for r in rows)
    assert sorted((r["id"] or -1, r["fp"] % 2**64) for r in got) == want_fp
    comps = slow_components([(r[0], slow_fp(r[1])) for r in rows])
    assert sorted(zip([r[0] or -1 for r in rows], comps, strict=True)) == sorted((r["id"] or -1, r["component"]) for r in got)


@pytest.mark.parametrize("limit", [1, 64])
def test_links_on_dense_fingerprints(spark, monkeypatch, limit):
    """Many fingerprints around few centres: both the paired and the split lists give the classes."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    for c in centres:
        for _ in range(40):
            x = c
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert edges.where("bit_count(u ^ v) > 2").count() == 0
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    want = slow_components([(x, x % 2**64) for x in signed])
    assert {x: got.get(x, x) for x in signed} == dict(zip(signed, want, strict=True))


def test_exploded_rows_are_not_broadcast(spark):
    """What explode repeats is joined by shuffle, however small Spark takes it for."""
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    fps = spark.range(81).selectExpr("id div 9 * 4294967296 + id % 9 as fp")
    planned(simhash.links(fps, lambda df: durable(planned(df))))
    nodes = spark.range(30).selectExpr("id as node", "cast(repeat('a', 256) as binary) as sketch", "array(id % 3, 3 + id % 5) as bands")
    simhash.similar(nodes, fps.selectExpr("fp as u", "fp as v"), 0.8, lambda df: durable(planned(df)))
    assert [("Join" in p, "Broadcast" in p) for p in plans[:3]] == [(True, False)] * 3


def test_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id as u", "id - 1 as v")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(i, 0) for i in range(300)}


def test_deduplicate(spark):
    rows = [(3, "same text here ok", "a"), (1, "same text here ok", "b"), (1, "same text here ok", "b"), (7, "quite other words in here", "c"), (None, "quite other words in here", "d"), (None, None, "e"), (None, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, least string")
    got = sorted(tuple(r) for r in simhash.deduplicate(df).collect() if r["doc_id"] is not None)
    assert got == [(1, "same text here ok", "b"), (7, "quite other words in here", "c")]
    assert simhash.deduplicate(df).columns == df.columns
    assert simhash.deduplicate(df).count() == 3
    assert simhash.deduplicate(df.limit(0)).count() == 0
    assert simhash.classes(df.limit(0)).count() == 0


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("limit", [256, 3])
def test_similar_texts_go(spark, monkeypatch, limit):
    """Copies of five-word similarity 0.85 or more go; texts that share little stay."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", limit)
    rng = random.Random(9)
    line = "this line is found in very many of the texts and means little"
    rows, groups = [], {}
    for g in range(30):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(rng.randrange(120, 400))]
        for _ in range(6 if g < 25 else 40):
            w = list(base)
            for _ in range(len(w) // 150):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) + (" " + line if g % 2 else ""), 1))
            groups.setdefault(g, []).append(rows[-1])
    close = [min(jaccard(v[0][1], r[1]) for r in v) for v in groups.values()]
    assert min(close) > 0.85
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()}
    assert kept == {v[0][0] for v in groups.values()}


def test_sketch_estimates(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    pairs = []
    for k in (0, 2, 8, 20, 60):
        w = list(base)
        for i in rng.sample(range(400), k):
            w[i] = f"y{i}"
        pairs.append((" ".join(base), " ".join(w)))
    df = spark.createDataFrame([(i, simhash.sketch_bytes(a.encode())[0], simhash.sketch_bytes(b.encode())[0]) for i, (a, b) in enumerate(pairs)], "i int, a binary, b binary")
    for r in df.select("i", simhash.sketch_similarity("a", "b").alias("s")).collect():
        assert abs(r["s"] - jaccard(*pairs[r["i"]])) < 0.1
    assert simhash.sketch_bytes(None) == simhash.sketch_bytes(b" ") == (None, [])


def fake_sketch(centre, changed):
    """The centre with the bytes of some places changed, each text in its own way."""
    out = bytearray(centre)
    for place, byte in changed.items():
        out[place] = byte
    return bytes(out)


@pytest.mark.parametrize("limit", [256, 40, 7])
def test_long_lists_link_what_short_ones_link(spark, monkeypatch, limit):
    """Groups of chained variants around a centre, in one list: components as of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", limit)
    rng = random.Random(4)
    sketches = []
    for _ in range(3):
        centre = bytes(rng.randrange(256) for _ in range(256))
        sketches.append(centre)
        for _ in range(12):  # a variant, then one further off that only the variant agrees with
            places = rng.sample(range(256), 80)
            near = {p: rng.randrange(256) for p in places[:45]}
            sketches += [fake_sketch(centre, near), fake_sketch(centre, near | {p: rng.randrange(256) for p in places[45:]})]
    rng.shuffle(sketches)
    rows = [(i, s, [7]) for i, s in enumerate(sketches)]
    bar, parent = 0.78, list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = sum(a == b for a, b in zip(sketches[i], sketches[j], strict=True)) / 256
            if (same - 1 / 256) / (1 - 1 / 256) >= bar:
                parent = [min(parent[i], parent[j]) if p in (parent[i], parent[j]) else p for p in parent]
    assert len(set(parent)) == 3
    none = spark.createDataFrame([], "u long, v long")
    found = connected_components(simhash.similar(spark.createDataFrame(rows, "node long, sketch binary, bands array<long>"), none, 0.8, durable))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert [got.get(i, i) for i in range(len(rows))] == parent


def test_texts_of_one_fingerprint_keep_their_sketches(spark):
    """A near copy of a text goes although another text, of lower id, has that text's fingerprint."""
    rng = random.Random(8)
    line = "the same line again and again in all of this text\n" * 120
    words = [[f"{c}{rng.randrange(10**6)}" for _ in range(200)] for c in "ab"]
    near = [w if i % 101 else f"x{i}" for i, w in enumerate(words[1])]
    texts = [line + " ".join(words[0]), line + " ".join(words[1]), line[:99] + " " + " ".join(near)]
    fp = [simhash.simhash_bytes(t.encode(), 5) for t in texts]
    assert fp[0] == fp[1] and bin((fp[1] ^ fp[2]) % 2**64).count("1") > 2
    assert jaccard(texts[1], texts[2]) > 0.85 and jaccard(texts[0], texts[2]) < 0.5
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_a_large_group_is_not_compared_in_pairs(spark, monkeypatch):
    """Near copies of one text and a few others in one list: a constant number of rows a text."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 16)
    rng = random.Random(6)
    centre = bytes(rng.randrange(256) for _ in range(256))
    for size in (200, 800):
        rows = [(i, fake_sketch(centre, {p: rng.randrange(256) for p in rng.sample(range(256), 20)}), [7]) for i in range(size)]
        rows += [(size + i, bytes(rng.randrange(256) for _ in range(256)), [7]) for i in range(5)]
        units = []

        def seen(df):
            units.append(df.count())
            return df

        deal = simhash.deal_blocks
        monkeypatch.setattr(simhash, "deal_blocks", lambda placed, deal=deal: seen(deal(placed)))
        none = spark.createDataFrame([], "u long, v long")
        edges = simhash.similar(spark.createDataFrame(rows, "node long, sketch binary, bands array<long>"), none, 0.8, durable)
        assert connected_components(edges).count() == size
        assert edges.count() <= 2 * size
        monkeypatch.setattr(simhash, "deal_blocks", deal)
        blocks = -(-size // 16)
        assert units == [size + 5 * (blocks + 1)]


def test_scratch_tables_are_removed(spark):
    """Nothing but what the result still reads stays in the checkpoint folder."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = {x for x in os.listdir(folder) if x.startswith("arbora_")}
    rows = [(i, f"text number {i % 7} of a few words", "x") for i in range(20)]
    assert simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, x string")).count() == 7
    assert {x for x in os.listdir(folder) if x.startswith("arbora_")} == before


def test_rows_that_differ_in_a_map_only(spark):
    rows = [(1, "same text", {"a": 1}), (1, "same text", {"a": 1}), (1, "same text", {"a": 2})]
    df = spark.createDataFrame(rows, "doc_id long, text string, `gone.id` map<string,int>")
    assert simhash.deduplicate(df).count() == 1
    other = spark.createDataFrame([(1, "same text", {"a": 1}), (1, "quite another text", {"a": 1}), (1, "quite another text", {"a": 1})], df.schema)
    assert sorted(r["text"] for r in simhash.deduplicate(other).collect()) == ["quite another text", "same text"]
