"""Exact shard sizes, gapless slots and a uniform spread."""

from collections import Counter

import numpy as np

from arbora.llm import sharding


def place(spark, n, shards, cell_rows, seed=1, parts=5):
    df = spark.range(n).repartition(parts).selectExpr("id as doc_id", "cast(id % 3 as string) as text", "'x' as cell")
    df = df.checkpoint()
    return sharding.shuffle_into_shards(df, shards, seed, cell_rows)


def test_sizes_and_slots(spark):
    for n, shards, cell_rows in ((1003, 16, 10), (40, 16, 1000), (7, 16, 2), (5000, 3, 400)):
        rows = place(spark, n, shards, cell_rows).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(n))
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(by.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_same_twice_and_seed_matters(spark):
    key = lambda df: {(r["doc_id"], r["shard"], r["slot"]) for r in df.collect()}
    df = spark.range(500).selectExpr("id as doc_id", "'t' as text").checkpoint()
    one = key(sharding.shuffle_into_shards(df, 4, 1, 50))
    assert one == key(sharding.shuffle_into_shards(df, 4, 1, 50))
    assert one != key(sharding.shuffle_into_shards(df, 4, 2, 50))


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(None, None)] * 9 + [(1, "a")] * 8, "doc_id long, text string").checkpoint()
    rows = sharding.shuffle_into_shards(df, 4, 3).collect()
    assert Counter(r["doc_id"] for r in rows) == {None: 9, 1: 8}
    assert Counter(r["shard"] for r in rows) == {0: 5, 1: 4, 2: 4, 3: 4}
    assert sharding.shuffle_into_shards(df.limit(0), 4, 3).count() == 0


def test_matrix_sums_and_law():
    sizes, columns = np.array([5, 0, 12, 7]), np.array([9, 9, 6])
    rows = np.array([sharding.matrix_row(sizes, columns, p, 4) for p in range(4)])
    assert (rows.sum(axis=1) == sizes).all() and (rows.sum(axis=0) == columns).all()
    first = np.array([sharding.matrix_row(sizes, columns, 0, s)[0] for s in range(3000)])
    assert abs(first.mean() - 5 * 9 / 24) < 0.08
    assert abs(first.var() - 5 * (9 / 24) * (15 / 24) * (19 / 23)) < 0.1


def test_large_populations():
    rng = np.random.default_rng(3)
    good, bad, draws = 3 * 10**9, 5 * 10**9, 10**9
    x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(400)], dtype=float)
    mean = draws * good / (good + bad)
    sd = (mean * (bad / (good + bad)) * ((good + bad - draws) / (good + bad))) ** 0.5
    assert abs(x.mean() - mean) < 4 * sd / 20 and 0.8 < x.std() / sd < 1.2
    split = sharding.split_columns(np.array([good, bad, 10]), draws, rng)
    assert split.sum() == draws and (split >= 0).all()


def test_slots_are_uniform(spark):
    """Each row's place is uniform: over seeds, the shard of one row is even."""
    df = spark.range(64).selectExpr("id as doc_id").checkpoint()
    seen = Counter(sharding.shuffle_into_shards(df, 4, s, 4).where("doc_id = 5").first()["shard"] for s in range(24))
    assert len(seen) == 4


def test_copies_spread(spark):
    """Equal rows are apart as often as any other rows: shards and neighbouring slots as chance gives."""
    n, copies, shards = 4000, 4, 16
    df = spark.range(n * copies).selectExpr(f"id div {copies} as doc_id", f"concat('text ', id div {copies}) as text").coalesce(3).checkpoint()
    rows = sharding.shuffle_into_shards(df, shards, 3, 300).collect()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    total, size = n * copies, n * copies // shards
    together = sum(len({s for s, _ in v}) == 1 for v in of.values())
    assert together <= 8  # chance: 4000 / 16**3, about 1
    pairs = n * copies * (copies - 1) / 2
    same = sum(a[0] == b[0] for v in of.values() for i, a in enumerate(v) for b in v[:i])
    p = (size - 1) / (total - 1)
    assert abs(same - pairs * p) < 5 * (pairs * p) ** 0.5
    next_to = sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for v in of.values() for i, a in enumerate(v) for b in v[:i])
    assert abs(next_to - pairs * 2 * (total - shards) / (total * (total - 1))) < 8


def test_places_against_a_plain_draw(spark):
    """Counts of (input partition, shard) have the mean and variance of a shuffled deck."""
    sizes, shards, seeds = [30, 50, 20], 4, 60
    df = spark.range(100).selectExpr("id as doc_id", "case when id < 30 then 0 when id < 80 then 1 else 2 end as p").repartitionById(3, "p").checkpoint()
    got = np.array([[(r["p"], r["shard"]) for r in sharding.shuffle_into_shards(df, shards, s, 6).collect()] for s in range(8)])
    rng, plain = np.random.default_rng(1), []
    for _ in range(seeds * 50):
        deck = rng.permutation(np.repeat(np.arange(3), sizes))
        plain.append((deck[:25] == 1).sum())
    counts = [(run[:, 0][run[:, 1] == s] == 1).sum() for run in got for s in range(shards)]
    assert abs(np.mean(counts) - np.mean(plain)) < 1e-9 + 0.1 and 0.3 < np.var(counts) / np.var(plain) < 2.5


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 5, {"k": 1})] * 3, "`doc.id` long, text string, Shard string, SLOT int, cell map<string,int>").checkpoint()
    out = sharding.shuffle_into_shards(df, 2, 1)
    assert out.columns == ["doc.id", "text", "cell", "shard", "slot"] and out.count() == 3


def test_many_cells():
    """A million cells and ten billion rows: the sums hold and a row of the matrix takes seconds."""
    columns = sharding.even_sizes(10**10, 10**6)
    out = sharding.split_columns(columns, 10**8, np.random.default_rng(2))
    assert out.sum() == 10**8 and (out <= columns).all() and abs(out.mean() - 100) < 1e-9 and 90 < out.var() < 110
