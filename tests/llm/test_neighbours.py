"""The permutation index against brute force: recall, exact scores, footrule, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import neighbours
from arbora.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in queries:
        far = np.sqrt(((x - np.array(q[1], dtype=np.float64)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q[0]][:k]
        out[q[0]] = [(int(ids[i]), float(far[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"], r["rank"]))
    return out


@pytest.mark.parametrize("sf,least", [("0.001", 0.97), ("0.1", 0.97)])
def test_recall_of_the_query(spark, sf, least):
    path = f"/root/testdata/sf{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in QUERIES["op11_neighbours"](spark, path).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= least * 10 * len(want)
    by_id = {i: np.array(x, dtype=np.float64) for i, x in rows}
    assert all(s == np.sqrt(((by_id[q] - by_id[v]) ** 2).sum()) for q in got for v, s in got[q].values())


def test_large_group_of_near_copies(spark):
    """A third of the vectors lie within a hair of one another; their nearest are found among them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 32))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(neighbours.nearest_neighbours(df, F.col("id") % 25 == 0))
    want = brute(rows, [r for r in rows if r[0] % 25 == 0])
    near = [len({v for v, *_ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]
    assert np.mean(near) > 0.95 and np.mean(near[:20]) > 0.9


def test_footrule_is_the_footrule():
    rng = np.random.default_rng(2)
    x, pivots, prefix = rng.normal(size=(40, 6)), rng.normal(size=(12, 6)), 5
    near = neighbours.permutations(x, pivots, prefix)
    assert all(list(n) == sorted(range(12), key=lambda p: ((x[i] - pivots[p]) ** 2).sum())[:prefix] for i, n in enumerate(near))
    by = np.argsort(near.ravel(), kind="stable")
    part = neighbours.Part({"ids": np.arange(40).tobytes(), "x": x.tobytes(), "starts": np.searchsorted(near.ravel()[by], np.arange(13)).astype(np.int32).tobytes(), "slots": (by // prefix).astype(np.int32).tobytes(), "places": (by % prefix).astype(np.int16).tobytes()}, prefix)
    place = lambda n, p: list(n).index(p) if p in n else prefix
    for i in range(40):
        want = [sum(abs(place(near[i], p) - place(n, p)) for p in range(12)) for n in near]
        assert part.footrule(near[i]).tolist() == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0])]
    out = [(4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 0.0]), (200, None)]
    df = spark.createDataFrame([*good, good[1], good[0], *out], SCHEMA).withColumns({c: F.lit(1) for c in ("id", "part", "rank", "a.b", "score")})
    result = neighbours.nearest_neighbours(df, F.col("id") % 100 == 0, k=3)
    got = {}
    for r in result.orderBy("query_id", "query_vector", "rank").collect():
        got.setdefault((r["query_id"], r["query_vector"]), []).append((r["rank"], r["id"], r["score"]))
    # equal distances go to the smaller id, repeated rows count once, no row of the query's id is listed
    zero = [v for (q, _), v in got.items() if q == 0]
    assert zero == [[(1, 1, 0.0), (2, 2, 0.0), (3, 100, 0.0)]]
    hundred = sorted(v for (q, _), v in got.items() if q == 100)
    assert hundred == sorted([[(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)], [(1, 3, 1.0), (2, 0, 2**0.5), (3, 1, 2**0.5)]])
    assert neighbours.nearest_neighbours(df.limit(0), F.col("id") >= 0).count() == 0
    assert neighbours.nearest_neighbours(df.where("vec_id = 5"), F.col("id") >= 0).count() == 0
    few = neighbours.nearest_neighbours(df.where("vec_id in (0, 3)"), F.col("id") == 0).collect()
    assert [(r["rank"], r["id"]) for r in few] == [(1, 3)]


def test_index_is_kept_and_partitions_do_not_matter(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32))]
    own = neighbours.vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    pivots = neighbours.choose_pivots(own, 32)
    neighbours.build(own, pivots, 3, 16).save(f"{tmp_path}/index")
    index = neighbours.PermutationIndex.load(spark, f"{tmp_path}/index")
    assert index.table.count() == 3 and (index.pivots == pivots).all() and (index.prefix, index.parts) == (16, 3)
    queries = own.where("id < 30")
    a = found(neighbours.search(index, queries, 5))
    b = found(neighbours.search(neighbours.build(own.repartition(7), pivots, 3, 16), queries.repartition(2), 5, blocks=4))
    assert a == b and len(a) == 30


def part_of(ids, x, pivots, prefix):
    near = neighbours.permutations(x, pivots, prefix)
    by = np.argsort(near.ravel(), kind="stable")
    starts = np.searchsorted(near.ravel()[by], np.arange(len(pivots) + 1)).astype(np.int32)
    return neighbours.Part({"ids": ids.tobytes(), "x": x.tobytes(), "starts": starts.tobytes(), "slots": (by // prefix).astype(np.int32).tobytes(), "places": (by % prefix).astype(np.int16).tobytes()}, prefix)


def test_parts_follow_rows_and_blocks_are_not_broadcast(spark, monkeypatch):
    """A part has many rows, however many partitions shuffles have; what explode repeats is no small table."""
    seen, search = [], neighbours.search
    monkeypatch.setattr(neighbours, "search", lambda index, queries, k, blocks=1: seen.append((index.parts, blocks)) or search(index, queries, k, blocks))
    monkeypatch.setattr(neighbours, "PART_ROWS", 400, raising=False)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(1000, 8)).astype(np.float32))]
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        result = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0)
        assert seen == [(2, 1)]
        assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()
        assert result.count() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_mean_footrule_is_the_mean():
    rng = np.random.default_rng(4)
    x, pivots, prefix = rng.normal(size=(60, 6)), rng.normal(size=(12, 6)), 5
    part = part_of(np.arange(60), x, pivots, prefix)
    order, begins, near = part.groups()
    asked = neighbours.permutations(rng.normal(size=(7, 6)), pivots, prefix)
    assert (near == neighbours.permutations(x[order], pivots, prefix)).all() and len(begins) == len(set(near[:, 0]))
    want = [[g.mean() for g in np.split(part.footrule(a)[order], begins[1:])] for a in asked]
    assert np.allclose(neighbours.mean_footrule(near, begins, asked, 12), want, rtol=1e-5)


@pytest.mark.parametrize("scale,offset", [(1.0, 0.0), (1e-3, 1e6), (1e-30, 0.0), (1e-165, 0.0), (1e30, 0.0), (1e200, 0.0), (1.0, 1e16)])
def test_single_precision_rules_out_none_of_the_nearest(monkeypatch, scale, offset):
    """All groups read: ids and distances are those of double precision, ties and copies included."""
    monkeypatch.setattr(neighbours, "ROUND", 1.0)
    monkeypatch.setattr(neighbours, "_TILE", (32, 100))
    monkeypatch.setattr(neighbours, "_HELD", 500)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 8))
    x[200:260] = x[0]
    x[300:400] = x[1] + 1e-7 * rng.normal(size=(100, 8))
    x = x * scale + offset
    ids, pivots = rng.permutation(1500) // 2, x[rng.choice(1500, 32, replace=False)]  # two vectors an id
    reader = neighbours.Reader(part_of(ids, x, pivots, 16), 10, 32)
    asked = np.concatenate((np.arange(0, 40), np.arange(200, 210), np.arange(300, 310)))
    query, found, far = reader.nearest(ids[asked], x[asked], neighbours.permutations(x[asked], pivots, 16))
    for i, q in enumerate(asked):
        gap = x - x[q]
        with np.errstate(over="ignore", under="ignore"):
            want = np.sqrt((gap * gap).sum(axis=1))
        order = [j for j in np.lexsort((ids, want)) if ids[j] != ids[q]][:10]
        assert far[query == i].tolist() == want[order].tolist() and found[query == i].tolist() == ids[order].tolist()
