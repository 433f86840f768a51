"""Approximate nearest neighbours by a permutation index.

1. PIVOTS vectors are drawn from a bounded sample. A vector is represented by its PREFIX nearest pivots
   in order of distance.
2. The index is a table of parts, each with the vectors of one share of the rows and, for every pivot,
   an inverted file: which vectors have it among their nearest, and in which place.
3. With places counted from 0 and a pivot that is absent at place PREFIX, the footrule distance of two
   lists of pivots is PREFIX * (PREFIX + 1) less twice the sum of PREFIX - max(place, place) over the
   pivots that both have, so each entry of a file adds its part.
4. Vectors of a part that have the same nearest pivot are read together. The footrule distances from a
   query to the vectors of such a group have a mean that takes only the counts of its entries by pivot
   and place, and a query reads the groups in order of that mean, a tenth of a part at a time, until
   CALM tenths in a row change nothing among the nearest. Nothing caps how far that goes, so a large
   group of near copies, whose lists hardly differ, is read on until it is settled.
5. What is read is reranked by Euclidean distance. The queries that read a group at the same time meet
   it in one matrix product of single precision; whatever that cannot rule out, by a bound on its
   rounding, is measured in double precision from the vectors as they are.

Queries travel in blocks to every part, so no row is ever paired with another outside a task's arrays,
and each query and part sends back its nearest only.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
those of another length than the pivots (the commonest in the sample; the shorter of equally common
ones) or without an id; a row repeated in id and vector counts once; a query is never its own
neighbour, nor is any row of its id; an id with several vectors is answered for each of them, and
`query_vector` tells the answers apart; equal distances go to the smaller id; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.vectors import doubles

from .common import column, prepare

#: Pivots, the sample that they are drawn from, and the length of a vector's list.
PIVOTS, SAMPLE, PREFIX = 256, 2048, 64
#: Share of a part that is reranked at a time, and how many of them must bring nothing new.
ROUND, CALM = 0.1, 6
#: Bytes of the vectors of a part and of a block of queries, about; least rows of a part that is not the only one.
PART_BYTES, BLOCK_BYTES, PART_ROWS = 16 << 20, 2 << 20, 16384
#: Share of a part, and vectors at least, that every query is held against first, to know how near its nearest must be.
FIRST, FIRST_ROWS = 0.125, 1024
#: Queries and rows of a matrix product; pairs that wait to be measured, and that are measured at a time.
_TILE, _HELD, _PAIRS = (512, 1024), 1 << 20, 1 << 15
#: Of vectors that lie closer, squares underflow: all are measured in double precision.
_LEAST_SCALE = 1e-140
_MIX = 23


def usable(x: Column) -> Column:
    """Whether a vector of doubles takes part."""
    inf = float("inf")
    least, most = F.array_min(x), F.array_max(x)  # NaN is the greatest of all; nulls are passed over
    whole = ~F.array_contains(x, F.lit(inf))  # null if a component is
    return F.coalesce(whole & (least > -inf) & (most < inf) & ((least != 0) | (most != 0)), F.lit(False))


def vectors(rows: DataFrame, id_col: str, x_col: str) -> DataFrame:
    """(id, x) of the rows that take part, each once."""
    read = rows.select(column(id_col).cast("long").alias("id"), doubles(column(x_col)).alias("x"))
    return read.where(F.col("id").isNotNull() & usable(F.col("x")))


@dataclass
class PermutationIndex:
    """Pivots and the table (part, ids, x, starts, slots, places) of parts; all numbers as bytes."""

    table: DataFrame
    pivots: np.ndarray
    prefix: int
    parts: int

    def save(self, folder: str) -> None:
        spark = self.table.sparkSession
        self.table.write.parquet(f"{folder}/parts")
        spark.createDataFrame([(i, p.tolist(), self.prefix, self.parts) for i, p in enumerate(self.pivots)], "pivot int, x array<double>, prefix int, parts int").coalesce(1).write.parquet(f"{folder}/pivots")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> PermutationIndex:
        rows = sorted(spark.read.parquet(f"{folder}/pivots").collect(), key=lambda r: r["pivot"])  # PIVOTS rows
        pivots = np.array([r["x"] for r in rows]) if rows else np.zeros((0, 0))
        return PermutationIndex(spark.read.parquet(f"{folder}/parts"), pivots, rows[0]["prefix"] if rows else 0, rows[0]["parts"] if rows else 1)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Distinct vectors of a sample: the rows of least hash of id and vector."""
    found = rows.orderBy(F.xxhash64("id", "x", F.lit(_MIX)), "id").limit(sample).select("x").collect()
    if not found:
        return np.zeros((0, 0))
    lengths, times = np.unique([len(r["x"]) for r in found], return_counts=True)
    d = lengths[times.argmax()]
    distinct = dict.fromkeys(tuple(r["x"]) for r in found if len(r["x"]) == d)
    return np.array(list(distinct)[:pivots])


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each vector, nearest first, of equally near ones the first."""
    out = np.empty((len(x), prefix), dtype=np.int64)
    for i in range(0, len(x), 4096):
        far = (pivots * pivots).sum(axis=1) - 2 * x[i : i + 4096] @ pivots.T
        out[i : i + 4096] = np.argsort(far, axis=1, kind="stable")[:, :prefix]
    return out


def build(rows: DataFrame, pivots: np.ndarray, parts: int, prefix: int = PREFIX) -> PermutationIndex:
    """The index of all (id, x) rows whose vectors have the pivots' length."""
    prefix, spark = min(prefix, len(pivots)), rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def files(part: pa.Table) -> pa.Table:
        n, p = part.num_rows, len(shared.value)
        ids = part.column("id").to_numpy()
        x = part.column("x").combine_chunks().flatten().to_numpy().reshape(n, -1)
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        near = permutations(x, shared.value, prefix)
        by = np.argsort(near.ravel(), kind="stable")
        starts = np.searchsorted(near.ravel()[by], np.arange(p + 1))
        columns = [ids, x, starts.astype(np.int32), (by // prefix).astype(np.int32), (by % prefix).astype(np.int16)]
        return pa.Table.from_arrays([part.column("part").slice(0, 1), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=["part", "ids", "x", "starts", "slots", "places"])

    d = pivots.shape[1] if len(pivots) else 0
    own = rows.where(F.size("x") == d).dropDuplicates(["id", "x"]).withColumn("part", F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int")).repartition(2 * parts, "part")
    schema = "part int, ids binary, x binary, starts binary, slots binary, places binary"
    return PermutationIndex(own.groupBy("part").applyInArrow(files, schema), pivots, prefix, parts)


class Part:
    """One part of an index within a task."""

    def __init__(self, row: dict[str, bytes], prefix: int):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.x = np.frombuffer(row["x"], dtype=np.float64).reshape(len(self.ids), -1)
        self.starts = np.frombuffer(row["starts"], dtype=np.int32)
        self.slots = np.frombuffer(row["slots"], dtype=np.int32)
        self.places = np.frombuffer(row["places"], dtype=np.int16)
        self.prefix = prefix

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """Footrule distance of a list of pivots to the list of every vector of the part."""
        ends = [(self.starts[p], self.starts[p + 1]) for p in near]
        slots = np.concatenate([self.slots[a:b] for a, b in ends])
        places = np.concatenate([np.maximum(self.places[a:b], at) for at, (a, b) in enumerate(ends)])
        shared = np.bincount(slots, weights=self.prefix - places, minlength=len(self.ids))
        return self.prefix * (self.prefix + 1) - 2 * shared

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the vectors by nearest pivot, where each group of it begins, and their pivots by place."""
        near = np.empty((len(self.ids), self.prefix), dtype=np.int64)
        near[self.slots, self.places] = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(near[:, 0], kind="stable")
        near = near[order]
        return order, np.flatnonzero(np.diff(near[:, 0], prepend=-1)), near


def mean_footrule(near: np.ndarray, begins: np.ndarray, asked: np.ndarray, pivots: int) -> np.ndarray:
    """Mean footrule distance from each list of `asked` to the lists `near` of each group of rows."""
    n, prefix = near.shape
    sizes = np.diff(begins, append=n)
    group = np.repeat(np.arange(len(begins)), sizes)
    hist = lambda at: np.bincount(near[:, at] * len(begins) + group, minlength=pivots * len(begins)).reshape(pivots, -1)
    counts = [hist(at).astype(np.float32) for at in range(prefix)]
    # adds: sum over a group's rows of prefix - max(place, at), by pivot; seen: rows with the pivot before `at`
    adds, seen = sum((prefix - at) * c for at, c in enumerate(counts)), np.zeros_like(counts[0])
    shared = np.zeros((len(asked), len(begins)), dtype=np.float32)
    for at in range(prefix):
        shared += adds[asked[:, at]]
        seen += counts[at]
        adds = adds - seen
    return prefix * (prefix + 1) - 2 * shared / sizes


def tiles(asked: int, begin: int, end: int) -> Iterator[tuple[slice, slice]]:
    """Stretches of queries and of rows for products of a bounded size."""
    for i in range(0, asked, _TILE[0]):
        for j in range(begin, end, _TILE[1]):
            yield slice(i, min(i + _TILE[0], asked)), slice(j, min(j + _TILE[1], end))


class Reader:
    """A part, ready for blocks of queries that ask for the k nearest.

    Of rows with the same vector only the k + 1 of least id can be among anyone's nearest.
    """

    def __init__(self, part: Part, k: int, pivots: int):
        self.k, self.pivots = k, pivots
        order, _, near = part.groups()
        kept = _without_copies(part.ids[order], part.x[order], k + 1)
        self.near, self.ids, self.x = near[kept], part.ids[order][kept], part.x[order][kept]
        self.begins = np.flatnonzero(np.diff(self.near[:, 0], prepend=-1))
        self.ends = np.append(self.begins[1:], len(self.ids))
        with np.errstate(over="ignore", invalid="ignore"):
            self.middle = self.x.mean(axis=0)
            self.scale = np.abs(self.x - self.middle).max()
            if self.scale < _LEAST_SCALE:
                self.scale = np.inf
            low, self.norms = self._low(self.x)
            self.tall = np.column_stack((low, self.norms))  # a product with (-2 * query, 1) lacks the query's length only

    def _low(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors about the part's middle in single precision, and their squared lengths."""
        low = ((x - self.middle) / self.scale).astype(np.float32)
        return low, (low * low).sum(axis=1)

    def _measure(self, own: np.ndarray, x: np.ndarray, query: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the pairs whose ids differ."""
        other = own[query] != self.ids[row]
        query, row = query[other], row[other]
        far = np.empty(len(query))
        for at in range(0, len(query), _PAIRS):
            gap = self.x[row[at : at + _PAIRS]] - x[query[at : at + _PAIRS]]
            far[at : at + _PAIRS] = np.sqrt((gap * gap).sum(axis=1))
        return query, row, far

    def nearest(self, own: np.ndarray, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the k nearest vectors found for each query, of other ids than its own."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._nearest(own, x, near)

    def _nearest(self, own: np.ndarray, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m, k = len(self.ids), len(own), self.k
        low, norms = self._low(x)
        doubled = np.column_stack((-2 * low, np.ones(m, dtype=np.float32)))
        rounding = np.float32(4 * (x.shape[1] + 8) * np.finfo(np.float32).eps) * (norms + self.norms.max())
        best = np.full((m, k), -1)  # rows of the part
        far = np.full((m, k), np.inf)
        bound = np.full(m, np.inf, dtype=np.float32)

        def keep(query: np.ndarray, row: np.ndarray) -> np.ndarray:
            """Takes in pairs; the queries whose nearest they change."""
            query, row, gap = self._measure(own, x, query, row)
            near_enough = ~(gap > far[query, -1])
            query, row, gap = query[near_enough], row[near_enough], gap[near_enough]
            touched, at = np.unique(query, return_inverse=True)
            held = best[touched] >= 0
            query = np.concatenate((np.nonzero(held)[0], at))
            row, gap = np.concatenate((best[touched][held], row)), np.concatenate((far[touched][held], gap))
            order = np.lexsort((row, self.ids[row], gap, query))
            query, row, gap = query[order], row[order], gap[order]
            fresh = np.append(True, (query[1:] != query[:-1]) | (row[1:] != row[:-1]))[: len(query)]
            query, row, gap = query[fresh], row[fresh], gap[fresh]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            top = rank < k
            rows, gaps = np.full((len(touched), k), -1), np.full((len(touched), k), np.inf)
            rows[query[top], rank[top]], gaps[query[top], rank[top]] = row[top], gap[top]
            changed = touched[(rows != best[touched]).any(axis=1)]
            best[touched], far[touched] = rows, gaps
            with np.errstate(under="ignore"):
                last = (gaps[:, -1] / self.scale) ** 2
            bound[touched] = np.nextafter(last.astype(np.float32), np.float32(np.inf)) - norms[touched] + rounding[touched]
            return changed

        def within(asked: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of queries and rows that the product does not place beyond the query's bound."""
            gap = doubled[asked] @ self.tall[rows].T
            at = np.flatnonzero(~(gap > bound[asked, None]))  # what is not a number is measured too
            return asked[at // gap.shape[1]], at % gap.shape[1] + rows.start

        some = np.unique(np.linspace(0, n - 1, min(n, max(FIRST_ROWS, int(n * FIRST)))).astype(np.int64))
        for at in range(0, m, 512):
            asked = np.arange(at, min(at + 512, m))
            gap = doubled[asked] @ self.tall[some].T
            gap[own[asked, None] == self.ids[some]] = np.inf
            limit = np.partition(gap, k - 1, axis=1)[:, k - 1] + 2 * rounding[asked] if len(some) >= k else np.full(len(asked), np.inf, dtype=np.float32)
            pair = np.flatnonzero(~(gap > limit[:, None]))
            keep(asked[pair // len(some)], some[pair % len(some)])

        sizes = self.ends - self.begins
        order = np.argsort(mean_footrule(self.near, self.begins, near, self.pivots), axis=1, kind="stable")
        step = max(2 * k, int(np.ceil(n * ROUND)))
        turn = np.empty(order.shape, dtype=np.int32)
        np.put_along_axis(turn, order, ((np.cumsum(sizes[order], axis=1) - sizes[order]) // step).astype(np.int32), axis=1)
        calm = np.zeros(m, dtype=np.int64)
        for at in range(int(turn.max()) + 1):
            active = np.flatnonzero(calm < CALM)
            if not len(active):
                break
            group, query = np.nonzero((turn[active] == at).T)
            ends = np.searchsorted(group, np.arange(len(sizes) + 1))
            calm[active] += 1
            pairs, held = [], 0
            for g in np.unique(group):
                asked = active[query[ends[g] : ends[g + 1]]]
                for i, j in tiles(len(asked), self.begins[g], self.ends[g]):
                    pairs.append(within(asked[i], j))
                    held += len(pairs[-1][0])
                    if held > _HELD:
                        calm[keep(*map(np.concatenate, zip(*pairs, strict=True)))] = 0
                        pairs, held = [], 0
            if pairs:
                calm[keep(*map(np.concatenate, zip(*pairs, strict=True)))] = 0
        query, place = np.nonzero(best >= 0)
        return query, self.ids[best[query, place]], far[query, place]


def _without_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows but those whose vector `most` rows of lower ids have too."""
    odd = np.random.default_rng(_MIX).integers(0, 1 << 62, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (np.ascontiguousarray(x).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, key))
    begins = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    rank = np.arange(len(ids)) - np.repeat(begins, np.diff(begins, append=len(ids)))
    if rank.max() < most:
        return np.arange(len(ids))
    first = order[np.arange(len(ids)) - rank]
    alike = np.logical_and.reduceat((x[order] == x[first]).all(axis=1), begins)  # keys of unequal vectors may agree
    late = np.repeat(alike, np.diff(begins, append=len(ids))) & (rank >= most)
    return np.sort(order[~late])


def search(index: PermutationIndex, queries: DataFrame, k: int, blocks: int = 1) -> DataFrame:
    """(query_id, query_vector, rank, id, score): the k nearest found of every (id, x) query."""
    spark, pivots, prefix = queries.sparkSession, index.pivots, index.prefix
    prepare(spark)
    shared = spark.sparkContext.broadcast(pivots)
    d = pivots.shape[1] if len(pivots) else 0

    def pack(block: pa.Table) -> pa.Table:
        ids, x = block.column("id").to_numpy(), block.column("x").combine_chunks().flatten().to_numpy()
        keys = block.column("query_vector").to_numpy()
        near = permutations(x.reshape(len(ids), -1), shared.value, prefix).astype(np.int16)
        return pa.Table.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (ids, keys, x, near)], names=["q_ids", "q_keys", "q_x", "q_near"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].as_py() if name == "part" else b.column(name)[i].as_buffer() for name in b.schema.names}
                if row["part"] != at:
                    at, reader = row["part"], Reader(Part(row, prefix), k, len(shared.value))
                own, keys = np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["q_keys"], dtype=np.int64)
                x = np.frombuffer(row["q_x"], dtype=np.float64).reshape(len(own), -1)
                near = np.frombuffer(row["q_near"], dtype=np.int16).reshape(len(own), -1)
                query, ids, far = reader.nearest(own, x, near)
                for j in range(0, len(query), 10_000):
                    some = query[j : j + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[some], keys[some], ids[j : j + 10_000], far[j : j + 10_000])], names=["query_id", "query_vector", "id", "score"])

    asked = queries.where(F.size("x") == d).dropDuplicates(["id", "x"]).withColumn("query_vector", F.xxhash64("x"))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int")).repartition(2 * blocks, "block")
    packed = dealt.groupBy("block").applyInArrow(pack, "q_ids binary, q_keys binary, q_x binary, q_near binary")
    sent = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))))
    # Few bytes, much work: fixed numbers of tasks, here and above, are not put together by size. Nor may
    # a side be taken for small and sent through the driver: Spark does not see what explode repeats.
    met = index.table.repartition(2 * index.parts, "part").hint("merge").join(sent.repartition(2 * index.parts, "part"), "part")
    found = met.mapInArrow(look, "query_id long, query_vector long, id long, score double")
    order = Window.partitionBy("query_id", "query_vector").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "query_vector", "rank", "id", "score")


def nearest_neighbours(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", x_col: str = "embedding") -> DataFrame:
    """The k nearest found of every row for whose `id` the condition `queries` holds, among all rows."""
    spark = rows.sparkSession
    prepare(spark)
    own = vectors(rows, id_col, x_col)
    pivots = choose_pivots(own)
    n, asked = own.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    wide = 8 * max(1, pivots.shape[1] if len(pivots) else 0)
    most, block = max(1, PART_BYTES // wide), max(1, BLOCK_BYTES // wide)
    parts = max(1, min(n // PART_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // most))
    return search(build(own, pivots, parts), own.where(queries), k, max(1, -(-asked // block)))
