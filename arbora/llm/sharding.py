"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Of every input partition, the number of rows that go to every target cell is drawn first, so that
all row and column sums of the matrix are exact; each partition then deals its rows out by a random
permutation of these counts, and every cell permutes what it got. The result is a uniform random
permutation with exact shard sizes and gapless slots, for one exchange of the data.

A shard is made of cells of about `cell_rows` rows, so no task ever holds a whole shard. The matrix
is never built: a partition draws its own row by walking down a binary tree over the partitions, in
which each node splits its column totals between its children with a seed of its own.

Defined results: nulls, empty texts and repeated rows are rows like any other, each with a place of
its own; an empty table gives no rows. Columns that are called as the shard or the slot, in any
case, are replaced; other names do not matter. A partition's rows are taken in the order of a keyed
hash of their content and its draws depend on its number only, so a task that is run again deals
out the same rows; rows that are equal in every column are interchangeable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, free_name, hashable, prepare

#: numpy's hypergeometric sampler takes populations below this.
_NUMPY_LIMIT = 10**9
#: Up to so many cells, each is a partition of its own.
MAX_PARTITIONS = 1 << 17


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` from good + bad; exact at any size.

    Beyond numpy's limit: a binomial proposal for the good ones, accepted in proportion to the
    chance that the bad ones make up the rest.
    """
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad else 0
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    p = draws / (good + bad)
    if p in (0.0, 1.0):
        return good if p else 0

    def log_pmf(k: int) -> float:
        if not 0 <= k <= bad:
            return -math.inf
        return math.lgamma(bad + 1) - math.lgamma(k + 1) - math.lgamma(bad - k + 1) + k * math.log(p) + (bad - k) * math.log1p(-p)

    top = log_pmf(min(bad, int((bad + 1) * p)))
    while True:
        x = int(rng.binomial(good, p))
        if math.log(rng.random() or 1e-300) <= log_pmf(draws - x) - top:
            return x


def split_columns(columns: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `draws` rows go to each column with these totals (multivariate hypergeometric)."""
    total = int(columns.sum())
    if total < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(columns, draws, method="marginals").astype(np.int64) if total else np.zeros_like(columns)
    if len(columns) == 1:
        return np.array([draws], dtype=np.int64)
    half = len(columns) // 2
    left = int(columns[:half].sum())
    x = hypergeometric(rng, left, total - left, draws)
    return np.concatenate((split_columns(columns[:half], x, rng), split_columns(columns[half:], draws - x, rng)))


def matrix_row(sizes: np.ndarray, columns: np.ndarray, part: int, seed: int) -> np.ndarray:
    """The row of partition `part`: `sizes` are all partitions' rows, `columns` all cells' rows."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    lo, hi, have = 0, len(sizes), columns.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_columns(have, int(ends[mid] - ends[lo]), np.random.default_rng([seed, lo, hi]))
        if part < mid:
            have, hi = left, mid
        else:
            have, lo = have - left, mid
    return have


def even_sizes(total: int, parts: int) -> np.ndarray:
    """`total` in `parts` numbers at most one apart, the larger ones first."""
    return np.full(parts, total // parts, dtype=np.int64) + (np.arange(parts) < total % parts)


def cell_sizes(total: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, shard and first slot of every cell."""
    shard_rows = even_sizes(total, shards)
    per = max(1, -(-int(shard_rows.max(initial=0)) // cell_rows))
    rows = np.concatenate([even_sizes(int(r), per) for r in shard_rows])
    first = np.concatenate([np.concatenate(([0], np.cumsum(even_sizes(int(r), per))[:-1])) for r in shard_rows])
    return rows, np.repeat(np.arange(shards), per), first


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 17, cell_rows: int = 10_000, shard_col: str = "shard", slot_col: str = "slot", key: list[Column] | None = None) -> DataFrame:
    """`docs` with a shard (0 .. shards - 1) and a slot that is gapless from 0 within the shard.

    Shard sizes are at most one row apart. `key` is what local permutations hash (default: every
    column). `docs` should be a scan or a checkpointed table: partitions are read twice, and a task
    that finds another number of rows than were counted stops the job.
    """
    spark = docs.sparkSession
    prepare(spark)
    part, a, b, place, cell, draw, rank = (free_name(docs, c) for c in ("part", "order_a", "order_b", "place", "cell", "draw", "rank_in_cell"))
    key = key or hashable(docs)
    counted = {r[0]: r[1] for r in docs.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    parts = max(counted, default=-1) + 1
    sizes = np.array([counted.get(p, 0) for p in range(parts)], dtype=np.int64)
    total = int(sizes.sum())
    rows, shard_of, first = cell_sizes(total, shards, cell_rows)
    cells = len(rows)
    plan = spark.sparkContext.broadcast((sizes, rows))

    dealt = docs.select("*", F.spark_partition_id().alias(part), F.xxhash64(F.lit(seed), *key).alias(a), F.xxhash64(F.lit(~seed), *key).alias(b)).sortWithinPartitions(a, b)

    @F.pandas_udf("cell int, draw long")
    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cell_of, draws, at, me = None, None, 0, None
        for p in batches:
            if len(p) and cell_of is None:
                me = int(p.iloc[0])
                sizes, rows = plan.value
                rng = np.random.default_rng([seed, 1, me])
                cell_of = rng.permutation(np.repeat(np.arange(len(rows), dtype=np.int32), matrix_row(sizes, rows, me, seed)))
                draws = rng.integers(0, 1 << 62, len(cell_of))
            if cell_of is not None and at + len(p) > len(cell_of):
                raise RuntimeError(f"partition {me} has more rows than were counted; checkpoint the input first")
            yield pd.DataFrame({"cell": cell_of[at : at + len(p)], "draw": draws[at : at + len(p)]} if len(p) else {"cell": np.zeros(0, "int32"), "draw": np.zeros(0, "int64")})
            at += len(p)
        if cell_of is not None and at != len(cell_of):
            raise RuntimeError(f"partition {me} has {at} rows, {len(cell_of)} were counted; checkpoint the input first")

    dealt = dealt.withColumn(place, deal(F.col(part))).withColumns({cell: F.col(place)["cell"], draw: F.col(place)["draw"]}).drop(place, part)
    exchanged = dealt.repartitionById(max(cells, 1), F.col(cell)) if cells <= MAX_PARTITIONS else dealt.repartition(MAX_PARTITIONS, cell)
    ranked = exchanged.withColumn(rank, F.row_number().over(Window.partitionBy(cell).orderBy(draw, a, b)).cast("bigint") - 1)
    per = cells // shards
    big = int(total // shards)  # shard and slot of a cell by arithmetic, as in cell_sizes
    more = total % shards
    shard = F.expr(f"cast(`{cell}` div {per} as int)")
    inside = F.col(cell) % per
    size = F.lit(big) + F.when(shard < more, 1).otherwise(0)
    base, extra = F.floor(size / per), size % per
    start = inside * base + F.least(inside, extra)
    taken = {shard_col.lower(), slot_col.lower()}
    return ranked.select(*[column(c) for c in docs.columns if c.lower() not in taken], shard.alias(shard_col), (start + F.col(rank)).cast("bigint").alias(slot_col))


def digest_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32) of every row; the size is the text's UTF-8 bytes plus one."""
    raw = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return docs.select(column(id_col).alias("doc_id"), (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))


