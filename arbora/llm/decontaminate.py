"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of `window` consecutive words of the benchmark items (a shorter item is
one window). The search slides over a text's words: a shift table on two-word blocks says how far
the window end may jump, a block with shift zero leads to the bucket of the patterns that end in the
same words, and these are compared word by word.

A benchmark of up to BLOCK_BYTES of text is searched for in one pass over the documents, with the
tables in every task. A larger one stays in Spark: of its suffixes only a bitmap of fixed size goes
to the tasks, places that pass it are joined to the patterns by their words. Results are the same.

Defined results: a null or empty text has no words, no hits and no items; a null item text is no
pattern; an item whose id is null marks words but is not listed; rows with the same item id are one
item; repeated documents are annotated one by one; other columns are kept, whatever their names;
empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, columns, durable, free_name, ngram_hashes, prepare, utf8, word_hashes

#: The bytes that end a word (after lower-casing A-Z).
DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(DELIMITERS, b" " * len(DELIMITERS))
#: UTF-8 bytes of benchmark text whose tables go to the tasks, at most; the patterns of more are joined.
BLOCK_BYTES = 2 << 20
#: Words of a suffix bucket, and bits of the number of a joined pattern's bucket: 8 MB for each pattern length.
TAIL, FILTER_BITS = 4, 26

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,stop:bigint>>>"


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_TO_SPACE).split()


def merge_spans(found) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for start, stop in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    return [(a, b) for a, b in spans]


class WuManber:
    """Windows of the items, in classes of equal length; each class has its own tables."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        classes: dict[int, dict[tuple[bytes, ...], set[str | None]]] = {}
        for item, text in items:
            words = split_words(text)
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if length else 0):
                classes.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
        self.classes = [(length, *self._tables(length, patterns)) for length, patterns in sorted(classes.items())]

    @staticmethod
    def _tables(length: int, patterns: dict[tuple[bytes, ...], set[str | None]]):
        block = min(2, length)
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str | None]]]] = {}
        for words, ids in patterns.items():
            for end in range(block, length + 1):
                key = words[end - block : end]
                shift[key] = min(shift.get(key, length), length - end)
            buckets.setdefault(words[-min(TAIL, length) :], []).append((list(words), ids))
        return block, shift, min(TAIL, length), buckets

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans [start, stop) of hit words, and the ids of the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[str | None] = set()
        n = len(words)
        for length, block, shift, tail, buckets in self.classes:
            jump, get, at = length - block + 1, shift.get, length
            while at <= n:  # `at` is one past the window's last word
                step = get((words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],), jump)
                if step:
                    at += step
                    continue
                for pattern, ids in buckets.get(tuple(words[at - tail : at]), ()):
                    if words[at - length : at] == pattern:
                        found.append((at - length, at))
                        items |= ids
                at += 1
        return merge_spans(found), items


#: The tables that this Python worker built last, by the name of their block.
_built: dict[str, WuManber] = {}


def _search_udf(items: list[tuple[str | None, bytes | None]], window: int, spark):
    shared, name = spark.sparkContext.broadcast((items, window)), uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built.clear()
            _built[name] = WuManber(*shared.value)
        tables = _built[name]
        for texts in batches:
            out = []
            for text in texts:
                words = split_words(text)
                spans, ids = tables.search(words)
                out.append((len(words), sum(b - a for a, b in spans), sorted(x for x in ids if x is not None), [{"start": a, "stop": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans"])

    return search


def _suffix_buckets(words: bytes, length: int) -> np.ndarray:
    """Bucket of every window of `length` words, in order: a hash of its last words."""
    tail = min(TAIL, length)
    h, _ = word_hashes([words])
    return (ngram_hashes(h, tail)[length - tail :] >> np.uint64(64 - FILTER_BITS)).astype(np.int64) if len(h) >= length else np.zeros(0, dtype=np.int64)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, length, words, bucket) of all patterns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["item", "length", "words", "bucket"], [pa.string(), pa.int32(), pa.binary(), pa.int64()]
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = split_words(text)
                length = min(window, len(words))
                buckets = _suffix_buckets(b" ".join(words), length).tolist() if length else []
                rows += [(item, length, b" ".join(words[i : i + length]), bucket) for i, bucket in enumerate(buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return items.select("item", "text").mapInArrow(cut, "item string, length int, words binary, bucket long")


def _filters(patterns: DataFrame) -> dict[int, np.ndarray]:
    """For each pattern length the bits of the buckets in use; their size does not depend on the benchmark's."""
    number = F.col("bucket") + 1  # the bitmap functions count from one
    parts = patterns.groupBy("length", F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        bits = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out.setdefault(r["length"], np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8))[(r["part"] - 1) * len(bits) : r["part"] * len(bits)] = bits
    return out


def _annotate_by_join(docs: DataFrame, items: DataFrame, out_col: str, window: int, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    patterns = durable(_windows(items, window))
    filters = spark.sparkContext.broadcast(_filters(patterns))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["k1", "k2", "start", "length", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            rows = []
            for k1, k2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = split_words(text)
                joined = b" ".join(words)
                for length, bits in filters.value.items():
                    at = _suffix_buckets(joined, length)
                    for i in np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                        rows.append((k1, k2, i, length, b" ".join(words[i : i + length])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    @F.pandas_udf("n_hit bigint, spans array<struct<start:bigint,stop:bigint>>")
    def merge(found: pd.Series) -> pd.DataFrame:
        merged = [merge_spans((x["start"], x["stop"]) for x in f) for f in found]
        return pd.DataFrame({"n_hit": [sum(b - a for a, b in m) for m in merged], "spans": [[{"start": a, "stop": b} for a, b in m] for m in merged]})

    k1, k2, hit = (free_name(docs, c) for c in ("text_k1", "text_k2", "join_hits"))
    raw = F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.withColumns({k1: F.xxhash64(raw), k2: F.crc32(raw)})
    places = keyed.select(F.col(k1), F.col(k2), raw.alias("t")).mapInArrow(candidates, "k1 long, k2 long, start long, length int, words binary")
    met = places.join(patterns.select("length", "words", "item"), ["length", "words"])
    spans = F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))
    found = met.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"), spans.alias("s"))
    found = durable(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.struct("items", merge("s").alias("m")).alias(hit)))
    lower = F.translate(F.coalesce(column(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.regexp_count(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("bigint")
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    h = F.col(hit)
    result = F.struct(n_words.alias("n_words"), F.coalesce(h["m"]["n_hit"], F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(h["items"], F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce(h["m"]["spans"], none).alias("spans"))
    return keyed.join(found, [k1, k2], "left").select(*columns(docs), result.alias(out_col))


def annotate(docs: DataFrame, benchmark: DataFrame, out_col: str, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`docs` with a struct column of n_words, n_hit, the items that occur (sorted) and hit spans.

    The benchmark's size is measured first: up to BLOCK_BYTES its tables go to the tasks and documents
    are read once, without a shuffle; the patterns of more are joined.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(column(item_col).cast("string").alias("item"), utf8(item_text_col).alias("text")).where("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return _annotate_by_join(docs, items, out_col, window, text_col)
    search = _search_udf([(r[0], bytes(r[1])) for r in items.collect()], window, spark)
    return docs.select(*columns(docs), search(utf8(text_col)).alias(out_col))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with the columns they came with."""
    hits = free_name(docs, "hits")
    return annotate(docs, benchmark, hits, window).where(F.col(hits)["n_hit"] == 0).select(*columns(docs))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
