"""Substring de-duplication by suffix trees over words, built in parts.

A window of `window` words is repeated if its word sequence starts at a second place, in the same
text or another: its suffix then hangs below an internal node of depth `window` or more of the
corpus's suffix tree. That tree is built in parts, and only where it can have such nodes:

1. Texts are keyed, equal texts meet and are kept once with their number of copies, in a bucketed
   table, so that later joins with the texts need no shuffle. All of an equal text is removed.
2. Every window has an anchor: the GRAM-word run inside it with the least hash. Parts are keyed by the
   words of the anchor, and hold the suffixes of the windows that have it, up to `window` - GRAM words
   before it. So a part's suffixes share a stretch of words and not their first ones, as they would if
   every suffix of the corpus were dealt by its own prefix: that sends about `window` words for each
   word of text, many times the input. Equal windows have equal anchors at equal offsets, so windows of
   different parts never match. An anchor that occurs once in the corpus leads to no repeat and goes
   no further.
3. Consecutive windows with one anchor are a run. Equal runs hang below the same nodes, so each is
   one string of its part, with the number of its places; a digest brings them together.
4. A part of over GROUP_ROWS strings is split by longer stretches: its windows are halved by how many
   words they begin before the anchor, and each half is keyed by all words that its windows have in
   common, which are 6, then 21, 28, 32, 34 and at last all 35. A part that is still too large has
   one window alone, which needs no tree: it is repeated if it has a second place.
5. Every other part is one task's suffix tree, held as sorted suffixes with their common prefixes.
   Its internal nodes of `window` words or more decide: a stack makes them from the common prefixes,
   and a string of several places is a node itself, whose leaves are these places. A node's words are
   marked in every leaf below it.
6. Marks return to the places of their strings, and the covered words are removed.

Defined results: null, empty and short texts have no window and nothing removed; all of a text
with an equal copy is removed if it has a window; repeated rows are copies; very long texts are cut
into pieces for hashing only; other columns are not read, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Scratch, column, durable, ngram_hashes, prepare, remove_folder, shared_folder, word_hashes
from .quality_classifier import groups_of_bytes

#: Words of an anchor.
GRAM = 6
#: Strings of a part that becomes one task's suffix tree, at most; it only sizes the parts.
GROUP_ROWS = 8_192

#: Texts or runs that a task remembers to send their words once only; then it begins anew.
REMEMBERED = 1 << 19

SPANS = "array<struct<start:bigint,stop:bigint>>"


def anchors(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, text number, first window, number of windows and the anchor's place, by run.

    Consecutive windows of a text that have the same anchor are one run.
    """
    h, n = word_hashes(texts)
    none = np.zeros(0, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    long = np.flatnonzero(n >= window)
    if not len(long):
        return np.zeros(0, dtype=np.uint64), none, none, none, none
    g = ngram_hashes(h, GRAM)
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, width = window - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    counts = n[long] - window + 1
    text = np.repeat(long, counts)
    p = np.arange(counts.sum()) + np.repeat(starts[long] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
    q = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(p), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(p)))
    return g[q[at]], text[at], p[at] - starts[text[at]], size, q[at] - starts[text[at]]


def _text_key(raw: Column) -> tuple[Column, Column]:
    """128 bits of the text's SHA-256, which no two texts can be made to share."""
    digest = F.sha2(raw.cast("binary"), 256)
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint") for at in (1, 17))


def _texts_table(docs: DataFrame, text_col: str, name: str, path: str) -> DataFrame:
    """Distinct texts (k1, k2, copies, words) in a table bucketed by k1; words are zstd-compressed,
    one space between two. Copies within a partition meet before the shuffle."""
    spark = docs.sparkSession

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[tuple[int, int], int] = {}
        pack = zstandard.ZstdCompressor(level=6)
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("copies", pa.int64()), ("words", pa.binary())])

        def late() -> Iterator[pa.RecordBatch]:
            rest = [(*k, n, None) for k, n in again.items() if n]
            again.clear()
            for i in range(0, len(rest), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest[i : i + BATCH_ROWS], strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            if len(again) > REMEMBERED:
                yield from late()
            rows: list[tuple] = []
            for k1, k2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (k1, k2) in again:
                    again[k1, k2] += 1
                else:
                    again[k1, k2] = 0
                    rows.append((k1, k2, 1, pack.compress(b" ".join(text.split()))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)
        yield from late()

    raw = F.coalesce(column(text_col).cast("string"), F.lit(""))
    k1, k2 = _text_key(raw)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), raw.cast("binary").alias("t"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    combined = keyed.mapInArrow(combine, "k1 long, k2 long, copies long, words binary")
    distinct = combined.repartition(parts, "k1").groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), F.first("words", ignorenulls=True).alias("words"))
    distinct.write.bucketBy(parts, "k1").option("path", path).option("compression", "none").format("parquet").saveAsTable(name)
    return spark.table(name)


def _unpack(blobs) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b) for b in blobs]


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """(core, k1, k2, run): anchors of all texts. `run` packs the first window, the number of windows
    and the words from the first window to the anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = 0
            for group in groups_of_bytes(_unpack(b.column(2).to_pylist())):
                g, text, first, size, place = anchors(group, window)
                run = first << 32 | size << 16 | (place - first)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(k1[at + text]), pa.array(k2[at + text]), pa.array(run)], names=["core", "k1", "k2", "run"])
                at += len(group)

    return texts.select("k1", "k2", "words").mapInArrow(find, "core long, k1 long, k2 long, run long")


#: A run of windows in its text: its part, the digest of its words, its text and its first window. The
#: words come with the first of equal runs of a task, as do the number of windows and the words before the anchor.
RUN = "core long, d1 long, d2 long, k1 long, k2 long, first long, n long, before long, words binary"
_RUN_FIELDS = {"core": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "first": pa.int64(), "n": pa.int64(), "before": pa.int64(), "words": pa.binary()}
#: A string of a part, or some consecutive windows of it from window `first`; `low` to `high` words of
#: its windows lie before the anchor; the string occurs in so many places.
ROW = "core long, low int, high int, d1 long, d2 long, first long, n long, before long, words binary, places long"
_FIELDS = {"core": pa.int64(), "low": pa.int32(), "high": pa.int32(), "d1": pa.int64(), "d2": pa.int64(), "first": pa.int64(), "n": pa.int64(), "before": pa.int64(), "words": pa.binary(), "places": pa.int64()}


def _batch(rows: Sequence[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields.values())], names=list(fields))


def _run_rows(joined: DataFrame, window: int) -> DataFrame:
    """RUN of every live run, from (k1, k2, words, live) with the whole text's words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows: list[tuple] = []
            for k1, k2, blob, live in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = _unpack([blob])[0]
                starts, ends = _edges(words)
                for x in live:
                    first, n, before = x["run"] >> 32, x["run"] >> 16 & 0xFFFF, x["run"] & 0xFFFF
                    text = words[starts[first] : ends[first + n + window - 2]]
                    digest = hashlib.blake2b(text, digest_size=16).digest()
                    d1, d2 = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    if digest in seen:
                        rows.append((x["core"], d1, d2, k1, k2, first, None, None, None))
                    else:
                        seen.add(digest)
                        rows.append((x["core"], d1, d2, k1, k2, first, n, before, text))
                while len(rows) >= 4096:
                    yield _batch(rows[:4096], _RUN_FIELDS)
                    del rows[:4096]
            yield _batch(rows, _RUN_FIELDS)

    return joined.select("k1", "k2", "words", "live").mapInArrow(cut, RUN)


def halves(row: tuple, window: int) -> list[tuple]:
    """The run's windows in two halves by the words they begin before the anchor, each with the longer
    prefix that all windows of its half share as its part."""
    _, low, high, d1, d2, first, n, before, words, places = row
    starts, ends = _edges(words)
    middle, out = (low + high) // 2, []
    for a, b in ((low, middle), (middle + 1, high)):
        i, j = max(0, before - b), min(n - 1, before - a)
        if a <= b and i <= j:
            shared = words[starts[before - a] : ends[before + window - b - 1]]
            core = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=bytes([a, b])).digest(), "big", signed=True)
            out.append((core, a, b, d1, d2, first + i, j - i + 1, before - i, words[starts[i] : ends[j + window - 1]], places))
    return out


def _split_rows(rows: DataFrame, window: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                yield _batch([half for row in zip(*(part.column(i).to_pylist() for i in range(len(_FIELDS))), strict=True) for half in halves(row, window)], _FIELDS)

    return rows.select(*_FIELDS).mapInArrow(split, ROW)


def _edges(words: bytes) -> tuple[list[int], list[int]]:
    """Start and end offsets of the words of a text with one space between two."""
    ends = np.append(np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 0x20), len(words)).tolist()
    return [0, *(e + 1 for e in ends[:-1])], ends


def common_words(a: bytes, b: bytes) -> int:
    """Number of leading words that two suffixes share; every word of a suffix ends with a space."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return a.count(b" ", 0, high)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return a.count(b" ", 0, low)


def suffix_tree(runs: list[tuple[int, bytes]], window: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Leaves (run, first word) of the runs (number of windows, words) in the order of their suffixes,
    and the words that each shares with the one before it; fewer than `window` count as none.

    A common prefix of words is one of bytes that ends with a space, so the order of bytes will do.
    """
    leaves: list[tuple[bytes, int, int, int]] = []
    for r, (n, words) in enumerate(runs):
        starts, ends = _edges(words)
        text = words + b" "
        leaves += [(text[starts[i] :], r, i, ends[i + window - 1] + 1 - starts[i]) for i in range(n)]
    leaves.sort()
    shared, last = [0], None
    for suffix, _, _, deep in leaves:
        if last is not None:
            shared.append(common_words(last, suffix) if last[:deep] == suffix[:deep] else 0)
        last = suffix
    return [(r, i) for _, r, i, _ in leaves], shared[: len(leaves)]


def deep_nodes(shared: list[int]) -> list[tuple[int, int, int]]:
    """Internal nodes (depth, first leaf, one past the last leaf) of a tree from its leaves' common
    prefixes; a node's children come before it."""
    out: list[tuple[int, int, int]] = []
    open_nodes: list[tuple[int, int]] = []  # depth and first leaf, deeper ones later
    for i, depth in enumerate([*shared[1:], 0], 1):
        first = i - 1
        while open_nodes and open_nodes[-1][0] > depth:
            top, first = open_nodes.pop()
            out.append((top, first, i))
        if depth and (not open_nodes or open_nodes[-1][0] < depth):
            open_nodes.append((depth, first))
    return out


def deepest_nodes(shared: list[int]) -> list[int]:
    """For each leaf the depth of the deepest internal node above it, 0 if there is none. Nodes come
    children first, so the first one that covers a leaf counts; covered leaves are skipped."""
    out, after = [0] * len(shared), list(range(len(shared) + 1))  # the next leaf that may still be uncovered

    def free(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    for depth, low, high in deep_nodes(shared):
        i = free(low)
        while i < high:
            out[i], after[i] = depth, i + 1
            i = free(i + 1)
    return out


def subtree_repeats(strings: list[tuple[int, bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """For each string (number of windows, words, places) of a part the spans of words, from its first,
    that hang below an internal node of `window` words or more.

    A string of several places is such a node for each of its suffixes: its leaves are the places.
    Equal strings, as halves of different runs can be, count as one of all their places.
    """
    places: dict[tuple[int, bytes], int] = {}
    for n, words, k in strings:
        places[n, words] = places.get((n, words), 0) + k
    own = list(places)
    found: list[list[tuple[int, int]]] = [[(0, n + window - 1)] if places[n, words] > 1 else [] for n, words in own]
    if len(own) > 1:
        leaves, shared = suffix_tree(own, window)
        for (r, i), depth in zip(leaves, deepest_nodes(shared), strict=True):
            if depth:
                found[r].append((i, i + depth))
    spans = {string: merge_spans(marked) for string, marked in zip(own, found, strict=True)}
    return [spans[n, words] for n, words, _ in strings]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = {"d1": pa.int64(), "d2": pa.int64(), "start": pa.int64(), "stop": pa.int64()}


def _tree_marks(rows: DataFrame, window: int) -> DataFrame:
    """(d1, d2, start, stop) of the spans of their strings that the suffix trees of the parts mark."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, held = None, []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1 or (held and (held[0][3] > 1 or held[0][5] > 1)):
                for (d1, d2, first, *_), spans in zip(held, subtree_repeats([r[3:] for r in held], window), strict=True):
                    out.extend((d1, d2, first + a, first + b) for a, b in spans)
            held.clear()

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if row[0] != core:
                    close()
                    core = row[0]
                held.append(row[1:])
            if len(out) > 10_000:
                yield _batch(out, _SPANS)
                out.clear()
        close()
        yield _batch(out, _SPANS)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    return rows.select("core", "d1", "d2", "first", "n", "words", "places").repartition(parts, "core").sortWithinPartitions("core").mapInArrow(walk, "d1 long, d2 long, start long, stop long")


def string_marks(strings: DataFrame, window: int, keep: Scratch) -> DataFrame:
    """ROW of all strings of all parts -> (d1, d2, start, stop): spans that occur in another place too."""
    rows, width, found = strings, window - GRAM + 1, None
    while True:
        sizes = keep(rows.groupBy("core").agg(F.count("*").alias("size")))
        large = sizes.where(F.col("size") > GROUP_ROWS)
        fits = rows if large.isEmpty() else rows.join(large.select("core"), "core", "left_anti")
        marked = _tree_marks(fits, window)
        found = marked if found is None else found.union(marked)
        if large.isEmpty():
            return found
        rows = rows.join(large.select("core"), "core", "left_semi")
        if width == 1:  # one window a part: it is repeated if it has a second place
            whole = rows.groupBy("words").agg(F.sum("places").alias("size")).where("size > 1").select("words")
            return found.union(rows.join(whole, "words").select("d1", "d2", F.col("first").alias("start"), (F.col("first") + window).alias("stop")))
        rows, width = keep(_split_rows(rows, window)), -(-width // 2)


def marks(texts: DataFrame, window: int, keep: Scratch) -> DataFrame:
    """(k1, k2, spans): spans of repeated words (in order, may overlap) of the distinct texts."""
    anchored = keep(_anchor_rows(texts, window))
    several = keep(anchored.groupBy("core").agg(F.count("*").alias("size")).where("size > 1").select("core"))
    live = anchored.join(several, "core").groupBy("k1", F.col("k2").alias("j2")).agg(F.collect_list(F.struct("core", "run")).alias("live"))
    # on k1 alone, by which both are dealt already
    runs = keep(_run_rows(texts.join(live, "k1").where(F.col("k2") - F.col("j2") == 0), window))
    keep.drop(before=1)  # anchors are not read any more
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    strings = keep(runs.groupBy("core", "d1", "d2").agg(F.count("*").alias("places"), first("n"), first("before"), first("words")))
    rows = strings.select("core", F.lit(0).alias("low"), F.lit(window - GRAM).alias("high"), "d1", "d2", F.lit(0).cast("long").alias("first"), "n", "before", "words", "places")
    spans = string_marks(rows, window, keep).groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    placed = runs.select("d1", "d2", "k1", "k2", "first").join(spans, ["d1", "d2"])
    each = placed.select("k1", "k2", "first", F.explode("spans").alias("s"))
    return each.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct((F.col("first") + F.col("s.start")).alias("start"), (F.col("first") + F.col("s.stop")).alias("stop")))).alias("spans"))


RESULT = f"n_words bigint, n_removed bigint, kept_sha256 string, spans {SPANS}"


def _cut_out(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[list[bytes], list[dict]]:
    kept: list[bytes] = []
    merged: list[dict] = []
    at = 0
    for start, stop in spans:
        if merged and start <= merged[-1]["stop"]:
            merged[-1]["stop"] = max(stop, merged[-1]["stop"])
        else:
            merged.append({"start": start, "stop": stop})
        kept += words[at:start]
        at = max(at, stop)
    return kept + words[at:], merged


def deduplicate(docs: DataFrame, window: int = 35, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans[, kept]): one row per document.

    `spans` are the removed words, `kept` the words that stay, joined by single spaces.
    """
    spark = docs.sparkSession
    prepare(spark)
    name = f"arbora_texts_{uuid.uuid4().hex}"
    path = shared_folder(spark, "texts")
    with Scratch(spark, "substring") as keep:
        try:
            texts = _texts_table(docs, text_col, name, path)
            return durable(_removed(docs, texts, marks(texts, window, keep), window, text_col, id_col, keep_text))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_folder(spark, path)


def _removed(docs: DataFrame, texts: DataFrame, found: DataFrame, window: int, text_col: str, id_col: str, keep_text: bool) -> DataFrame:
    marked = texts.join(found, ["k1", "k2"], "left")

    @F.pandas_udf(f"struct<{RESULT.replace(' bigint', ':bigint').replace(' string', ':string').replace('spans ', 'spans:')},kept:binary>")
    def remove(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for blobs, copies, spans in batches:
            rows = []
            for words, n, found in zip(_unpack(blobs), copies, spans, strict=True):
                w = words.split()
                if n > 1 and len(w) >= window:
                    cut = [(0, len(w))]
                else:
                    cut = [(x["start"], x["stop"]) for x in found] if found is not None else []
                kept, merged = _cut_out(w, cut)
                text = b" ".join(kept)
                rows.append((len(w), len(w) - len(kept), hashlib.sha256(text).hexdigest(), merged, text if keep_text else None))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "spans", "kept"])

    result = marked.select("k1", "k2", remove("words", "copies", "spans").alias("r")).select("k1", "k2", "r.*")
    raw = F.coalesce(column(text_col).cast("string"), F.lit(""))
    k1, k2 = _text_key(raw)
    keys = docs.select(column(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"))
    out = keys.join(result, ["k1", "k2"])
    return out.select("id", "n_words", "n_removed", "kept_sha256", "spans", *([F.col("kept").cast("string").alias("kept")] if keep_text else []))
