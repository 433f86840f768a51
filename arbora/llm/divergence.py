"""Source divergence audit: how far each source's words are from its language's and from other sources'.

1. A translate table turns the bytes A-Z of a text into small letters and every other ASCII byte that
   is no letter into a blank, in one pass; `bytes.split` cuts the terms, and a Counter a document gives
   their frequencies. Bytes of longer UTF-8 sequences are never ASCII, so no text is decoded.
2. Tasks add the documents up by group, so the exchange carries one row a (group, term) and task, not
   one a word. The aggregate keeps, for each (language, term), the sparse list of sources that use it.
3. Terms of a language are dealt over buckets of bounded size. A task holds one bucket's counts of all
   sources as a matrix, smooths them into shares in whole numbers, and adds up, pair by pair, the
   squared differences; only one sum a pair and the strongest terms of each source leave it.

Every number is a whole number, so results do not depend on the order of rows or on partitions.

Defined results: a null text, language or source is ''; a group without terms has rows like any other
(its shares come from smoothing alone); a language of one source has no pairs; a language without kept
terms has pairs of value 0 and no terms; very long texts are split piece by piece; repeated rows are
documents of their own; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, durable, prepare, utf8

#: Shares are in billionths.
SCALE = 1_000_000_000
#: A language keeps terms of at least so many of its documents.
MIN_DOCS = 3
#: Terms that are listed for each source.
TOP_TERMS = 200
#: Counts that a task holds before it sends them on.
HELD = 400_000
#: Counts (source and term) of one bucket, about; and entries of one matrix.
BUCKET, MATRIX = 300_000, 1 << 20
_PIECE = 1 << 20
_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
_TABLE = bytes(b if b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def document_terms(text: bytes | None) -> Counter:
    """Frequencies of a document's terms; a long text is split in pieces that end at a separator."""
    flat, at, found = (text or b"").translate(_TABLE), 0, Counter()
    while at < len(flat):
        cut = flat.find(b" ", at + _PIECE) if at + _PIECE < len(flat) else len(flat)
        cut = len(flat) if cut < 0 else cut
        found.update(flat[at:cut].split())
        at = cut
    return found


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every group and documents that hold
    it. Every group also has one row of the empty term, with its number of documents."""
    prepare(docs.sparkSession)

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, inside) in held.items():
            terms = list(total)
            for i in range(0, len(terms), 1 << 15):
                part = terms[i : i + (1 << 15)]
                ends = [pa.array([g] * len(part), pa.string()) for g in (lang, source)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(part, pa.binary()), pa.array([total[t] for t in part], pa.int64()), pa.array([inside[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                total, inside = held.setdefault((lang, source), (Counter(), Counter()))
                found, before = document_terms(text.as_py()), len(total)
                total.update(found)
                inside.update(found.keys())
                total[b""] += 0
                inside[b""] += 1
                entries += len(total) - before
                if entries > HELD:
                    yield from rows(held)
                    held, entries = {}, 0
        yield from rows(held)

    named = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    read = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), utf8(text_col).alias("t"))
    parts = read.mapInArrow(tally, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact at any size."""
    if count.size and int(count.max()) >= (1 << 63) // SCALE - 1:
        return (1 + SCALE * (count.astype(object) + 1) // (np.asarray(total).astype(object) + kept)).astype(np.int64)
    return 1 + SCALE * (count + 1) // (total + kept)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q) of shares."""
    return (p - q) ** 2 // q


def _bucket(terms: pa.Table, groups: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sums of all ordered pairs of a language's sources over one bucket of its terms, and the TOP_TERMS
    strongest terms of each source in it."""
    head = groups.slice(0, 1).to_pylist()[0]
    lang, kept, lang_total = head["lang"], head["kept"], head["total"]
    sources = sorted((s["source"], s["n"]) for s in head["sources"])
    names, totals = [s for s, _ in sources], np.array([n for _, n in sources], dtype=np.int64)
    number = {s: i for i, s in enumerate(names)}
    sums = np.zeros((len(names), len(names)), dtype=np.int64)
    best: list[list[tuple[int, bytes]]] = [[] for _ in names]
    step = max(1, MATRIX // max(1, len(names)))
    for at in range(0, terms.num_rows, step):
        rows = terms.slice(at, step).combine_chunks()
        cells = rows.column("cells").combine_chunks()
        flat, row = cells.flatten(), np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths()))
        count = np.zeros((len(cells), len(names)), dtype=np.int64)
        count[row, [number[s] for s in flat.field("source").to_pylist()]] = flat.field("n").to_numpy()
        p = share(count, totals, kept)
        for i in range(len(names)):
            sums[i] += distance(p[:, i : i + 1], p).sum(axis=0)
        whole = share(rows.column("n").to_numpy(), lang_total, kept)
        for i in range(len(names)):
            over = np.flatnonzero((count[:, i] > 0) & (p[:, i] > whole))
            value = distance(p[over, i], whole[over])
            if len(over) > TOP_TERMS:
                over, value = over[keep := value >= np.partition(value, len(value) - TOP_TERMS)[len(value) - TOP_TERMS]], value[keep]
            found = rows.column("term").take(pa.array(over)).to_pylist()
            best[i] = sorted([*best[i], *zip((-value).tolist(), found, strict=True)])[:TOP_TERMS]
    for i, name in enumerate(names):
        others = [j for j in range(len(names)) if j != i]
        items = [names[j].encode() for j in others] + [t for _, t in best[i]]
        values = [int(sums[i, j]) for j in others] + [-v for v, _ in best[i]]
        kinds = ["pair"] * len(others) + ["term"] * len(best[i])
        n = len(items)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(kinds, pa.string()), pa.array(items, pa.binary()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows compare a source with each other source of
    its language over all kept terms, `term` rows list what it uses more than its language does.

    The pairs are as many as the result has rows; no row of a term is ever paired with another.
    """
    with Scratch(docs.sparkSession, "divergence") as keep:
        counts = term_counts(docs, text_col, lang_col, source_col)
        listed = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
        kept = keep(listed.where((F.col("docs") >= MIN_DOCS) | (F.length("term") == 0)))
        real = F.length("term") > 0
        each = kept.select("lang", "term", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"), F.sum(real.cast("long")).alias("cells"))
        sources = each.groupBy("lang").agg(F.collect_list(F.struct("source", "n")).alias("sources"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / BUCKET)).cast("int").alias("buckets"))
        langs = keep(sources.join(kept.groupBy("lang").agg(F.sum(real.cast("long")).alias("kept"), F.sum("n").alias("total")), "lang"))
        groups = langs.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        terms = kept.where(real).join(langs.select("lang", "buckets"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "n", "cells")

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(_bucket(left, right)), schema=_OUT)

        found = terms.groupBy("lang", "bucket").cogroup(groups.groupBy("lang", "bucket")).applyInArrow(compare, "lang string, source string, part string, item binary, value long")
        summed = found.groupBy("lang", "source", "part", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        ranked = summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
        return durable(ranked)
