"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit halves. Of two fingerprints that differ in at most two
bits, either a half is equal and the other differs in at most two bits, or each half differs in one
bit. So the index holds, for each distinct fingerprint, both exact halves and the 32 one-wildcard
variants of the upper half; fingerprints that share an entry are joined and verified.

Defined results: null, empty and white-space texts have fingerprint 0 and link like any other; a
text with fewer words than a shingle is one shingle; repeated rows are rows of one class; a null id
is a row like any other and a class whose ids are all null has a null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType

from .common import Scratch, column, columns, durable, free_name, hashable, mix, ngram_hashes, prepare, shuffled, utf8, word_hashes
from .components import connected_components

#: A list of sharers longer than this is not paired but split by further wildcard variants.
PAIR_LIMIT = 64
_BLOCK = 1 << 16
_LOW = 0xFFFFFFFF


def simhash_bytes(text: bytes | None, shingle: int = 3) -> int:
    """Fingerprint as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(t) for t in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_digest
    for at in range(0, len(parts), _BLOCK):
        raw = b"".join([digest(p, 42) for p in parts[at : at + _BLOCK]])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of every whole text."""
    prepare(docs.sparkSession)

    @F.pandas_udf(LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([simhash_bytes(t, shingle) for t in s], dtype="int64")

    return docs.select(column(id_col).alias("id"), simhash(utf8(text_col)).alias("fp"))


def _hi(name: str):
    return F.shiftrightunsigned(F.col(name), 32)


def _lo(name: str):
    return F.col(name).bitwiseAND(F.lit(_LOW))


def links(fps: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (u, v) that connect all those within two bits.

    Every pair within two bits is linked directly or, on long lists, through a third fingerprint of
    the list within two bits of both.
    """
    entry = lambda tag, value, bit: F.struct((F.lit(tag << 32).bitwiseOR(value)).alias("key"), bit.alias("bit"))
    hi, lo = _hi("fp"), _lo("fp")
    none = F.lit(None).cast("int")
    entries = [entry(0, hi, none), entry(1, lo, none)]
    for j in range(32):
        bit = F.shiftrightunsigned(hi, j).bitwiseAND(F.lit(1)).cast("int")
        entries.append(entry(2 + j, hi.bitwiseAND(F.lit(_LOW & ~(1 << j))), bit))
    index = fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.key", "e.bit")
    exact = F.col("key") < F.lit(2 << 32)
    lists = index.groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.sum("bit"), F.lit(0)).alias("n1")).where("n > 1").where(exact | ((F.col("n1") > 0) & (F.col("n1") < F.col("n"))))
    shared = keep(shuffled(index).join(lists, "key").select("key", "bit", "fp", "n"))

    few = shared.where(F.col("n") <= PAIR_LIMIT)
    a, b = few.select("key", "bit", F.col("fp").alias("u")), few.select("key", F.col("bit").alias("bit2"), F.col("fp").alias("v"))
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    pairs = shuffled(a).join(b, "key").where((exact & (F.col("u") < F.col("v"))) | ((F.col("bit") == 0) & (F.col("bit2") == 1))).where(apart).select("u", "v")

    # Long lists: fix all but two bits. At most four distinct fingerprints share such an entry.
    many = shared.where(F.col("n") > PAIR_LIMIT)
    i, j = F.col("i"), F.col("j")
    two = many.where(exact).select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i")).select("key", "fp", "i", F.explode(F.sequence(i + 1, F.lit(31))).alias("j"))
    other = F.when(F.col("key") < F.lit(1 << 32), _lo("fp")).otherwise(_hi("fp"))
    masked = other.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i)").bitwiseOR(F.expr("shiftleft(1L, j)"))))
    far = two.select("key", F.concat_ws(",", "i", "j").alias("wild"), masked.alias("rest"), "fp")
    single = many.where(~exact).select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    near = single.select("key", F.col("i").cast("string").alias("wild"), _lo("fp").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i)"))).alias("rest"), "fp")
    stars = far.unionByName(near).groupBy("key", "wild", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    hub = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.unionByName(hub)


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fp, component): one row per document; component is the least id of its class."""
    with Scratch(docs.sparkSession, "simhash") as keep:
        prints = keep(fingerprints(docs, text_col, id_col, shingle))
        nodes = keep(prints.groupBy("fp").agg(F.min("id").alias("least")))
        found = connected_components(links(nodes.select("fp"), keep))
        placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
        roots = placed.groupBy("root").agg(F.min("least").alias("component"))
        return durable(prints.join(placed.join(roots, "root").select("fp", "component"), "fp").select("id", "fp", "component"))


# ---------------------------------------------------------------------------
# Similar texts whose fingerprints lie further apart.

#: Lists of similar texts: so many, each keyed by so many minima of the shingle set.
BANDS, PER_BAND = 40, 9
#: Bytes of a sketch: one of each of the first so many minima.
SKETCH = 256
#: Texts of a list that a task compares with each other at once, at most about.
BLOCK_TEXTS = 256
#: Texts of a longer list from which its typical sketch is taken.
SAMPLE = 32
_RNG = np.random.default_rng(20)
_MULTIPLY = (_RNG.integers(0, 1 << 31, BANDS * PER_BAND) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BANDS * PER_BAND).astype(np.uint32)


def sketch_bytes(text: bytes | None, shingle: int = 5) -> tuple[bytes | None, list[int]]:
    """Sketch of a text's set of word shingles and the keys of the lists it is in; none without words."""
    h, _ = word_hashes([(text or b"").lower()])
    if not len(h):
        return None, []
    g = np.unique(ngram_hashes(h, min(shingle, len(h))) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * PER_BAND, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(g), 1024):
            least = np.minimum(least, (g[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0))
        keys = least.reshape(BANDS, PER_BAND).astype(np.uint64)
        band = np.arange(BANDS, dtype=np.uint64)
        for j in range(PER_BAND):
            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + keys[:, j])
    return (least[:SKETCH] & np.uint32(0xFF)).astype(np.uint8).tobytes(), band.view(np.int64).tolist()


def _stack(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, SKETCH)


def agreement(equal_bytes: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the share of equal bytes; one byte in 256 agrees by chance."""
    return (equal_bytes - 1 / 256) / (1 - 1 / 256)


@F.pandas_udf(DoubleType())
def sketch_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    return pd.Series(agreement((_stack(a) == _stack(b)).mean(axis=1)))


@F.pandas_udf(BinaryType())
def typical_sketch(some: pd.Series) -> pd.Series:
    """The most frequent byte at each place of some sketches."""
    out = []
    for sketches in some:
        m = _stack(sketches)
        votes = (m[:, None, :] == m[None, :, :]).sum(axis=1)
        out.append(np.take_along_axis(m, votes.argmax(axis=0)[None, :], axis=0)[0].tobytes())
    return pd.Series(out, dtype=object)


def linked_rows(sketches: np.ndarray, first: np.ndarray, bar: float, within: bool) -> np.ndarray:
    """For each row of a unit the least row that a chain of agreeing rows leads to.

    `first` marks the rows of the first block; `within` compares all rows with each other, otherwise
    only rows of the first block with rows of the second.
    """
    n = len(sketches)
    agrees = np.zeros((n, n), dtype=bool)
    rows, others = (np.arange(n), np.arange(n)) if within else (np.flatnonzero(first), np.flatnonzero(~first))
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        agrees[np.ix_(part, others)] = agreement((sketches[part, None, :] == sketches[None, others, :]).mean(axis=2)) >= bar
    agrees |= agrees.T
    agrees[np.arange(n), np.arange(n)] = True
    label = np.arange(n)
    while True:
        lower = np.where(agrees, label[None, :], n).min(axis=1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


def compare_units(units: DataFrame, bar: float) -> DataFrame:
    """(key, i, j, block, node, sketch) -> edges (u, v) that connect the agreeing nodes of each unit.

    A unit (key, i, j) is one block of a list (i = j), all of whose texts are compared, or two blocks,
    whose texts are compared with those of the other. Only links leave the task, never pairs.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sketches, blocks = None, [], [], []
        u: list[int] = []
        v: list[int] = []

        def close() -> None:
            if len(nodes) > 1:
                _, i, j = unit
                label = linked_rows(_stack(sketches), np.array(blocks) == i, bar, i == j)
                for r in np.flatnonzero(label != np.arange(len(label))):
                    u.append(nodes[label[r]])
                    v.append(nodes[r])

        for b in batches:
            for key, i, j, block, node, sketch in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if (key, i, j) != unit:
                    close()
                    unit, nodes, sketches, blocks = (key, i, j), [], [], []
                nodes.append(node)
                sketches.append(sketch)
                blocks.append(block)
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u.clear()
                v.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    dealt = units.select("key", "i", "j", "block", "node", "sketch").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(walk, "u long, v long")


def deal_blocks(placed: DataFrame) -> DataFrame:
    """(key, part, node, ...) of long lists -> one row for each unit that a node is in, (key, i, j, block, ...).

    Texts of one part are connected already. A part of over BLOCK_TEXTS texts of a list gets blocks of
    its own, which are not compared with each other; the rest of the list shares blocks, which are
    compared with every block. So a list of one large part and r other texts costs r comparisons a
    text, and a list of one part is left out.
    """
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("size")).withColumn("large", F.when(F.col("size") > BLOCK_TEXTS, F.col("part")))
    groups = sizes.groupBy("key", "large").agg(F.ceil(F.sum("size") / BLOCK_TEXTS).cast("int").alias("count"), F.count("*").alias("parts"))
    order = Window.partitionBy("key").orderBy(F.col("large").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("start", F.coalesce(F.sum("count").over(order), F.lit(0)).cast("int"))
    lists = groups.groupBy("key").agg(F.sum("count").cast("int").alias("blocks"), F.sum("parts").alias("parts")).where("parts > 1").drop("parts")
    known = groups.join(lists, "key").select(F.col("key").alias("k"), F.col("large").alias("l"), "start", "count", "blocks")
    plan = sizes.join(known, (F.col("key") == F.col("k")) & F.col("large").eqNullSafe(F.col("l"))).select("key", "part", F.col("large").isNull().alias("rest"), "start", "count", "blocks")
    none = F.expr("cast(array() as array<int>)")
    before = F.when(F.col("start") > 0, F.expr("sequence(0, start - 1)")).otherwise(none)
    after = F.when(F.col("start") + F.col("count") < F.col("blocks"), F.expr("sequence(start + count, blocks - 1)")).otherwise(none)
    others = F.when(F.col("rest"), F.expr("sequence(0, blocks - 1)")).otherwise(F.concat(before, after))
    own = (F.col("start") + F.pmod(F.xxhash64("node"), F.col("count"))).cast("int")
    dealt = placed.join(plan, ["key", "part"]).withColumn("block", own).withColumn("other", F.explode(others))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "sketch")


def similar(nodes: DataFrame, known: DataFrame, similarity: float, keep: Callable[[DataFrame], DataFrame], slack: float = 0.02) -> DataFrame:
    """(node, sketch, bands) and known edges -> edges (u, v) that connect nodes whose sketches agree.

    Any two texts that share a list and whose sketches agree are linked, directly or through others. A
    list of up to BLOCK_TEXTS texts is compared within one task. In a longer one every text is first
    compared with the text nearest to the list's typical sketch; what is connected by then (here, in
    other lists or by `known` edges) is a part, and only texts of different parts are compared, block
    by block (see `deal_blocks`).

    An estimate has a standard error of about 0.025 at 0.8; `slack` is taken off the threshold so that
    few true pairs are missed.
    """
    bar = similarity - slack
    lists = nodes.select("node", F.explode("bands").alias("key"))
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sketches = nodes.select("node", "sketch")
    shared = keep(shuffled(lists).join(sizes, "key").select("key", "node", "n"))
    zero = F.lit(0)
    short = shared.where(F.col("n") <= BLOCK_TEXTS).join(sketches, "node").select("key", zero.alias("i"), zero.alias("j"), zero.alias("block"), "node", "sketch")
    found = compare_units(short, bar)
    long = shared.where(F.col("n") > BLOCK_TEXTS)
    if long.isEmpty():
        return keep(found)

    held = keep(long.join(sketches, "node"))
    draw = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = held.groupBy("key").agg(F.collect_list(F.when(draw * F.col("n") < SAMPLE, F.col("sketch"))).alias("some"), F.min("sketch").alias("least"))
    typical = some.select("key", typical_sketch(F.concat("some", F.array("least"))).alias("typical"))
    near = held.join(typical, "key").select("key", "node", sketch_similarity("sketch", "typical").alias("s"))
    leader = near.groupBy("key").agg(F.max_by("node", F.struct("s", "node")).alias("leader"))
    leader = keep(leader.join(sketches.toDF("leader", "led"), "leader"))
    near = held.join(leader, "key").where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v"), sketch_similarity("sketch", "led").alias("s"))
    first = keep(found.unionByName(near.where(F.col("s") >= bar).select("u", "v")))
    parts = connected_components(first.unionByName(known))
    placed = keep(held.join(parts, "node", "left").select("key", "node", "sketch", F.coalesce("component", "node").alias("part")))
    return keep(first.unionByName(compare_units(deal_blocks(placed), bar)))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each class of near copies stays: the least (id, content hash), null ids last.

    Near copies are linked by fingerprints within two bits, and by word shingles of an estimated
    similarity of `similarity` or more, which no small number of bits stands for (see README). All
    columns of `docs` are kept as they are, whatever their names. Of rows that are equal in every
    column one stays; texts without words are copies of one another; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    mark = free_name(docs, "content_hash")
    marked = docs.withColumn(mark, F.xxhash64(*hashable(docs)))

    @F.pandas_udf("struct<fp:bigint,sketch:binary,bands:array<bigint>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(simhash_bytes(t, shingle), *sketch_bytes(t, shingle)) for t in s]
            yield pd.DataFrame(rows, columns=["fp", "sketch", "bands"])

    with Scratch(spark, "near") as keep:
        key = F.struct(column(id_col).isNull().alias("no_id"), column(id_col).alias("id"), F.col(mark).alias("h"))
        prints = keep(marked.select(key.alias("id"), look(utf8(text_col)).alias("p")).select("id", "p.*"))
        # A node is a distinct fingerprint and sketch: the one of the least id is named by the fingerprint, others of it by a hash.
        kinds = keep(prints.groupBy("fp", "sketch", "bands").agg(F.min("id").alias("least")))
        several = kinds.groupBy("fp").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1").select("fp", "first")
        named = F.when(F.col("first").isNull() | (F.col("least") == F.col("first")), F.col("fp")).otherwise(F.xxhash64("fp", "sketch", "bands"))
        nodes = keep(kinds.join(several, "fp", "left").select("fp", named.alias("node"), "least", "sketch", "bands"))
        known = links(nodes.where("node = fp").select("fp"), keep).unionByName(nodes.where("node <> fp").select(F.col("fp").alias("u"), F.col("node").alias("v")))
        known = keep(known)
        edges = known.unionByName(similar(nodes.select("node", "sketch", "bands"), known, similarity, keep))
        found = connected_components(edges)
        placed = nodes.select("node", "least").join(found, "node", "left").select(F.coalesce("component", "node").alias("root"), "least")
        stays = keep(placed.groupBy("root").agg(F.min("least").alias("id")).select("id"))
        ids = prints.groupBy("id").agg(F.count("*").alias("n"))
        goes = ids.join(stays, "id", "left_anti").select("id", F.lit(False).alias("twice"))
        twice = ids.where("n > 1").join(stays, "id", "left_semi").select("id", F.lit(True).alias("twice"))
        told = durable(goes.unionByName(twice))

    gone, gone_h = free_name(docs, "gone_id"), free_name(docs, "gone_h")
    at = lambda rows: rows.select(F.col("id.id").alias(gone), F.col("id.h").alias(gone_h))
    same = column(id_col).eqNullSafe(column(gone)) & (column(mark) == column(gone_h))
    alone = marked.join(at(told), same, "left_anti").select(*columns(docs))
    copies = told.where("twice")
    if copies.isEmpty():
        return alone
    plain = marked.join(at(copies), same, "left_semi")
    maps = {free_name(docs, f"map_{i}"): h for i, (h, (_, kind)) in enumerate(zip(hashable(docs), docs.dtypes, strict=True)) if "map<" in kind}
    once = plain.withColumns(maps).dropDuplicates([*[c for c, kind in docs.dtypes if "map<" not in kind], *maps])
    return alone.unionByName(once.select(*columns(docs)))
