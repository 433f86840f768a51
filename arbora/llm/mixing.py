"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent
is found by bisection: the largest one (closest to the natural shares) that reaches the target
entropy, or without a target the least, moved towards 1 until no source is repeated more often than
the limit. A source's weight times the budget, in
its own token number, is its number of epochs: so many whole passes over its documents, and of one
more pass as much as its budget holds. That pass goes over a keyed permutation of the source's
blocks of documents and stops inside one block, whose documents are taken in permuted order.

Where the last pass stops is found from sums, a few numbers a source: the stretch of the permutation,
the block in it, the document in that. Every document then compares its own place with these, so
texts are read where they lie and never exchanged.

Defined results: a null source is a source of its own; documents without words cost nothing and are
kept once; a source without any token keeps its documents once; an empty table gives no rows; other
columns are kept, whatever their names. Rows that are equal in every column have one place and are
taken together: a source may overshoot its budget by less than the tokens of its last such rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, columns, durable, free_name, hashable
from .quality_rules import words_array

#: Documents of a block, about.
BLOCK_DOCS = 5_000
#: Sources whose few numbers are broadcast, at most; of more, none can hold so large a share of the
#: rows that Spark's own skew handling would not split it.
BROADCAST_SOURCES = 100_000
#: Bits of a place that name its stretch of the permutation.
STRETCH_BITS = 10
#: Parts that one round of the search cuts the bracket into (five bisections at once).
PARTS = 32


def word_count(text_col: str) -> Column:
    return F.size(words_array(column(text_col).cast("string"))).cast("bigint")


def entropy(shares: list[float], exponent: float) -> float:
    """Entropy in nats of the normalised powers; the closed form that the search evaluates in Spark."""
    powers = [p**exponent for p in shares if p > 0]
    z = sum(powers)
    return -sum(w / z * math.log(w / z) for w in powers)


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: str | float = "cover", rounds: int = 5) -> tuple[float, float]:
    """(exponent, sum of powers) for a table with a column `share` of the sources' token shares.

    The exponent is the largest that reaches `target_entropy`, in parts of the greatest entropy (0 to
    1); without a target, the least. It is then moved up to the least at which no source is repeated
    more than `max_repeat` times, for a budget that is a multiple of all tokens or "cover". Without
    either it is 1. A multiple beyond `max_repeat` repeats some source too often at any exponent and is
    refused.

    Both are monotone in the exponent and found by bisection, PARTS ways at once: each round evaluates
    PARTS + 1 exponents in one aggregation over the sources, whose shares stay in Spark.
    """
    p = sources.where("share > 0").select("share")
    n, least, most = p.agg(F.count("*"), F.min("share"), F.max("share")).first()
    if not n:
        return 1.0, 1.0
    if max_repeat is not None and budget != "cover" and budget > max_repeat:
        raise ValueError(f"a budget of {budget} times all tokens repeats sources more than {max_repeat} times")

    def sums(at: list[float]) -> list[tuple[float, float]]:
        """Sum of powers and entropy at each exponent."""
        each = p.select("share", F.posexplode(F.array(*[F.lit(a) for a in at])).alias("i", "a")).withColumn("w", F.pow("share", F.col("a")))
        rows = {r["i"]: r for r in each.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("share")).alias("e")).collect()}  # one an exponent
        return [(rows[i]["z"], math.log(rows[i]["z"]) - a * rows[i]["e"] / rows[i]["z"]) for i, a in enumerate(at)]

    def edge(holds, last: bool) -> float:
        """The last exponent of 0 to 1 at which a condition holds that stops holding, or the first at
        which one holds that begins to."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            at = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
            good = [holds(a, *v) for a, v in zip(at, sums(at), strict=True)]
            i = max((i for i, g in enumerate(good) if g), default=0) if last else min((i for i, g in enumerate(good) if g), default=PARTS)
            if good[0] and good[-1]:
                return high if last else low
            low, high = (at[i], at[min(i + 1, PARTS)]) if last else (at[max(i - 1, 0)], at[i])
        return low if last else high

    exponent = 1.0 if target_entropy is None and max_repeat is None else 0.0
    if target_entropy is not None:
        exponent = edge(lambda a, z, h: h >= target_entropy * math.log(n), True) if n > 1 else 1.0
    if max_repeat is not None and least < most:
        often = (lambda a, z: (least / most) ** (a - 1)) if budget == "cover" else (lambda a, z: budget * least ** (a - 1) / z)
        exponent = max(exponent, edge(lambda a, z, h: often(a, z) <= max_repeat * (1 + 1e-12), False))
    return exponent, sums([exponent])[0][0]


def plan_sources(light: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: str | int) -> DataFrame:
    """(source, docs, tokens, share, exponent, weight, epochs) from light rows (source, tokens).

    `budget` is a number of tokens, "same" (as many as there are) or "cover" (so many that every
    source has one epoch at least).
    """
    stats = durable(light.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    total = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = stats.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent, z = find_exponent(shares, target_entropy, max_repeat, budget if budget == "cover" else 1.0 if budget == "same" else budget / max(total, 1))
    weighted = shares.withColumn("exponent", F.lit(exponent)).withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent)) / F.lit(z)).otherwise(0.0))
    if budget == "cover":
        goal = weighted.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    else:
        goal = float(total if budget == "same" else budget)
    return weighted.withColumn("epochs", F.when(F.col("tokens") > 0, F.round(F.lit(goal) * F.col("weight") / F.col("tokens"), 9)).otherwise(1.0))


def _stops(light: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(source, stop_order, stop_block, stop_rank, stop_key): where the last, partial pass of a source ends.

    `light` is (source, tokens, key), `plan` (source, part, blocks) with the tokens of the partial pass.
    A source is in no row if that pass takes nothing.
    """
    before = lambda over: F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = light.join(plan.where("part > 0"), "source").withColumn("block", F.pmod(F.col("key"), F.col("blocks")))
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.first("part").alias("part")).withColumn("order", _order("block", seed))
    stretch = F.shiftright("order", 63 - STRETCH_BITS)
    stretches = blocks.groupBy("source", stretch.alias("stretch")).agg(F.sum("t").alias("t"), F.first("part").alias("part"))
    # the last stretch, block and document of which some, but not all, that lies before is within the budget
    each = stretches.withColumn("left", F.col("part") - before(Window.partitionBy("source").orderBy("stretch"))).where("left > 0")
    last = each.groupBy("source").agg(F.max("stretch").alias("stretch"), F.min("left").alias("left"))
    inside = blocks.drop("part").withColumn("stretch", stretch).join(last, ["source", "stretch"])
    each = inside.withColumn("left", F.col("left") - before(Window.partitionBy("source").orderBy("order", "block"))).where("left > 0")
    block = each.groupBy("source").agg(F.max(F.struct("order", "block")).alias("at"), F.min("left").alias("left")).select("source", "at.order", "at.block", "left")
    rows = placed.join(block, ["source", "block"]).where("tokens > 0").groupBy("source", "key").agg(F.sum("tokens").alias("t"), F.first("order").alias("order"), F.first("block").alias("block"), F.first("left").alias("left"))
    rows = rows.withColumn("rank", F.xxhash64("key", F.lit(seed + 2)))
    each = rows.withColumn("left", F.col("left") - before(Window.partitionBy("source").orderBy("rank", "key"))).where("left > 0")
    return each.groupBy("source").agg(F.first("order").alias("stop_order"), F.first("block").alias("stop_block"), F.max(F.struct("rank", "key")).alias("at")).select("source", "stop_order", "stop_block", F.col("at.rank").alias("stop_rank"), F.col("at.key").alias("stop_key"))


def _order(block: str, seed: int) -> Column:
    """Place of a block in the permutation of its source's blocks, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col(block), F.lit(seed + 1)), 1)


def mix(docs: DataFrame, target_entropy: float | None = 0.93, max_repeat: float | None = 4.0, budget: str | int = "same", seed: int = 5, block_docs: int = BLOCK_DOCS, source_col: str = "source", text_col: str = "text", epoch_col: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """`docs` with each row as often as its source's budget takes it, numbered in `epoch_col` if given.

    `extra` names further columns: for each of tokens (words of the row), weight and exponent (of the
    plan) the name to give it.
    """
    names = ("source", "tokens", "key", "block", "rank", "copies", "epoch", "whole", "blocks", "weight", "exponent", "stop_order", "stop_block", "stop_rank", "stop_key")
    at = {n: free_name(docs, f"mix_{n}") for n in names}
    col = {n: F.col(a) for n, a in at.items()}
    marked = docs.withColumns({at["source"]: F.coalesce(F.concat(F.lit("="), column(source_col).cast("string")), F.lit("")), at["tokens"]: word_count(text_col), at["key"]: F.xxhash64(F.lit(seed), *hashable(docs))})
    with Scratch(docs.sparkSession, "mixing") as keep:
        light = keep(marked.select(*[col[n].alias(n) for n in ("source", "tokens", "key")]))
        whole = F.floor("epochs").cast("int")
        sources = plan_sources(light, target_entropy, max_repeat, budget).select("source", whole.alias("whole"), ((F.col("epochs") - whole) * F.col("tokens")).alias("part"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).alias("blocks"), "weight", "exponent")
        sources = keep(sources)
        n, cut = sources.agg(F.count("*"), F.count_if(F.col("part") > 0)).first()
        # where every source takes whole passes only, no pass stops inside a source
        stops = _stops(light, sources.select("source", "part", "blocks"), seed) if cut else docs.sparkSession.createDataFrame([], "source string, stop_order long, stop_block long, stop_rank long, stop_key long")
        plan = durable(sources.drop("part").join(stops, "source", "left"))
    plan = plan.select(*[F.col(c).alias(at[c]) for c in plan.columns])

    placed = marked.join(F.broadcast(plan) if n <= BROADCAST_SOURCES else plan, at["source"]).withColumn(at["block"], F.pmod(col["key"], col["blocks"]))
    order, rank = _order(at["block"], seed), F.xxhash64(col["key"], F.lit(seed + 2))
    earlier = (order < col["stop_order"]) | ((order == col["stop_order"]) & (col["block"] < col["stop_block"]))
    inside = (col["block"] == col["stop_block"]) & ((rank < col["stop_rank"]) | ((rank == col["stop_rank"]) & (col["key"] <= col["stop_key"])))
    copies = F.when(col["tokens"] == 0, F.lit(1)).otherwise(col["whole"] + F.coalesce(earlier | inside, F.lit(False)).cast("int"))
    more = [col[c].alias(name) for c, name in (extra or {}).items()]
    counted = placed.select(*columns(docs), *more, copies.alias(at["copies"])).where(col["copies"] > 0)
    numbered = counted.withColumn(at["epoch"], F.explode(F.sequence(F.lit(1), col["copies"])))
    return numbered.select(*columns(docs), *[column(name) for name in (extra or {}).values()], *([col["epoch"].alias(epoch_col)] if epoch_col else []))
