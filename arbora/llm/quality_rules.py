"""Quality rules whose cutoffs carry a guarantee against false rejection.

Each rule compares one measure of a text with a cutoff. For every stratum (language) and rule, the
labelled good documents tell how many of them a candidate cutoff rejects; the exact binomial tail
says whether a true false-rejection rate above the rule's share of the budget is refuted. Strata
and rules are corrected for by Bonferroni, candidates need no correction of their own because
rejections can only grow as a cutoff is tightened (fixed-sequence testing). Of the certified cutoffs
the one that separates bad from good labels best is used; with none, the rule does not apply.

With probability 1 - `delta`, in every stratum at most a share `alpha` of good documents is rejected
by these rules. Copies of one text count once. All of it is DataFrame expressions.

Defined results: a null text has no words and no symbols and fails the base rule; a null stratum is
a stratum of its own; a document with several labels counts as good if one of them says so; labels
without a document, null labels and labels of null ids are not used; equal values of a measure are on
one side of a cutoff; repeated rows are judged one by one; other columns are not read, whatever
their names; very long texts are measured whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, column, durable

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Candidate cutoffs of every rule, fixed in advance.
CUTOFFS = [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5, 2.0]
#: rule -> (numerator, denominator); a measure above the cutoff rejects.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "capitals_per_word": ("n_capitals", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
}
#: Above this many strata, cutoffs are joined by a shuffle instead of a broadcast.
BROADCAST_STRATA = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_array(text: Column) -> Column:
    """Words of a text between runs of ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, WHITE))


def _grams(words: Column, size: int) -> Column:
    n = F.size(words)
    at = lambda i, j: F.element_at(words, i + j)
    hashes = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(*[at(i, j) for j in range(size)]))
    return F.when(n >= size, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))


def _covered(grams: Column, size: int) -> Column:
    """Words in windows whose hash occurs twice or more: found by sorting (hash, place)."""

    def twice(s: Column) -> Column:
        m = F.size(s)
        same = lambda x, k, d: F.coalesce(F.get(s, k + d)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, k: ((k > 0) & same(x, k, -1)) | ((k < m - 1) & same(x, k, 1)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def length(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(F.lit(size), b - a))
        return F.aggregate(gaps, F.lit(size), lambda t, g: t + g)

    ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = let(let(ranked, twice), length)
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), found).otherwise(0)


def measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang", repeat_window: int = 5) -> DataFrame:
    """(id, stratum, text_hash, counts ...): one row per document, computed within the row."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    a = docs.select(column(id_col).alias("id"), column(stratum_col).cast("string").alias("stratum"), text.alias("t"))
    b = a.withColumn("w", words_array(F.col("t")))
    c = b.select("id", "stratum", "t", "w", _grams(F.col("w"), repeat_window).alias("g"))
    lines = let(F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    d = c.select(
        "id",
        "stratum",
        F.xxhash64("t").alias("text_hash"),
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split("t", SYMBOLS)) - 1).cast("bigint").alias("n_symbols"),
        (F.size(F.split("t", "[A-Z][A-Z]")) - 1).cast("bigint").alias("n_capitals"),
        lines.alias("lines"),
        _covered(F.col("g"), repeat_window).cast("bigint").alias("n_repeat_words"),
    )
    return d.select("id", "stratum", "text_hash", "n_words", "word_chars", "n_symbols", "n_capitals", F.col("lines.n").cast("bigint").alias("n_lines"), F.col("lines.dup").cast("bigint").alias("n_dup_lines"), "n_repeat_words")


def measure(rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _critical_counts(sizes: DataFrame, rate: float, tests: Column) -> DataFrame:
    """(stratum, most): the most false rejections among n that refute a rate above `rate`.

    The largest k with P(Bin(n, rate) <= k) <= delta / tests, from the exact probabilities by their
    recurrence; k stays below n * rate, where the tail probability passes one half.
    """
    steps = sizes.select("stratum", "n", tests.alias("level"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") * rate))).alias("k"))
    log_ratio = F.when(F.col("k") == 0, F.col("n") * F.log(F.lit(1 - rate))).otherwise(F.log((F.col("n") - F.col("k") + 1) / F.col("k") * F.lit(rate / (1 - rate))))
    upto = Window.partitionBy("stratum").orderBy("k")
    probability = steps.withColumn("lp", F.sum(log_ratio).over(upto)).withColumn("tail", F.sum(F.exp("lp")).over(upto))
    return probability.where(F.col("tail") <= F.col("level")).groupBy("stratum").agg(F.max("k").alias("most"))


def cutoffs(found: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(stratum, one nullable cutoff per rule) from the measured documents and labels 1 (good) / 0."""
    marks = labels.where(column(id_col).isNotNull() & column(label_col).isin(0, 1)).groupBy(column(id_col).alias("id")).agg(F.max(column(label_col)).alias("good"))
    rows = found.where(~base_failed()).join(marks, "id").select(F.coalesce("stratum", F.lit("")).alias("stratum"), "text_hash", "good", *[measure(r).alias(r) for r in RULES])
    one = rows.groupBy("stratum", "text_hash").agg(F.max("good").alias("good"), *[F.max(r).alias(r) for r in RULES])
    tried = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])
    long = one.select("stratum", "good", F.explode(tried).alias("x")).select("stratum", "good", "x.*")
    over = lambda g, c: F.sum(F.when((F.col("good") == g) & (F.col("value") > c), 1).otherwise(0))
    counts = F.array(*[F.struct(F.lit(c).alias("cutoff"), over(1, c).alias("wrong"), over(0, c).alias("right")) for c in CUTOFFS])
    table = durable(long.groupBy("stratum", "rule").agg(F.sum("good").cast("bigint").alias("n"), F.sum(1 - F.col("good")).cast("bigint").alias("n_bad"), counts.alias("c")))
    sizes = table.groupBy("stratum").agg(F.max("n").alias("n"))
    n_tests = sizes.count() * len(RULES)
    allowed = _critical_counts(sizes.where("n > 0"), alpha / len(RULES), F.lit(delta / max(1, n_tests)))
    choice = table.join(allowed, "stratum").select("stratum", "rule", "n", "n_bad", "most", F.explode("c").alias("c")).select("stratum", "rule", "n", "n_bad", "most", "c.*").where((F.col("wrong") <= F.col("most")) & (F.col("right") * F.col("n") > F.col("wrong") * F.col("n_bad")))
    gain = F.col("right") / F.col("n_bad") - F.col("wrong") / F.col("n")
    best = choice.groupBy("stratum").agg(*[F.max_by(F.when(F.col("rule") == r, F.col("cutoff")), F.when(F.col("rule") == r, F.struct(F.round(gain, 9), F.col("cutoff")))).alias(f"cut_{r}") for r in RULES])
    return best


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """Measures of every document with base_failed and kept, the verdict of the certified rules."""
    found = durable(measures(docs, text_col, id_col, stratum_col))
    cuts = durable(cutoffs(found, labels, alpha, delta))
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    joined = found.withColumn("s", F.coalesce("stratum", F.lit(""))).join(cuts.withColumnRenamed("stratum", "s"), "s", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(measure(r) > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
