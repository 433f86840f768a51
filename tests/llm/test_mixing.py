"""Weights against the closed form, budgets against sums."""

import math
from collections import Counter

import pytest

from arbora.llm import mixing


def docs(spark):
    rows = [(i, f"s{(i % 7) * (i % 3 > 0)}", " ".join(["w"] * (1 + i % 9)), 1) for i in range(900)]
    rows += [(1000 + i, None, "a b c", 1) for i in range(5)] + [(2000, "empty", "", 1), (2001, "empty", None, 1), (2002, "s0", "  ", 1), (3, "s0", "w w w w", 1), (3, "s0", "w w w w", 1)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, mix_source int"), rows


def test_exponent(spark):
    shares = [0.6, 0.25, 0.1, 0.04, 0.01]
    df = spark.createDataFrame([(p,) for p in shares], "share double")
    a, z = mixing.find_exponent(df, 0.9, None)
    assert mixing.entropy(shares, a) >= 0.9 * math.log(5) > mixing.entropy(shares, a + 1e-5)
    assert math.isclose(z, sum(p**a for p in shares))
    assert mixing.find_exponent(df, 0.1, None)[0] == 1.0
    # a limit moves the exponent up until it holds, and no further
    for target, limit in ((0.999, 3.0), (None, 3.0), (None, 1.2)):
        a, _ = mixing.find_exponent(df, target, limit)
        assert math.isclose((0.01 / 0.6) ** (a - 1), limit, rel_tol=1e-5) and (0.01 / 0.6) ** (a - 1) <= limit * (1 + 1e-9)
        a, z = mixing.find_exponent(df, target, limit, 1.0)
        assert math.isclose(0.01 ** (a - 1) / z, limit, rel_tol=1e-5) and 0.01 ** (a - 1) / z <= limit * (1 + 1e-9)
    assert mixing.find_exponent(df, None, 100.0)[0] == mixing.find_exponent(df, None, 21.0, 1.0)[0] == 0.0
    assert mixing.find_exponent(df, None, None)[0] == 1.0 and mixing.find_exponent(df, 1.0, None)[0] < 1e-6
    assert mixing.find_exponent(df, None, 1.0)[0] == pytest.approx(1, abs=1e-6) and mixing.find_exponent(df, None, 4.0, 4.0)[0] == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.find_exponent(df, None, 4.0, 10.0)


def test_budget(spark):
    df, rows = docs(spark)
    tokens, weight = Counter(), {}
    for _, s, t, _ in rows:
        tokens[s] += len((t or "").split())
    total, times = sum(tokens.values()), Counter(r[:3] for r in rows)
    got = mixing.mix(df, 0.97, 3.0, block_docs=20, epoch_col="epoch").collect()
    used, copies = Counter(), Counter()
    for r in got:
        used[r["source"]] += len((r["text"] or "").split())
        copies[r["doc_id"], r["source"], r["text"]] += 1
    plan = {r["source"]: r for r in mixing.plan_sources(df.select("source", mixing.word_count("text").alias("tokens")), 0.97, 3.0, "same").collect()}
    assert math.isclose(sum(r["weight"] for r in plan.values()), 1.0)
    for s, n in tokens.items():
        if n:
            weight[s] = plan[s]["weight"]
            assert 0 <= used[s] - round(plan[s]["epochs"] * n, 6) < 10, s
            # equal rows share their copies
            per = [c / times[k] for k, c in ((k, copies[k]) for k in times if k[1] == s and (k[2] or "").split())]
            assert max(per) - min(per) <= 1 + 1e-9
    assert abs(sum(used.values()) - total) < 10 * len(tokens)
    assert copies[2000, "empty", ""] == copies[2001, "empty", None] == copies[2002, "s0", "  "] == 1


def test_cover_keeps_every_document(spark):
    df, rows = docs(spark)
    got = mixing.mix(df, 0.97, 4.0, "cover", block_docs=50)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == set(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def plain_mix(rows, entropy_share, max_repeat, budget, seed, block_docs, keys):
    """Copies of every row, by sorting whole sources in Python; `keys` are the rows' place keys."""
    import xxhash

    def long_hash(value, at):
        return xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), at)

    def spark_hash(value, salt):  # columns are hashed one after the other, each with the last hash as its seed
        h = xxhash.xxh64_intdigest((salt % 2**32).to_bytes(4, "little"), long_hash(value, 42))
        return h - 2**64 if h >= 2**63 else h

    tokens = [len((r[2] or "").split()) for r in rows]
    sources = {}
    for i, r in enumerate(rows):
        sources.setdefault(r[1], []).append(i)
    sums = {s: sum(tokens[i] for i in v) for s, v in sources.items()}
    total = sum(sums.values())
    shares = [n / total for n in sums.values() if n]
    goal_share = {"same": 1.0, "cover": None}.get(budget, budget if isinstance(budget, str) else budget / total)
    epochs_at = lambda a: (min(shares) / max(shares)) ** (a - 1) if goal_share is None else goal_share * min(shares) ** (a - 1) / sum(p**a for p in shares)
    low, high = 0.0, 1.0
    if entropy_share is not None and mixing.entropy(shares, 1.0) >= entropy_share * math.log(len(shares)):
        low = 1.0
    elif entropy_share is not None:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if mixing.entropy(shares, mid) >= entropy_share * math.log(len(shares)) else (low, mid)
    if epochs_at(low) > max_repeat:
        high = 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if epochs_at(mid) <= max_repeat else (mid, high)
        low = high
    z = sum(p**low for p in shares)
    weight = {s: (n / total) ** low / z for s, n in sums.items() if n}
    goal = total if budget == "same" else max(n / weight[s] for s, n in sums.items() if n) if budget == "cover" else budget
    copies, epochs = [1] * len(rows), {}
    for s, v in sources.items():
        if not sums[s]:
            continue
        epochs[s] = goal * weight[s] / sums[s]
        whole = math.floor(epochs[s] + 1e-9)
        left = (epochs[s] - whole) * sums[s]
        blocks = max(1, -(-len(v) // block_docs))
        place = lambda i, blocks=blocks: ((spark_hash(keys[i] % blocks, seed + 1) % 2**64) >> 1, keys[i] % blocks, spark_hash(keys[i], seed + 2), keys[i])
        taken = None
        for i in sorted((i for i in v if tokens[i]), key=place):
            if left > 1e-6 or place(i) == taken:
                taken = place(i)
                copies[i] = whole + 1
                left -= tokens[i]
            else:
                copies[i] = whole
    return copies, epochs


def test_against_sorted_sources(spark):
    """The copies of every row are those of a plain walk over each whole source."""
    from pyspark.sql import functions as F

    df, rows = docs(spark)
    keyed = df.select(F.xxhash64(F.lit(5), *mixing.hashable(df)).alias("k"), "*").collect()
    rows = [tuple(r)[1:] for r in keyed]
    words = sum(len((r[2] or "").split()) for r in rows)
    for budget, share, most in (("same", 0.97, 3.0), ("cover", 0.99, 4.0), ("same", None, 1.25), ("cover", None, 2.0), (10 * words, None, 12.0), (10 * words, 0.9, 10.5), (words // 2, None, 0.6)):
        want, epochs = plain_mix(rows, share, most, budget, 5, 20, [r["k"] for r in keyed])
        got = Counter(tuple(r) for r in mixing.mix(df, share, most, budget, block_docs=20).collect())
        assert got == sum((Counter({r: n}) for r, n in zip(rows, want, strict=True)), Counter()), (budget, share, most)
        assert max(epochs.values()) <= most * (1 + 1e-5) and max(epochs.values()) > 1.001 * min(epochs.values())
    with pytest.raises(ValueError):
        mixing.mix(df, None, 4.0, 10 * words)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "w w", "x", {"k": 1}), (2, None, None, "y", None)], "doc_id long, source string, text string, `mix.copies` string, Mix_Source map<string,int>")
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == 2


def test_query_mixes(spark):
    """The given tables are mixed: rare sources are repeated, common ones cut, by the weights reported."""
    from arbora.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    got = QUERIES["op6_mixing"](spark, data).collect()
    ids = Counter(r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    assert Counter(r["doc_id"] for r in got) != ids and {r["epoch"] for r in got} == {1, 2}
    assert len({r["exponent"] for r in got}) == 1 and 0 <= got[0]["exponent"] < 1
    used, words = Counter(), sum(r["n_words"] for r in got)
    for r in got:
        used[r["source"], r["weight"]] += r["n_words"]
    largest = max(r["n_words"] for r in got)
    assert all(abs(n - w * words) <= 2 * largest for (_, w), n in used.items())
