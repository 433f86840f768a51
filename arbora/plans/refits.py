"""Queries of refit schedules and histogram trees, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.lineage import durable
from arbora.operators import boosting, models, prepare, refit, score
from arbora.plans import inputs
from arbora.plans.catalogue import _STRETCHES, query, r6, s6
from arbora.plans.inputs import ORD, log_sql

_ARMS, _TREES, _DEPTH, _BINS = 5, 3, 3, 16
#: Rounds of the first phase of the doubling schedule, and the share of uniform arms in it.
_INIT, _EPS, _SEED = 500, 0.05, 9


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(prepare.shuffle_rounds(inputs.logged(inputs.orders(spark, sf_dir), _ARMS), 4))


_RD = f"WITH {ORD}, {log_sql(_ARMS)}, rd AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {noise.uniform_sql('row_id', 4)}, row_id) AS round, greatest(1, (SELECT count(*) FROM log) // 3) AS every FROM log)"


@query(f"{_STRETCHES} SELECT row_id, round, (-(max(struct_pack(s := m0 * x[1] + m1 * x[2], a := -w.arm)).a))::INT AS arm FROM rd JOIN w ON w.s = (round - 1) // every GROUP BY row_id, round UNION ALL SELECT row_id, round, NULL FROM rd WHERE round <= every")
def m3_refit_running_sums(spark, sf_dir):
    """Linear refits of every third of the log from running sums of Gram matrices."""
    log = _rounds(spark, sf_dir)
    stretch = refit.every_stretch(max(1, log.count() // 3))
    return refit.refit_linear(log, log.select("row_id", "round", "x"), stretch).select("row_id", "round", "arm")


_PHASE = f"(length(bin((round - 1) // {_INIT} + 1)) - 1)"
_PHASED = (
    f"{_RD}, ph AS MATERIALIZED (SELECT *, {_PHASE} AS s FROM rd), st AS MATERIALIZED (SELECT s, min(round) AS first FROM ph GROUP BY s), "
    "g AS (SELECT st.s, arm, 1 + sum(x[1] * x[1]) AS a, sum(x[1] * x[2]) AS b, 1 + sum(x[2] * x[2]) AS c, sum(reward * x[1]) AS f, sum(reward * x[2]) AS h FROM st JOIN rd ON round < st.first GROUP BY 1, 2), "
    "w AS MATERIALIZED (SELECT s, arm, (c * f - b * h) / (a * c - b * b) AS m0, (a * h - b * f) / (a * c - b * b) AS m1 FROM g), "
    "ch AS (SELECT row_id, (-(max(struct_pack(s := m0 * x[1] + m1 * x[2], a := -w.arm)).a))::INT AS arm FROM ph JOIN w USING (s) GROUP BY row_id)"
)
_EXPLORE = f"CASE WHEN {{arm}} IS NULL OR {noise.uniform_sql('row_id', _SEED, 4)} < {_EPS} THEN floor({noise.uniform_sql('row_id', _SEED, 5)} * {_ARMS})::INT ELSE {{arm}} END"


@query(f"{_PHASED} SELECT row_id, round, s::INT AS phase, {_EXPLORE.format(arm='ch.arm')} AS arm FROM ph LEFT JOIN ch USING (row_id)")
def m4_doubling_refits(spark, sf_dir):
    """Refits at the doubling boundaries, with a share of uniform arms; the first phase is uniform."""
    log, phase = _rounds(spark, sf_dir), models.doubling_phase("round", _INIT)
    chosen = refit.refit_linear(log, log.select("row_id", "round", "x"), phase)
    return score.select_eps_greedy(chosen, _ARMS, _SEED, _EPS).select("row_id", "round", phase.alias("phase"), "arm")


def _trees_sql(run: int, end: str, trees: int = _TREES, depth: int = _DEPTH, bins: int = _BINS, lam: int = 1, rate: float = 0.1) -> str:
    """CTEs of one model of the rounds up to `end`: cuts k<run>_<tree>_<level> and values v<run>_<tree>,
    over the limits q0 and q1 and the long table fz of binned features."""
    r, out = run, [f"o{run} AS MATERIALIZED (SELECT row_id, reward, (SELECT avg(reward) FROM rd WHERE round <= {end}) AS m FROM rd WHERE round <= {end})"]
    for t in range(trees):
        out.append(f"n{r}_{t}_0 AS MATERIALIZED (SELECT row_id, reward - m AS r, 1 AS node, true AS live FROM o{r})" if not t else f"n{r}_{t}_0 AS MATERIALIZED (SELECT row_id, r - v AS r, 1 AS node, true AS live FROM n{r}_{t - 1}_{depth} JOIN v{r}_{t - 1} USING (node))")
        for level in range(depth):
            a, k = f"n{r}_{t}_{level}", f"k{r}_{t}_{level}"
            hist = f"SELECT node, feature, bin, sum(r) AS s, count(*) AS n FROM {a} JOIN fz USING (row_id) WHERE live GROUP BY 1, 2, 3"
            left = "OVER (PARTITION BY node, feature ORDER BY bin)"
            whole = "OVER (PARTITION BY node, feature)"
            runs = f"SELECT node, feature, bin, sum(s) {left} AS sl, sum(n) {left} AS nl, sum(s) {whole} AS st, sum(n) {whole} AS nt FROM ({hist})"
            gain = f"round(sl * sl / (nl + {lam}) + (st - sl) * (st - sl) / (nt - nl + {lam}) - st * st / (nt + {lam}), 9)"
            out.append(f"{k} AS MATERIALIZED (SELECT node, best.g AS g, -best.f AS feature, -best.b AS cut FROM (SELECT node, max(struct_pack(g := {gain}, f := -feature, b := -bin)) AS best FROM ({runs}) WHERE nl < nt GROUP BY node) WHERE best.g > 0)")
            out.append(f"n{r}_{t}_{level + 1} AS MATERIALIZED (SELECT a.row_id, r, CASE WHEN k.node IS NULL THEN a.node ELSE 2 * a.node + (fz.bin > cut)::INT END AS node, k.node IS NOT NULL AS live FROM {a} a LEFT JOIN {k} k ON live AND k.node = a.node LEFT JOIN fz ON fz.row_id = a.row_id AND fz.feature = k.feature)")
        out.append(f"v{r}_{t} AS MATERIALIZED (SELECT node, {rate} * sum(r) / (count(*) + {lam}) AS v, count(*) AS n FROM n{r}_{t}_{depth} GROUP BY node)")
    return ", ".join(out)


def _bins_sql(arm: str) -> str:
    limits = [f"len(list_filter((SELECT list(t) FROM q{i}), lambda t: t < x[{i + 1}]))" for i in range(2)]
    return f"[{', '.join([*limits, *(f'({arm} = {a})::INT' for a in range(_ARMS))])}]"


_LIMITS = ", ".join(f"q{i} AS MATERIALIZED (SELECT k, v AS t FROM (SELECT x[{i + 1}] AS v, row_number() OVER (ORDER BY x[{i + 1}]) AS rn, count(*) OVER () AS n FROM rd) JOIN (SELECT unnest(range(1, {_BINS})) AS k) ON rn = (k * n + {_BINS - 1}) // {_BINS})" for i in range(2))
_FZ = f"fz AS MATERIALIZED (SELECT row_id, unnest(b) AS bin, generate_subscripts(b, 1) - 1 AS feature FROM (SELECT row_id, {_bins_sql('arm')} AS b FROM rd))"
_ALL = f"az AS MATERIALIZED (SELECT row_id, a AS arm, {_bins_sql('a')} AS b FROM rd, (SELECT unnest(range({_ARMS}))::INT AS a))"


def _predict_sql(run: int, rows: str, base: str, trees: int = _TREES, depth: int = _DEPTH) -> str:
    """CTE y<run> (row_id, arm, score) for all arms of the rows of `rows`."""
    out = [f"y{run}_0 AS MATERIALIZED (SELECT row_id, az.arm, b, ({base}) AS score FROM az JOIN ({rows}) USING (row_id))"]
    for t in range(trees):
        at = f"SELECT *, 1 AS node FROM y{run}_{t}"
        for level in range(depth):
            at = f"SELECT a.* EXCLUDE (node), CASE WHEN k.node IS NULL THEN a.node ELSE 2 * a.node + (b[k.feature + 1] > cut)::INT END AS node FROM ({at}) a LEFT JOIN k{run}_{t}_{level} k ON k.node = a.node"
        out.append(f"y{run}_{t + 1} AS MATERIALIZED (SELECT row_id, arm, b, score + coalesce(v, 0) AS score FROM ({at}) LEFT JOIN v{run}_{t} USING (node))")
    return ", ".join(out)


_BEST = "SELECT row_id, (-(max(struct_pack(s := score, a := -arm)).a))::INT AS arm FROM y{}_{} GROUP BY row_id"
_END = "(SELECT max(round) FROM rd)"
_NODES = " UNION ALL ".join(
    f"SELECT {t} AS tree, node::INT AS node, feature::INT AS feature, {s6('CASE WHEN feature = 0 THEN (SELECT t FROM q0 WHERE k = cut + 1) WHEN feature = 1 THEN (SELECT t FROM q1 WHERE k = cut + 1) ELSE 0.5 END')} AS lim, NULL::DOUBLE AS value FROM k0_{t}_{level}" for t in range(_TREES) for level in range(_DEPTH)
) + "".join(f" UNION ALL SELECT {t}, node::INT, NULL, NULL, {s6('v')} FROM v0_{t}" for t in range(_TREES))


@query(f"{_RD}, {_LIMITS}, {_FZ}, {_trees_sql(0, _END)} SELECT * FROM ({_NODES})")
def m1_fit_reward_trees(spark, sf_dir):
    """The first three trees' cuts and leaves."""
    log = _rounds(spark, sf_dir)
    found = boosting.tree_table(spark, boosting.fit(log, _ARMS, _TREES, depth=_DEPTH, bins=_BINS))
    return found.select("tree", "node", "feature", r6("limit").alias("lim"), F.when(F.col("feature").isNull(), r6("value")).alias("value"))


@query(f"{_RD}, {_LIMITS}, {_FZ}, {_ALL}, {_trees_sql(0, _END)}, {_predict_sql(0, 'SELECT row_id FROM rd', 'SELECT avg(reward) FROM rd')} {_BEST.format(0, _TREES)}")
def m2_predict_reward_trees(spark, sf_dir):
    """The arm that three trees predict most for."""
    log = _rounds(spark, sf_dir)
    scored = boosting.predict_arms(boosting.fit(log, _ARMS, _TREES, depth=_DEPTH, bins=_BINS), log.select("row_id", "x"))
    return scored.select("row_id", boosting.best_arm(F.col("scores")).alias("arm"))


def _refit_sql(ends: list[str], stretch: str) -> str:
    """All runs' trees, and every stretch decided by the run before it."""
    runs = ", ".join(f"{_trees_sql(r, e)}, {_predict_sql(r, f'SELECT row_id FROM rd WHERE {stretch} = {r + 1}', f'SELECT avg(reward) FROM rd WHERE round <= {e}')}" for r, e in enumerate(ends))
    chosen = " UNION ALL ".join(f"({_BEST.format(r, _TREES)})" for r in range(len(ends)))
    return f"{_RD}, {_LIMITS}, {_FZ}, {_ALL}, {runs}, ch AS ({chosen})"


_EVERY = "(SELECT max(every) FROM rd)"


@query(f"{_refit_sql([_EVERY, f'2 * {_EVERY}', f'3 * {_EVERY}'], '(round - 1) // every')} SELECT row_id, round, ch.arm AS arm FROM rd LEFT JOIN ch USING (row_id)")
def m3_refit_every_trees(spark, sf_dir):
    """Tree refits of every third of the log, all in the same passes."""
    log = _rounds(spark, sf_dir)
    stretch = refit.every_stretch(max(1, log.count() // 3))
    return refit.refit_trees(log, log.select("row_id", "round", "x"), stretch, _ARMS, trees=_TREES, depth=_DEPTH, bins=_BINS).select("row_id", "round", "arm")
