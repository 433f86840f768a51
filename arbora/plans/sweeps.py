"""Queries of many runs at once and of keyed synthetic tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.lineage import durable
from arbora.operators import diagnose, prepare, quantize, seeding, sweep
from arbora.plans import inputs
from arbora.plans.catalogue import _REPORT_COLUMNS, _RIDGE, _boosted_sql, _delta_sql, _vector, query, r6, s6
from arbora.plans.inputs import ARMS, EMB, ITERATIONS, LEVELS, NBITS, ORD, additive_sql, book_sql, encode_sql

_FOLDS, _K = 2, 5
_SEEDS = (3, 4, 5)


def _grid_sql(depth: int, seed: int) -> str:
    split = f"sp AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {noise.uniform_sql('row_id', seed)}, row_id) <= least(150, (SELECT count(*) FROM embeddings) // 2) AS holdout FROM al), ctx AS MATERIALIZED (SELECT row_id, x, label FROM sp WHERE holdout), ot AS (SELECT row_id, x, label FROM sp WHERE NOT holdout)"
    return f"(WITH {EMB.replace('ctx AS', 'al AS')}, {split}, {book_sql()}, {encode_sql('ot')}, {additive_sql(depth=depth)} SELECT {seed} AS seed, depth, delta, (SELECT count(*) FROM ctx) AS n_fit, n AS n_eval FROM ({_delta_sql('judged', depth)}))"


@query(f"SELECT depth, seed, {s6('delta')} AS delta, n_fit, n_eval FROM (" + " UNION ALL ".join(f"SELECT * FROM {_grid_sql(depth, seed)}" for depth in (1, 2) for seed in _SEEDS) + ")")
def d2_delta_grid(spark, sf_dir):
    """Every seed and depth in the same jobs."""
    found = sweep.delta_grid(durable(inputs.embeddings(spark, sf_dir)), (1, 2), _SEEDS, 150, ARMS, NBITS, ITERATIONS)
    return found.select("depth", "seed", r6("delta").alias("delta"), "n_fit", "n_eval")


_FOLD = f"floor({noise.uniform_sql('row_id', 17)} * {_FOLDS})"


def _fold_sql(f: int) -> str:
    """(depth, e, s, n, lin): sums of errors over one fold of models of the others."""
    split = f"ctx AS MATERIALIZED (SELECT * FROM al WHERE {_FOLD} <> {f}), ot AS MATERIALIZED (SELECT * FROM al WHERE {_FOLD} = {f})"
    head = _RIDGE.replace(f"WITH {ORD}", f"WITH {ORD.replace('ctx AS', 'al AS')}, {split}")
    looks = " ".join(f"LEFT JOIN m{i} t{i} ON t{i}.code = j.codes[{i + 1}] AND t{i}.arm = arms.arm" for i in range(LEVELS))
    sums = ", ".join(f"{' + '.join(f'{0.5**i} * coalesce(t{i}.{c}, {none})' for i in range(depth))} AS {c[0]}{depth}" for depth in (1, 2) for c, none in (("mean", 0), ("smoothed", 1 / _K)))
    error = lambda p: f"sum(abs((label = arm)::INT - least(greatest({p}, 0), 1))) / {_K}"
    linear = "lp AS (SELECT row_id, label, arm, least(greatest(w0 * x[1] + w1 * x[2] + b0, 0), 1) AS p FROM ot, w), ls AS (SELECT label, arm, p / greatest(sum(p) OVER (PARTITION BY row_id), 1e-10) AS p FROM lp)"
    rows = " UNION ALL ".join(f"SELECT {depth} AS depth, {error(f'm{depth}')} AS e, {error(f's{depth}')} AS s FROM jp" for depth in (1, 2))
    return f"({head}, {book_sql()}, {_boosted_sql(LEVELS, NBITS, _K)}, {encode_sql('ot')}, jp AS MATERIALIZED (SELECT row_id, label, arms.arm, {sums} FROM judged j CROSS JOIN arms {looks}), {linear} SELECT *, (SELECT count(*) FROM ot) AS n, (SELECT sum(abs((label = arm)::INT - p)) / {_K} FROM ls) AS lin FROM ({rows}))"


_RHO = f"(WITH {ORD}, xo AS MATERIALIZED (SELECT label, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM ctx), xg AS (SELECT i, avg(v) AS m FROM xo GROUP BY i), xk AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM xo GROUP BY 1, 2) SELECT sqrt((SELECT sum(n * (xk.m - xg.m) ** 2) FROM xk JOIN xg USING (i)) / (SELECT sum((v - m) ** 2) FROM xo JOIN xg USING (i))) AS rho)"
_FOLDED = " UNION ALL ".join(f"SELECT * FROM {_fold_sql(f)}" for f in range(_FOLDS))
_VALUES = {"rq.mae": "sum(e) / sum(n)", "smooth": "sum(s) / sum(n)", "li.mae": "sum(lin) / sum(n)"}


def _value(expression: str) -> str:
    for name, sql in _VALUES.items():
        expression = expression.replace(name, f"({sql})")
    return expression.replace("rho", "max(rho)")


@query(f"SELECT 'orders' AS dataset, sum(n)::BIGINT AS N, 2 AS d, {_K} AS C, depth, {', '.join(f'{s6(_value(v))} AS {k}' for k, v in _REPORT_COLUMNS.items())} FROM ({_FOLDED}), {_RHO} GROUP BY depth")
def d5_delta_report_folds(spark, sf_dir):
    """The report with each fold judged by models of the other one."""
    report = diagnose.delta_report("orders", durable(inputs.orders(spark, sf_dir)), (1, 2), _K, NBITS, ITERATIONS, folds=_FOLDS)
    return report.select("dataset", "N", "d", "C", "depth", *[r6(c).alias(c) for c in _REPORT_COLUMNS])


_IDS = "ids AS MATERIALIZED (SELECT o_orderkey AS row_id FROM orders)"


def _scaled_sql(columns: list[str]) -> str:
    return ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-8) AS {c}" for c in columns)


def _linear_table_sql(d: int, k: int, seed: int) -> str:
    draws = ", ".join(f"{noise.normal_sql('row_id', seed, j)} AS x{j}" for j in range(d))
    scores = ", ".join(" + ".join(f"0.3 * {noise.normal_sql(seed + 1, a, j)} * x{j}" for j in range(d)) for a in range(k))
    best = f"(list_position([{scores}], list_max([{scores}])) - 1)::INT"
    return f"WITH {_IDS}, dr AS MATERIALIZED (SELECT row_id, {draws} FROM ids), st AS MATERIALIZED (SELECT row_id, {_scaled_sql([f'x{j}' for j in range(d)])} FROM dr) SELECT row_id, {best} AS label, {', '.join(f'{s6(f"x{j}")} AS x{j}' for j in range(d))} FROM st"


@query(_linear_table_sql(3, 4, 11))
def p17_linear_contexts(spark, sf_dir):
    """Load-test points with a linear rule, one for every order."""
    points = prepare.linear_points(inputs.orders(spark, sf_dir).select("row_id"), 3, 4, 11)
    return points.select("row_id", "label", *[r6(F.get("x", F.lit(j))).alias(f"x{j}") for j in range(3)])


def _tabular_sql(d: int, k: int, seed: int, rate: float = 0.1) -> str:
    rule = prepare.TabularRule(d, k, seed)
    u = lambda what, i: noise.uniform_sql(seed, f"'{what}'", i)
    own = [f"{noise.normal_sql('row_id', seed, "'factor'", g)} * (0.5 + {u('weight', j)}) + 0.5 * {noise.normal_sql('row_id', seed, "'own'", j)} AS x{j}" for j, g in enumerate(rule.group)]
    flags = [f"({noise.uniform_sql('row_id', seed, "'flag'", j)} < 0.1 + 0.8 * {u('frequency', j)})::INT::DOUBLE AS x{rule.continuous + j}" for j in range(rule.binary)]
    names, rest = [f"x{j}" for j in range(rule.continuous)], ", ".join(f"x{j}" for j in range(rule.continuous, d))
    leaf = "0"
    for i, (f, _) in enumerate(rule.splits):
        leaf = f"(2 * {leaf} + (x{f} > {f'{u("threshold", i)} - 0.5' if f < rule.continuous else '0.5'})::INT)"
    classes = f"(SELECT list(c ORDER BY leaf) FROM (SELECT leaf, (row_number() OVER (ORDER BY {noise.uniform_sql(seed, "'leaf'", 'leaf')}) - 1) % {k} AS c FROM (SELECT unnest(range({1 << len(rule.splits)})) AS leaf)))"
    label = f"CASE WHEN {noise.uniform_sql('row_id', seed, 3)} < {rate} THEN floor({noise.uniform_sql('row_id', seed, 7)} * {k})::INT ELSE ({classes})[{leaf} + 1]::INT END"
    return f"WITH {_IDS}, dr AS MATERIALIZED (SELECT row_id, {', '.join([*own, *flags])} FROM ids), st AS MATERIALIZED (SELECT row_id, {_scaled_sql(names)}, {rest} FROM dr) SELECT row_id, {label} AS label, {', '.join(f'{s6(f"x{j}")} AS x{j}' for j in range(d))} FROM st"


@query(_tabular_sql(8, 4, 12))
def p17_tabular_contexts(spark, sf_dir):
    """Load-test points with grouped and binary features and a tree rule, one for every order."""
    points = prepare.tabular_points(inputs.orders(spark, sf_dir).select("row_id"), 8, 4, 12)
    return points.select("row_id", "label", *[r6(F.get("x", F.lit(j))).alias(f"x{j}") for j in range(8)])


_GRID = [(d, k, seed) for d in (2, 4) for k in (3, 5) for seed in (0, 1)]


def _run_sql(d: int, k: int, seed: int) -> str:
    draws = ", ".join(f"{noise.normal_sql('row_id', seed, j)} AS x{j}" for j in range(d))
    scores = ", ".join(" + ".join(f"0.3 * {noise.normal_sql(seed + 1, a, j)} * x{j}" for j in range(d)) for a in range(k))
    sums = ", ".join(f"sum(x{j} * (arm = label)::INT) / (1 + sum(x{j} * x{j})) AS w{j}" for j in range(d))
    dots = " + ".join(f"w{j} * x{j}" for j in range(d))
    return (
        f"(WITH {_IDS}, dr AS MATERIALIZED (SELECT row_id, {draws}, floor({noise.uniform_sql('row_id', seed, 5)} * {k})::INT AS arm, {noise.uniform_sql('row_id', seed, 6)} < 0.5 AS logged FROM ids), "
        f"lb AS MATERIALIZED (SELECT *, (list_position([{scores}], list_max([{scores}])) - 1)::INT AS label FROM dr), "
        f"md AS MATERIALIZED (SELECT arm, {sums} FROM lb WHERE logged GROUP BY arm), "
        f"ch AS (SELECT row_id, any_value(label) AS label, (-(max(struct_pack(s := {dots}, a := -md.arm)).a))::INT AS arm FROM lb, md WHERE NOT logged GROUP BY row_id), "
        "ev AS (SELECT 'diag' AS method, arm <> label AS miss FROM ch UNION ALL SELECT 'uniform', arm <> label FROM lb WHERE NOT logged) "
        f"SELECT {d} AS d, {k} AS K, {s6(f'count(*) / (16.0 * {k} * {d * d})')} AS ratio, method, {seed} AS seed, sum(miss::INT)::DOUBLE AS final_regret, {s6('avg(miss::INT)')} AS regret_rate FROM ev GROUP BY method)"
    )


@query(" UNION ALL ".join(f"SELECT * FROM {_run_sql(*g)}" for g in _GRID))
def t10_sufficiency_sweep(spark, sf_dir):
    """A grid of dimensions, arms and seeds as one set of jobs, over the orders' ids."""
    found = sweep.sufficiency_sweep(inputs.orders(spark, sf_dir).select("row_id"), _GRID, "diag")
    return found.select("d", "K", r6("ratio").alias("ratio"), "method", "seed", "final_regret", r6("regret_rate").alias("regret_rate"))


@query()
def q1_train_seeded(spark, sf_dir):
    """Four levels of 16 codes from oversampled seeds. Its draws on weighted candidates have no twin; tests
    hold its passes against plain ones."""
    books, _ = seeding.train(inputs.embeddings(spark, sf_dir), 4, 4)
    return quantize.codebook_table(spark, books).select("level", "code", _vector("centroid", "centroid"))
