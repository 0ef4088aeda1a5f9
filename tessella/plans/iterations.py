"""SQL for fits that go round by round: each round is a table expression over the one before.

A fit's rounds, its stopping rule and its start are written out as SQL, so DuckDB takes
the same steps over the whole table and must end in the same place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tessella.operators import linear as L
from tessella.plans.models import _line, _row
from tessella.plans.registry import SQL, register, rounded

BIG = "l_extendedprice > 40000"


def rounds(rows: str, start: str, step: str, n: int, end: str) -> str:
    """``start`` gives one row of state s0; ``step`` gives the next from {s} (the state) and {k}."""
    parts = [f"r AS MATERIALIZED ({rows})", f"s0 AS MATERIALIZED ({start})"]
    parts += [f"s{k + 1} AS MATERIALIZED ({step.replace('{s}', f's{k}').replace('{k}', str(k))})" for k in range(n)]
    return f"WITH {', '.join(parts)} " + end.replace("{s}", f"s{n}")


# margin losses: accelerated subgradient steps on standardised columns
_DERIVATIVE = {
    "hinge": "CASE WHEN y * f < 1 THEN -y ELSE 0 END",
    "squared_hinge": "CASE WHEN y * f < 1 THEN -2 * y * (1 - y * f) ELSE 0 END",
    "perceptron": "CASE WHEN y * f <= 0 THEN -y ELSE 0 END",
    "epsilon_insensitive": "CASE WHEN f - y > 0 THEN 1 WHEN y - f > 0 THEN -1 ELSE 0 END",
}


def _steps(columns: Sequence[str], y: str, loss: str, alpha: float, n: int, end: str, rate: float = 0.5, tol: float = 1e-6) -> str:
    z = [f"z{i}" for i in range(1, len(columns) + 1)]
    b, p = [f"b{i}" for i in range(len(columns) + 1)], [f"p{i}" for i in range(len(columns) + 1)]
    made = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {v}" for c, v in zip(columns, z))
    rows = f"SELECT ({y})::DOUBLE AS y, {made}, {', '.join(columns)} FROM lineitem"
    start = "SELECT " + ", ".join(f"0.0::DOUBLE AS {v}" for v in [*b, *p]) + ", false AS done"
    look = ", ".join(f"{x} + {{k}} / ({{k}} + 3.0::DOUBLE) * ({x} - {q}) AS v{i}" for i, (x, q) in enumerate(zip(b, p)))
    score = " + ".join(["v0", *[f"v{i} * {v}" for i, v in enumerate(z, 1)]])
    g = ", ".join(["avg(e) AS g0", *[f"avg(e * {v}) AS g{i}" for i, v in enumerate(z, 1)]])
    pull = [f"v{i} - {rate}::DOUBLE / (1 + {{k}} / 50.0::DOUBLE) * (g{i}" + (f" + {alpha}::DOUBLE * v{i})" if i else ")") for i in range(len(b))]
    moved = "greatest(" + ", ".join(f"abs(n{i} - {x})" for i, x in enumerate(b)) + ")"
    step = f"""SELECT {", ".join(f"CASE WHEN done THEN {x} ELSE n{i} END AS {x}" for i, x in enumerate(b))}, {", ".join(f"CASE WHEN done THEN {q} ELSE {x} END AS {q}" for q, x in zip(p, b))}, done OR {moved} < {tol}::DOUBLE AS done
    FROM (SELECT l.*, {", ".join(f"{x} AS n{i}" for i, x in enumerate(pull))} FROM (SELECT *, {look} FROM {{s}}) l,
    (SELECT {g} FROM (SELECT r.*, {_DERIVATIVE[loss]} AS e FROM (SELECT r.*, {score} AS f FROM r, (SELECT {look} FROM {{s}})) r)))"""
    return rounds(rows, start, step, n, end)


_HIT = "SELECT round(avg(CASE WHEN (b0 + b1 * z1 + b2 * z2 > 0) = (y > 0) THEN 1.0::DOUBLE ELSE 0 END), 3) AS accuracy FROM r, {s}"
_TWO = ["l_quantity", "l_tax"]
_SIGN = f"CASE WHEN {BIG} THEN 1 ELSE -1 END"
SQL["sgd_hinge"] = _steps(_TWO, _SIGN, "hinge", 1e-4, 40, _HIT)
SQL["perceptron"] = _steps(_TWO, _SIGN, "perceptron", 0.0, 40, _HIT)
SQL["passive_aggressive"] = _steps(_TWO, _SIGN, "hinge", 0.0, 40, _HIT, 1.0)
SQL["linear_svc"] = _steps(_TWO, _SIGN, "squared_hinge", 1e-3, 40, _HIT)
SQL["linear_svr"] = _steps(["l_quantity"], "l_extendedprice / 1000", "epsilon_insensitive", 1e-3, 60, "SELECT round(b1 / stddev_pop(l_quantity), 2) AS slope FROM r, {s} GROUP BY b1")


# reweighted least squares with an intercept and one column
def _weighted(residual_weight: str, before: str, n: int, end: str) -> str:
    """``before`` makes what the weight needs from the residuals e."""
    start = "SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b, 0.0::DOUBLE AS scale, false AS done FROM lineitem"
    step = f"""SELECT CASE WHEN done THEN a ELSE na END AS a, CASE WHEN done THEN b ELSE nb END AS b, CASE WHEN done THEN scale ELSE own END AS scale, done OR greatest(abs(na - a), abs(nb - b)) < 1e-6 AS done FROM
    (SELECT any_value(a) AS a, any_value(b) AS b, any_value(scale) AS scale, any_value(done) AS done, any_value(own) AS own,
      (sum(w * x * y) * sum(w) - sum(w * x) * sum(w * y)) / (sum(w * x * x) * sum(w) - sum(w * x) ** 2) AS nb,
      (sum(w * y) - (sum(w * x * y) * sum(w) - sum(w * x) * sum(w * y)) / (sum(w * x * x) * sum(w) - sum(w * x) ** 2) * sum(w * x)) / sum(w) AS na
      FROM (SELECT *, {residual_weight} AS w FROM ({before})))"""
    return rounds("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem", start, step, n, end)


_SCALED = "SELECT e.*, m.own, e / m.own AS u, abs(e / m.own) AS o FROM (SELECT r.*, t.*, y - a - b * x AS e FROM r, {s} t) e, (SELECT greatest(quantile_cont(abs(e - c), 0.5) / 0.6745, 1e-12) AS own FROM (SELECT y - a - b * x AS e FROM r, {s}), (SELECT quantile_cont(y - a - b * x, 0.5) AS c FROM r, {s})) m"
_WEIGHTS = {
    "huber": "CASE WHEN o <= 1.345 THEN 1.0::DOUBLE ELSE 1.345 / o END",
    "bisquare": "CASE WHEN o <= 4.685 THEN (1 - (u / 4.685) ** 2) ** 2 ELSE 0.0::DOUBLE END",
    "andrews": "CASE WHEN o < 1e-12 THEN 1.0::DOUBLE WHEN o <= 1.339 * pi() THEN sin(u / 1.339) / (u / 1.339) ELSE 0 END",
    "hampel": "CASE WHEN o <= 2 THEN 1.0::DOUBLE WHEN o <= 4 THEN 2 / o WHEN o <= 8 THEN 2 * (8 - o) / (o * 4) ELSE 0 END",
}
for _kind, _weight in _WEIGHTS.items():
    SQL[f"robust_{_kind}"] = _weighted(_weight, _SCALED, 10, "SELECT round(b, 2) + 0.0 AS slope, round(a, 2) + 0.0 AS intercept, round(scale, 2) AS scale FROM {s}")


# Newton steps of logistic models
SQL["logistic_regression"] = rounds(
    f"SELECT l_quantity AS x, l_tax AS t, ({BIG})::INT::DOUBLE AS y FROM lineitem",
    "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c",
    """SELECT a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS a,
    b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b,
    c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS c
    FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM
    (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum(y - m) AS g0, sum((y - m) * x) AS g1, sum((y - m) * t) AS g2, sum(v) AS h00, sum(v * x) AS h01, sum(v * t) AS h02, sum(v * x * x) AS h11, sum(v * x * t) AS h12, sum(v * t * t) AS h22
    FROM (SELECT *, greatest(m * (1 - m), 1e-10) AS v FROM (SELECT r.*, s.*, 1 / (1 + exp(-(a + b * x + c * t))) AS m FROM r, {s} s))))""",
    14,
    "SELECT round(a, 4) AS intercept, round(b, 4) AS quantity, round(c, 4) AS tax FROM {s}",
)
_SCORES = "SELECT (doc_id % 17) / 4.0::DOUBLE - 2 + 2.0::DOUBLE * toxic AS s, toxic::DOUBLE AS y FROM labels"
SQL["calibrate_sigmoid"] = rounds(
    f"SELECT s, CASE WHEN y > 0.5 THEN (p + 1) / (p + 2) ELSE 1 / (n - p + 2) END AS t FROM ({_SCORES}), (SELECT sum(y) AS p, count(*) AS n FROM ({_SCORES}))",
    "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b",
    """SELECT a + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) AS a, b + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS b FROM
    (SELECT any_value(a) AS a, any_value(b) AS b, sum(t - m) AS g0, sum((t - m) * s) AS g1, sum(v) AS h00, sum(v * s) AS h01, sum(v * s * s) AS h11
    FROM (SELECT *, greatest(m * (1 - m), 1e-10) AS v FROM (SELECT r.*, q.*, 1 / (1 + exp(-(a * s + b))) AS m FROM r, {s} q)))""",
    14,
    "SELECT round(a, 4) AS a, round(b, 4) + 0.0 AS b FROM {s}",
)
SQL["calibrate_temperature"] = rounds(
    _SCORES,
    "SELECT 1.0::DOUBLE AS u",
    "SELECT u - sum(s * (1 / (1 + exp(-s * u)) - y)) / sum(s * s * greatest(exp(-s * u) / (1 + exp(-s * u)) ** 2, 1e-12)) AS u FROM r, {s} GROUP BY u",
    25,
    "SELECT round(1 / u, 4) AS t FROM {s}",
)

# Lloyd's rounds
SQL["kmeans"] = rounds(
    "SELECT l_quantity AS x, l_discount AS z FROM lineitem",
    "SELECT 5.0::DOUBLE AS x0, 0.01::DOUBLE AS z0, 25.0::DOUBLE AS x1, 0.05::DOUBLE AS z1, 45.0::DOUBLE AS x2, 0.09::DOUBLE AS z2, false AS done",
    """SELECT """
    + ", ".join(f"CASE WHEN done THEN {c}{j} ELSE n{c}{j} END AS {c}{j}" for j in range(3) for c in "xz")
    + ", done OR "
    + " + ".join(f"(n{c}{j} - {c}{j}) ** 2" for j in range(3) for c in "xz")
    + " <= 1e-4 AS done FROM (SELECT "
    + ", ".join(f"any_value({c}{j}) AS {c}{j}, coalesce(avg({c}) FILTER (k = {j}), any_value({c}{j})) AS n{c}{j}" for j in range(3) for c in "xz")
    + """, any_value(done) AS done FROM (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS k FROM (SELECT r.*, q.*, """
    + ", ".join(f"(x - x{j}) ** 2 + (z - z{j}) ** 2 AS d{j}" for j in range(3))
    + " FROM r, {s} q)))",
    30,
    "SELECT k::INT AS k, round(a, 4) AS a, round(b, 4) AS b FROM {s}, LATERAL (VALUES (0, x0, z0), (1, x1, z1), (2, x2, z2)) v(k, a, b)",
)

# greatest monotone averages: the max-min formula over distinct x
_ISOTONIC = """g AS (SELECT x, sum(y) AS s, count(*)::DOUBLE AS n FROM p GROUP BY x), c AS (SELECT x, sum(s) OVER (ORDER BY x) AS s, sum(n) OVER (ORDER BY x) AS n, s AS own, n AS m FROM g),
    a AS (SELECT i.x AS i, j.x AS j, (j.s - i.s + i.own) / (j.n - i.n + i.m) AS v FROM c i JOIN c j ON j.x >= i.x),
    f AS (SELECT x, max(low) AS y FROM (SELECT t.x, a.i, min(a.v) AS low FROM c t JOIN a ON a.i <= t.x AND a.j >= t.x GROUP BY ALL) GROUP BY x)"""
SQL["calibrate_isotonic"] = f"WITH p AS (SELECT s AS x, y FROM ({_SCORES})), {_ISOTONIC} SELECT doc_id, round(least(greatest(f.y, 0), 1), 6) AS calibrated FROM labels JOIN f ON f.x = (doc_id % 17) / 4.0::DOUBLE - 2 + 2.0::DOUBLE * toxic"


@register("isotonic_fitted", f"WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), {_ISOTONIC} SELECT x AS l_quantity, round(y, 3) AS prediction FROM f")
def isotonic_fitted(spark, d):
    df = _line(spark, d)
    m = L.IsotonicRegression().fit(df, "l_quantity", "l_extendedprice")
    return rounded(m.predict(df.select("l_quantity").distinct()), ["prediction"], 3)


SQL["isotonic_regression"] = f"""WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), {_ISOTONIC},
    e AS (SELECT x, y, lag(y) OVER (ORDER BY x) AS b, lead(y) OVER (ORDER BY x) AS n FROM f) SELECT x, round(y, 3) AS y FROM e WHERE b IS NULL OR n IS NULL OR y - b > 1e-9 OR n - y > 1e-9"""


@register(
    "elastic_net_simple",
    "SELECT round(sign(covar_pop(l_extendedprice, l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity)) - 15, 0) / (var_pop(l_quantity) + 35), 5) AS slope FROM lineitem",
)
def elastic_net_simple(spark, d):
    m = L.ElasticNet(alpha=50.0, l1_ratio=0.3).fit(_line(spark, d), ["l_quantity"], "l_extendedprice")
    return rounded(_row(spark, slope=m.coefficients[0]), ["slope"], 5)


@register(
    "multi_output",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS price, round(regr_slope(l_tax, l_quantity), 10) + 0.0 AS tax FROM lineitem",
)
def multi_output(spark, d):
    found = L.multi_output(L.LinearRegression, _line(spark, d), ["l_quantity"], ["l_extendedprice", "l_tax"])
    return rounded(rounded(_row(spark, price=found["l_extendedprice"].coefficients[0], tax=found["l_tax"].coefficients[0]), ["price"]), ["tax"], 10)


def _solved(names: Sequence[str], penalty: float, y: str, where: str = "lineitem") -> str:
    """Table expressions up to ``beta`` (b0.. and an intercept) of least squares with a ridge penalty on centred columns."""
    k = len(names)
    pairs = [f"covar_pop({a}, {b}) * count(*)" + (f" + {penalty}::DOUBLE" if i == j else "") + f" AS m{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names)]
    first = f"e0 AS (SELECT {', '.join(pairs)}, {', '.join(f'covar_pop({a}, {y}) * count(*) AS m{i}{k}' for i, a in enumerate(names))}, {', '.join(f'avg({a}) AS mean{i}' for i, a in enumerate(names))}, avg({y}) AS mean_y, count(*) AS n FROM {where})"
    parts = [first]
    rest = [*[f"mean{i}" for i in range(k)], "mean_y", "n"]
    for p in range(k):  # eliminate column p from every other row
        cells = []
        for i in range(k):
            for j in range(k + 1):
                own = f"m{p}{j} / m{p}{p}"
                cells.append((own if i == p else f"m{i}{j} - m{i}{p} * {own}") + f" AS m{i}{j}")
        parts.append(f"e{p + 1} AS (SELECT {', '.join(cells)}, {', '.join(rest)} FROM e{p})")
    parts.append(f"beta AS (SELECT {', '.join(f'm{i}{k} AS b{i}' for i in range(k))}, mean_y - " + " - ".join(f"m{i}{k} * mean{i}" for i in range(k)) + f" AS a, n FROM e{k})")
    return ", ".join(parts)


_THREE = ["l_quantity", "l_discount", "l_tax"]


@register(
    "ols_three_features",
    f"WITH {_solved(_THREE, 0.0, 'l_extendedprice')} SELECT round(a, 4) AS intercept, round(b0, 5) AS quantity, round(b1, 3) AS discount, round(b2, 3) AS tax FROM beta",
)
def ols_three_features(spark, d):
    m = L.LinearRegression().fit(_line(spark, d), _THREE, "l_extendedprice")
    df = _row(spark, intercept=m.intercept, quantity=m.coefficients[0], discount=m.coefficients[1], tax=m.coefficients[2])
    return rounded(rounded(rounded(df, ["intercept"], 4), ["quantity"], 5), ["discount", "tax"], 3)


def _ridge_scores() -> str:
    parts, scores = [], []
    for c in "ANR":
        own = _solved(_THREE, 1.0, f"(CASE WHEN l_returnflag = '{c}' THEN 1.0::DOUBLE ELSE -1 END)")
        for name in ("beta", *[f"e{i}" for i in (3, 2, 1, 0)]):
            own = own.replace(f"{name} AS (", f"{c}{name} AS (").replace(f"FROM {name})", f"FROM {c}{name})")
        parts.append(own)
        scores.append(f"{c}beta.a + {c}beta.b0 * l_quantity + {c}beta.b1 * l_discount + {c}beta.b2 * l_tax AS f{c}")
    return f"WITH {', '.join(parts)}, f AS (SELECT l_returnflag, {', '.join(scores)} FROM lineitem, Abeta, Nbeta, Rbeta) SELECT round(avg(CASE WHEN l_returnflag = CASE WHEN fA >= fN AND fA >= fR THEN 'A' WHEN fN >= fR THEN 'N' ELSE 'R' END THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM f"


SQL["ridge_classifier"] = _ridge_scores()

_BY_FOLD = "f AS (SELECT l_quantity AS x, l_extendedprice AS y, (CASE WHEN i < n % {k} * (n // {k} + 1) THEN i // (n // {k} + 1) ELSE n % {k} + (i - n % {k} * (n // {k} + 1)) // (n // {k}) END)::INT AS fold FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS i, count(*) OVER () AS n FROM lineitem))"


def fold_scores(k: int, penalties: Sequence[float]) -> str:
    """Table expressions up to ``scores`` (alpha, fold, r2) of ridge with one column; 0 is least squares."""
    values = ", ".join(f"({p}::DOUBLE)" for p in penalties)
    return f"""{_BY_FOLD.format(k=k)}, b AS (SELECT t.fold, alpha, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + alpha) AS slope, avg(x) AS mx, avg(y) AS my FROM (SELECT DISTINCT fold FROM f) t JOIN f ON f.fold <> t.fold, (VALUES {values}) v(alpha) GROUP BY t.fold, alpha),
    scores AS (SELECT alpha, f.fold, 1 - sum((y - my - slope * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f JOIN b USING (fold) GROUP BY alpha, f.fold)"""


SQL["cross_validation"] = f"WITH {fold_scores(3, [0.0])} SELECT fold, round(r2, 6) AS r2 FROM scores"
SQL["grid_search"] = f"WITH {fold_scores(2, [1.0, 1e6])} SELECT alpha, round(avg(r2), 6) AS r2 FROM scores GROUP BY alpha"

_BLENDS = "SELECT l_quantity * 1500 AS a, l_quantity * 1000 + 9000 AS b, 38000.0::DOUBLE AS c, l_extendedprice AS y FROM lineitem"
SQL["ensemble_selection"] = rounds(
    _BLENDS,
    "SELECT 0 AS na, 0 AS nb, 0 AS nc, 'inf'::DOUBLE AS best, false AS done",
    """SELECT CASE WHEN stop THEN na ELSE na + (k = 0)::INT END AS na, CASE WHEN stop THEN nb ELSE nb + (k = 1)::INT END AS nb, CASE WHEN stop THEN nc ELSE nc + (k = 2)::INT END AS nc, CASE WHEN stop THEN best ELSE e END AS best, stop AS done
    FROM (SELECT *, done OR (e >= best - 1e-12 AND na + nb + nc > 0) AS stop FROM (SELECT *, CASE WHEN ea <= eb AND ea <= ec THEN 0 WHEN eb <= ec THEN 1 ELSE 2 END AS k, least(ea, eb, ec) AS e FROM
    (SELECT na, nb, nc, best, done, avg(((na * a + nb * b + nc * c + a) / (na + nb + nc + 1) - y) ** 2) AS ea, avg(((na * a + nb * b + nc * c + b) / (na + nb + nc + 1) - y) ** 2) AS eb, avg(((na * a + nb * b + nc * c + c) / (na + nb + nc + 1) - y) ** 2) AS ec FROM r, {s} GROUP BY ALL)))""",
    5,
    "SELECT model, n / (na + nb + nc)::DOUBLE AS weight FROM {s}, LATERAL (VALUES ('a', na), ('b', nb), ('c', nc)) v(model, n) WHERE n > 0",
)


def _grown(prefix: str, source: str, depth: int, columns: Sequence[str], names: Sequence[str], score: str, least: float | str) -> tuple[list[str], str]:
    """Table expressions that grow a tree level by level over ``source``, and the last, whose ``node`` is each row's leaf.

    ``score`` is what a split should raise, over {p}<stat> of a part, the first stat being
    its rows; cuts are midpoints of a column's distinct values, ties go to the earlier
    column, then cut.
    """
    t = lambda k: f"{prefix}t{k}"
    parts = [f"{t(0)} AS MATERIALIZED (SELECT 1 AS node, * FROM ({source}))"]
    parts += [f"{prefix}c{j} AS MATERIALIZED (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM (SELECT DISTINCT {c} AS v FROM {t(0)}))" for j, c in enumerate(columns)]
    for level in range(depth):
        each = []
        for j, c in enumerate(columns):
            running = ", ".join(f"sum({s}) OVER o AS l{s}, sum({s}) OVER (PARTITION BY node) AS w{s}" for s in names)
            g = f"SELECT node, {c} AS v, {', '.join(f'sum({s}) AS {s}' for s in names)} FROM {t(level)} GROUP BY node, {c}"
            # a cut between values that a node lacks counts too, so every cut is tried
            full = f"SELECT m.node, k.v, k.w, {', '.join(f'coalesce(g.{s}, 0) AS {s}' for s in names)} FROM (SELECT DISTINCT node FROM {t(level)}) m CROSS JOIN {prefix}c{j} k LEFT JOIN ({g}) g ON g.node = m.node AND g.v = k.v"
            each.append(f"SELECT node, {j} AS feature, v, (v + w) / 2 AS cut, {', '.join(f'l{s}, w{s} - l{s} AS r{s}, w{s}' for s in names)} FROM (SELECT *, {running} FROM ({full}) WINDOW o AS (PARTITION BY node ORDER BY v)) WHERE w IS NOT NULL")
        gain = f"{score.replace('{p}', 'l')} + {score.replace('{p}', 'r')} - ({score.replace('{p}', 'w')})"
        g, f, best = (f"{prefix}{x}{level}" for x in "gfb")
        parts.append(f"{g} AS MATERIALIZED (SELECT node, feature, cut, {gain} AS gain FROM ({' UNION ALL '.join(each)}) WHERE l{names[0]} >= {least} AND r{names[0]} >= {least})")
        parts.append(f"{f} AS MATERIALIZED (SELECT node, feature, cut, gain FROM (SELECT *, row_number() OVER (PARTITION BY node, feature ORDER BY gain DESC, cut) AS k FROM {g}) WHERE k = 1 AND gain > 1e-12)")
        parts.append(f"{best} AS MATERIALIZED (SELECT node, feature, cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, feature) AS k FROM {f}) WHERE k = 1)")
        at = "CASE b.feature " + " ".join(f"WHEN {j} THEN t.{c}" for j, c in enumerate(columns)) + " END"
        parts.append(f"{t(level + 1)} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN b.node IS NULL THEN t.node * 1000 WHEN {at} <= b.cut THEN 2 * t.node ELSE 2 * t.node + 1 END AS node) FROM {t(level)} t LEFT JOIN {best} b ON b.node = t.node)")
    return parts, t(depth)


def _tree(depth: int, columns: Sequence[str], stats: dict[str, str], score: str, end: str) -> str:
    """A tree over the line items; ``end`` reads {t}, the rows with their leaf."""
    made = ", ".join(f"({x})::DOUBLE AS {s}" for s, x in stats.items())
    parts, last = _grown("", f"SELECT {', '.join(columns)}, {made} FROM lineitem", depth, columns, list(stats), score, 1)
    return f"WITH {', '.join(parts)} " + end.replace("{t}", last)


_GINI = "2 * ({p}s * {p}s / {p}n + ({p}n - {p}s) * ({p}n - {p}s) / {p}n) / 2"
SQL["decision_tree"] = _tree(4, _THREE, {"n": "1", "s": f"({BIG})::INT"}, _GINI, "SELECT round(avg(CASE WHEN (p > 0.5) = (s > 0.5) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM (SELECT s, avg(s) OVER (PARTITION BY node) AS p FROM {t})")
SQL["decision_tree_regression"] = _tree(3, _THREE, {"n": "1", "s": "l_extendedprice"}, "{p}s * {p}s / {p}n", "SELECT round(avg(s), 3) AS prediction, count(*) AS n, round(avg(s), 3) AS mean FROM {t} GROUP BY node")


def _boosted_squares(n: int, depth: int, rate: float, least: int) -> str:
    """Rounds of newton trees under squared loss: a leaf moves its rows by -rate * mean gradient."""
    parts = [f"r0 AS MATERIALIZED (SELECT {', '.join(_THREE)}, l_extendedprice AS y, avg(l_extendedprice) OVER () AS f FROM lineitem)"]
    for k in range(n):
        own, last = _grown(f"a{k}", f"SELECT {', '.join(_THREE)}, y, f, 1.0::DOUBLE AS n, f - y AS s FROM r{k}", depth, _THREE, ["n", "s"], "{p}s * {p}s / {p}n", least)
        parts += [*own, f"r{k + 1} AS MATERIALIZED (SELECT {', '.join(_THREE)}, y, f - {rate}::DOUBLE * avg(s) OVER (PARTITION BY node) AS f FROM {last})"]
    return f"WITH {', '.join(parts)} SELECT round(corr(f, y), 4) AS r FROM r{n}"


SQL["hist_boosting_regression"] = _boosted_squares(5, 3, 0.3, 20)


def _boosted_classes(n: int, depth: int, rate: float, least: int) -> str:
    """Rounds of a newton tree for each class; all trees of a round read the scores before it."""
    classes = "ANR"
    f = [f"f{i}" for i in range(3)]
    start = ", ".join(f"ln(avg((l_returnflag = '{c}')::INT) OVER ()) AS f{i}" for i, c in enumerate(classes))
    parts = [f"r0 AS MATERIALIZED (SELECT row_number() OVER () AS row, {', '.join(_THREE)}, l_returnflag AS y, {start} FROM lineitem)"]
    for k in range(n):
        mass = " + ".join(f"exp({x} - greatest({', '.join(f)}))" for x in f)
        moved = []
        for i, c in enumerate(classes):
            p = f"exp(f{i} - greatest({', '.join(f)})) / ({mass})"
            source = f"SELECT row, {', '.join(_THREE)}, 1.0::DOUBLE AS n, p - (y = '{c}')::INT AS s, greatest(p * (1 - p), 1e-6) AS h FROM (SELECT *, {p} AS p FROM r{k})"
            own, last = _grown(f"x{k}{i}", source, depth, _THREE, ["n", "s", "h"], "{p}s * {p}s / ({p}h + 1e-300)", least)
            parts += [*own, f"v{k}{i} AS MATERIALIZED (SELECT row, -sum(s) OVER (PARTITION BY node) / (sum(h) OVER (PARTITION BY node) + 1e-300) AS v{i} FROM {last})"]
            moved.append(f"f{i} + {rate}::DOUBLE * v{i} AS f{i}")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT row, {', '.join(_THREE)}, y, {', '.join(moved)} FROM r{k} JOIN v{k}0 USING (row) JOIN v{k}1 USING (row) JOIN v{k}2 USING (row))")
    return f"WITH {', '.join(parts)} SELECT prediction, count(*) AS count FROM (SELECT CASE WHEN f0 >= f1 AND f0 >= f2 THEN 'A' WHEN f1 >= f2 THEN 'N' ELSE 'R' END AS prediction FROM r{n}) GROUP BY prediction"


SQL["hist_boosting_classes"] = _boosted_classes(2, 2, 0.1, 20)

_S = "(covar_pop({0}, {1}) * count(*))"
_PAIRS = {f"s{i}{j}": _S.format(_THREE[i], _THREE[j]) for i in range(3) for j in range(i, 3)}
SQL["ols_diagnostics"] = f"""WITH {_solved(_THREE, 0.0, "l_extendedprice")}, s AS (SELECT {", ".join(f"{x} AS {k}" for k, x in _PAIRS.items())}, {", ".join(f"avg({c}) AS c{i}" for i, c in enumerate(_THREE))} FROM lineitem),
    i AS (SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) AS det FROM s),
    d AS (SELECT l_extendedprice - a - b0 * l_quantity - b1 * l_discount - b2 * l_tax AS e, l_quantity - c0 AS x, l_discount - c1 AS y, l_tax - c2 AS z, n, i.* FROM lineitem, beta, i),
    h AS (SELECT e, n, 1.0::DOUBLE / n + ((s11 * s22 - s12 * s12) * x * x + (s00 * s22 - s02 * s02) * y * y + (s00 * s11 - s01 * s01) * z * z + 2 * (s02 * s12 - s01 * s22) * x * y + 2 * (s01 * s12 - s02 * s11) * x * z + 2 * (s01 * s02 - s00 * s12) * y * z) / det AS h FROM d),
    k AS (SELECT h, n, e * e / ((SELECT sum(e * e) FROM h) / (n - 4) * (1 - h)) * h / (1 - h) / 4 AS cook FROM h)
    SELECT round(sum(h), 6) AS leverage, count(*) FILTER (cook > 4 / n) AS influential, round(max(cook), 6) AS cooks FROM k"""


def _boosted_votes(n: int) -> str:
    """SAMME with stumps: wrong rows gain weight by the stump's log odds; no better than chance gives no vote."""
    parts = [f"r0 AS MATERIALIZED (SELECT {', '.join(_THREE)}, ({BIG})::INT::DOUBLE AS y, 1.0::DOUBLE / count(*) OVER () AS w, 0.0::DOUBLE AS v FROM lineitem)"]
    for k in range(n):
        own, last = _grown(f"a{k}", f"SELECT {', '.join(_THREE)}, y, w, v, w AS n, w * y AS s FROM r{k}", 1, _THREE, ["n", "s"], _GINI, "1e-200")
        parts += [*own, f"g{k} AS MATERIALIZED (SELECT *, (sum(s) OVER (PARTITION BY node) / sum(w) OVER (PARTITION BY node) > 0.5)::INT::DOUBLE AS guess FROM {last})"]
        parts.append(f"e{k} AS MATERIALIZED (SELECT err, CASE WHEN err >= 0.5 THEN 0.0::DOUBLE ELSE ln((1 - err) / err) END AS alpha FROM (SELECT least(greatest(sum(CASE WHEN guess <> y THEN w ELSE 0 END) / sum(w), 1e-10), 1 - 1e-10) AS err FROM g{k}))")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT {', '.join(_THREE)}, y, w * CASE WHEN guess <> y THEN exp(alpha) ELSE 1 END / (1 + err * (exp(alpha) - 1)) AS w, v + alpha * (2 * guess - 1) AS v FROM g{k}, e{k})")
    return f"WITH {', '.join(parts)} SELECT round(avg(((v > 0)::INT = y)::INT::DOUBLE), 4) AS accuracy FROM r{n}"


SQL["adaboost_classifier"] = _boosted_votes(3)


def _boosted_medians(n: int, depth: int) -> str:
    """AdaBoost.R2 with linear loss: the weighted median of the trees' predictions."""
    seen: list[str] = []
    parts = [f"r0 AS MATERIALIZED (SELECT {', '.join(_THREE)}, l_extendedprice AS y, 1.0::DOUBLE / count(*) OVER () AS w FROM lineitem)"]
    for k in range(n):
        kept = "".join(f", {x}" for x in seen)
        own, last = _grown(f"a{k}", f"SELECT {', '.join(_THREE)}, y, w{kept}, w AS n, w * y AS s FROM r{k}", depth, _THREE, ["n", "s"], "{p}s * {p}s / {p}n", "1e-200")
        parts += [*own, f"g{k} AS MATERIALIZED (SELECT *, sum(s) OVER (PARTITION BY node) / sum(w) OVER (PARTITION BY node) AS p{k} FROM {last})"]
        parts.append(f"e{k} AS MATERIALIZED (SELECT top, CASE WHEN mean >= 0.5 THEN 0.0::DOUBLE ELSE ln((1 - mean) / greatest(mean, 1e-10)) END AS a{k} FROM (SELECT any_value(top) AS top, sum(w * abs(y - p{k}) / top) / sum(w) AS mean FROM g{k}, (SELECT max(abs(y - p{k})) AS top FROM g{k})))")
        seen += [f"p{k}", f"a{k}"]
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT {', '.join(_THREE)}, y, w * exp(-a{k} * (1 - abs(y - p{k}) / top)) AS w{''.join(f', {x}' for x in seen)} FROM g{k}, e{k})")
    half = " + ".join(f"a{k}" for k in range(n))
    upto = lambda i: " + ".join(f"CASE WHEN p{k} <= p{i} THEN a{k} ELSE 0 END" for k in range(n))
    median = ", ".join(f"CASE WHEN {upto(i)} >= ({half}) / 2 THEN p{i} END" for i in range(n))
    return f"WITH {', '.join(parts)} SELECT round(corr(least({median}), y), 4) AS r FROM r{n}"


SQL["adaboost_regressor"] = _boosted_medians(3, 3)
SQL["knn_imputer_small"] = """WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS a, s_nationkey::DOUBLE AS b FROM supplier),
    n AS (SELECT q.id, d.a, row_number() OVER (PARTITION BY q.id ORDER BY abs(q.b - d.b), d.id) AS r FROM s q JOIN s d ON q.id <> d.id AND q.a IS NULL AND d.a IS NOT NULL), f AS (SELECT id, avg(a) AS v FROM n WHERE r <= 3 GROUP BY id)
    SELECT id, round(coalesce(a, v, (SELECT avg(a) FROM s)), 4) AS a, round(b, 4) AS b FROM s LEFT JOIN f USING (id)"""
