"""Registered queries: correlations, distributions and tests on the inventory snapshot."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from shelfcast.functions import normal
from shelfcast.operators import statistics as stats
from shelfcast.plans import base
from shelfcast.plans.base import CLEAN, HEALTH, Query, sql
from shelfcast.plans.demand import num, show

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


COLS = stats.CORRELATION_COLUMNS
COMPLETE = HEALTH + ", whole AS (SELECT * FROM health WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLS) + ")"


@register("pearson_pairs", sql(COMPLETE, " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, round(corr({a}, {b}), 6) + 0.0 AS r FROM whole" for a, b in combinations(COLS, 2))))
def _(spark, folder):
    return show(stats.pearson_pairs(base.classified(spark, folder)), "left", "right", "n", digits=6, **num("r"))


@register("pearson_p_values")
def _(spark, folder):
    return stats.pearson_p_values(stats.pearson_pairs(base.classified(spark, folder)))


@register("correlation_matrix", sql(COMPLETE, " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", " + ("max(1.0::DOUBLE)" if a == b else f"round(coalesce(corr({a}, {b}), 0), 6) + 0.0") + " AS r FROM whole" for a in COLS for b in COLS)))
def _(spark, folder):
    return show(stats.correlation_matrix(base.classified(spark, folder)), "left", "right", digits=6, **num("r"))


RANKS = COMPLETE + ", ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in COLS) + " FROM whole)"


@register("spearman_matrix", sql(RANKS, " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) + 0.0 AS rho FROM ranks" for a, b in combinations(COLS, 2))))
def _(spark, folder):
    return show(stats.spearman_matrix(base.classified(spark, folder)), "left", "right", digits=6, **num("rho"))


@register("pair_correlation", sql(COMPLETE, """, p AS (SELECT Daily_Demand_Est AS x, Current_Stock AS y FROM health WHERE Daily_Demand_Est IS NOT NULL AND Current_Stock IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT 'Daily_Demand_Est' AS x, 'Current_Stock' AS y, count(*) AS n, round(corr(r.x, r.y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r"""))
def _(spark, folder):
    return show(stats.pair_correlation(base.classified(spark, folder), "Daily_Demand_Est", "Current_Stock"), "x", "y", "n", digits=6, **num("pearson", "spearman"))


LONG = HEALTH + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, {c} AS v FROM health WHERE {c} IS NOT NULL" + (" AND DSI < 999" if c == "DSI" else "") for c in stats.SUMMARY_COLUMNS) + ")"


@register("distribution_summary", sql(LONG, """SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(skewness(v), 6) + 0.0 AS skew, round(kurtosis(v), 6) + 0.0 AS kurt,
round(count(*) / 6.0 * (power(skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 2) + power(kurtosis_pop(v), 2) / 4), 2) AS jarque_bera FROM long GROUP BY 1"""))
def _(spark, folder):
    out = stats.distribution_summary(base.classified(spark, folder))
    return out.select("metric", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), (F.round("skew", 6) + 0.0).alias("skew"),
                      (F.round("kurt", 6) + 0.0).alias("kurt"), F.round("jarque_bera", 2).alias("jarque_bera"))


@register("normality", sql(LONG, """, j AS (SELECT metric, count(*) / 6.0 * (power(skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 2) + power(kurtosis_pop(v), 2) / 4) AS jb FROM long GROUP BY 1)
SELECT metric, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS is_normal FROM j"""))
def _(spark, folder):
    return show(stats.normality(stats.distribution_summary(base.classified(spark, folder))), "metric", "is_normal", digits=6, **num("p_value"))


@register("value_histogram", sql(CLEAN, """, e AS (SELECT min(Inventory_Value) AS lo, max(Inventory_Value) AS hi, count(Inventory_Value) AS total FROM clean)
SELECT bin, count(*) AS n, round(lo + bin * ((hi - lo) / 50), 4) AS low, round(count(*) / total / ((hi - lo) / 50), 10) AS density FROM (
SELECT least(floor((Inventory_Value - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, lo, hi, total FROM clean, e WHERE Inventory_Value IS NOT NULL) GROUP BY bin, lo, hi, total"""))
def _(spark, folder):
    out = stats.histogram(base.clean(spark, folder), F.col("Inventory_Value"), 50)
    return out.select("bin", "n", F.round("low", 4).alias("low"), F.round("density", 10).alias("density"))


@register("density_curve", sql(CLEAN, """, v AS (SELECT Unit_Cost AS v FROM clean WHERE Unit_Cost IS NOT NULL),
e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * power(count(*)::DOUBLE, -0.2) AS h FROM v),
g AS (SELECT i::INTEGER AS step, lo + i * (hi - lo) / 299 AS x, n, h FROM e, range(300) r(i))
SELECT step, round(x, 4) AS x, round(sum(exp(-0.5 * (x - v) * (x - v) / (h * h))) / (n * h * sqrt(2 * pi())), 8) AS density FROM g, v GROUP BY step, x, n, h"""))
def _(spark, folder):
    out = stats.density_curve(base.clean(spark, folder), F.col("Unit_Cost"))
    return out.select("step", F.round("x", 4).alias("x"), F.round("density", 8).alias("density"))


def horner(coefficients, x):
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + ({c!r})"
    return out


def edge_sql(tail):
    q = f"sqrt(-2 * ln({tail}))"
    return f"({horner(normal.C, q)}) / (({horner(normal.D, q)}) * {q} + 1)"


QQ = f"""CASE WHEN p < {normal.SPLIT} THEN {edge_sql('p')} WHEN p > {1 - normal.SPLIT} THEN -({edge_sql('(1 - p)')})
  ELSE ({horner(normal.A, '((p - 0.5) * (p - 0.5))')}) * (p - 0.5) / (({horner(normal.B, '((p - 0.5) * (p - 0.5))')}) * ((p - 0.5) * (p - 0.5)) + 1) END"""


@register("quantile_pairs", sql(CLEAN, f""", v AS (SELECT Inventory_Value AS v, count(*) AS k FROM clean WHERE Inventory_Value IS NOT NULL GROUP BY 1),
r AS (SELECT v, k, sum(k) OVER (ORDER BY v) - (k - 1) / 2.0::DOUBLE AS rank, sum(k) OVER () AS n FROM v),
q AS (SELECT v, k, rank, CASE WHEN rank = 1 THEN 1 - power(0.5::DOUBLE, 1.0 / n) WHEN rank = n THEN power(0.5::DOUBLE, 1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM r)
SELECT round(v, 4) AS value, k AS n, rank, round({QQ}, 6) + 0.0 AS theoretical FROM q"""))
def _(spark, folder):
    out = stats.quantile_pairs(base.clean(spark, folder), F.col("Inventory_Value"))
    return out.select(F.round("value", 4).alias("value"), "n", "rank", (F.round("theoretical", 6) + 0.0).alias("theoretical"))


TEST_COLUMNS = ("Unit_Cost", "Lead_Time_Days", "Inventory_Value")


def stack(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def anova_sql(c):
    return f"""SELECT '{c}' AS metric, count(*) AS groups, sum(n)::BIGINT AS n, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 6) AS f
FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS s, (SELECT avg({c}) FROM health WHERE Vendor_Name IS NOT NULL) AS g FROM health WHERE Vendor_Name IS NOT NULL AND {c} IS NOT NULL GROUP BY Vendor_Name)"""


@register("anova_by_vendor", sql(HEALTH, " UNION ALL ".join(anova_sql(c) for c in TEST_COLUMNS)))
def _(spark, folder):
    df = base.classified(spark, folder)
    return show(stack([stats.one_way_anova(df, "Vendor_Name", c) for c in TEST_COLUMNS]), "metric", "groups", "n", digits=6, **num("f"))


def kruskal_sql(g, c):
    return f"""SELECT '{c}' AS metric, count(*) AS groups, sum(n)::BIGINT AS n,
round((12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (power(sum(n)::DOUBLE, 3) - sum(n))), 6) AS h FROM (
SELECT g, count(*) AS n, sum(rk) AS r, (SELECT sum(k * k * k - k)::DOUBLE FROM (SELECT count(*) AS k FROM health WHERE {c} IS NOT NULL AND {g} IS NOT NULL GROUP BY {c})) AS t
FROM (SELECT {g} AS g, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS rk FROM health WHERE {c} IS NOT NULL AND {g} IS NOT NULL) GROUP BY g)"""


@register("kruskal_by_vendor", sql(HEALTH, " UNION ALL ".join(kruskal_sql("Vendor_Name", c) for c in TEST_COLUMNS)))
def _(spark, folder):
    df = base.classified(spark, folder)
    return show(stack([stats.kruskal_wallis(df, "Vendor_Name", c) for c in TEST_COLUMNS]), "metric", "groups", "n", digits=6, **num("h"))


@register("vendor_test_p_values")
def _(spark, folder):
    df = base.classified(spark, folder)
    a = stats.anova_p(stats.one_way_anova(df, "Vendor_Name", "Lead_Time_Days")).select("metric", F.lit("anova").alias("test"), F.col("f").alias("statistic"), "p_value")
    k = stats.kruskal_p(stats.kruskal_wallis(df, "Category", "Lead_Time_Days")).select("metric", F.lit("kruskal").alias("test"), F.col("h").alias("statistic"), "p_value")
    return a.unionByName(k)


@register("chi_square_status", sql(CLEAN, """, o AS (SELECT Category AS a, Stock_Status AS b, count(*)::DOUBLE AS o FROM clean WHERE Category IS NOT NULL GROUP BY 1, 2),
x AS (SELECT o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM o)
SELECT round(sum(o * o * n / (ra * cb)) - max(n), 6) AS chi2, ((SELECT count(DISTINCT a) FROM o) - 1) * ((SELECT count(DISTINCT b) FROM o) - 1) AS dof FROM x"""))
def _(spark, folder):
    return show(stats.chi_square(base.clean(spark, folder), "Category", "Stock_Status"), "dof", digits=6, **num("chi2"))


# With an even number of degrees the upper tail is a finite sum.
@register("chi_square_p", sql(CLEAN, """, o AS (SELECT Category AS a, Stock_Status AS b, count(*)::DOUBLE AS o FROM clean WHERE Category IS NOT NULL GROUP BY 1, 2),
x AS (SELECT o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM o),
c AS (SELECT sum(o * o * n / (ra * cb)) - max(n) AS chi2, ((SELECT count(DISTINCT a) FROM o) - 1) * ((SELECT count(DISTINCT b) FROM o) - 1) AS dof FROM x)
SELECT round(chi2, 6) AS chi2, dof, round(exp(-chi2 / 2) * list_sum(list_transform(range(0, dof // 2), lambda k: power(chi2 / 2, k) / factorial(k::INTEGER))), 6) AS p_value FROM c"""))
def _(spark, folder):
    out = stats.chi_square_p(stats.chi_square(base.clean(spark, folder), "Category", "Stock_Status"))
    return show(out, "dof", digits=6, **num("chi2", "p_value"))


# The pairs of the regression view.
PAIRS = (("Daily_Demand_Est", "Current_Stock"), ("Lead_Time_Days", "Supply_Risk_Score"), ("Unit_Cost", "Inventory_Value"), ("Safety_Stock_Target", "Current_Stock"))


@register("ols_lines", sql(HEALTH, " UNION ALL ".join(
    f"""SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(regr_slope({y}, {x}), 6) + 0.0 AS slope, round(regr_intercept({y}, {x}), 4) AS intercept, round(regr_r2({y}, {x}), 6) AS r2,
round(sqrt((1 - regr_r2({y}, {x})) * regr_syy({y}, {x}) / regr_sxx({y}, {x}) / (count(*) - 2)), 6) AS std_err FROM health WHERE {x} IS NOT NULL AND {y} IS NOT NULL""" for x, y in PAIRS)))
def _(spark, folder):
    out = stack([stats.ols_line(base.classified(spark, folder), x, y) for x, y in PAIRS])
    return out.select("x", "y", "n", (F.round("slope", 6) + 0.0).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("std_err", 6).alias("std_err"))


# The t quantile comes from its expansion around the normal one, exact to ten digits with hundreds of rows.
Z = 1.959963984540054
T_TERMS = ((Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384)
T_SQL = f"{Z!r}::DOUBLE" + "".join(f" + {c!r}::DOUBLE / power(n - 2, {i})" for i, c in enumerate(T_TERMS, 1))


@register("ols_band", sql(HEALTH, f""", f AS (SELECT count(*) AS n, regr_slope({PAIRS[0][1]}, {PAIRS[0][0]}) AS b, regr_intercept({PAIRS[0][1]}, {PAIRS[0][0]}) AS a,
  regr_r2({PAIRS[0][1]}, {PAIRS[0][0]}) AS r2, regr_sxx({PAIRS[0][1]}, {PAIRS[0][0]}) AS sxx, regr_syy({PAIRS[0][1]}, {PAIRS[0][0]}) AS syy, avg({PAIRS[0][0]}) AS m,
  min({PAIRS[0][0]}) AS lo, max({PAIRS[0][0]}) AS hi FROM health WHERE {PAIRS[0][0]} IS NOT NULL AND {PAIRS[0][1]} IS NOT NULL),
g AS (SELECT *, lo + s * (hi - lo) / 99 AS spot, ({T_SQL}) * sqrt((1 - r2) * syy / (n - 2)) AS k, s FROM f, range(100) r(s))
SELECT s::INTEGER AS step, round(spot, 4) AS "at", round(a + b * spot, 3) AS fit, round(a + b * spot - k * sqrt(1.0 / n + power(spot - m, 2) / sxx), 3) AS lo,
  round(a + b * spot + k * sqrt(1.0 / n + power(spot - m, 2) / sxx), 3) AS hi FROM g"""))
def _(spark, folder):
    out = stats.ols_band(stats.ols_line(base.classified(spark, folder), *PAIRS[0]))
    return out.select("step", F.round("at", 4).alias("at"), *[F.round(c, 3).alias(c) for c in ("fit", "lo", "hi")])


@register("z_outliers", sql(CLEAN, """, z AS (SELECT Product_ID, (Inventory_Value - (SELECT avg(Inventory_Value) FROM clean)) / (SELECT stddev_pop(Inventory_Value) FROM clean) AS z FROM clean)
SELECT Product_ID, round(z, 6) AS z FROM z WHERE abs(z) >= 1.9"""))
def _(spark, folder):
    return show(stats.z_outliers(base.clean(spark, folder), "Inventory_Value", 1.9), "Product_ID", digits=6, **num("z"))


@register("iqr_outliers", sql(CLEAN, ", q AS (" + " UNION ALL ".join(
    f"SELECT Category, {c} AS v, quantile_cont({c}, 0.25) OVER (PARTITION BY Category) AS q1, quantile_cont({c}, 0.75) OVER (PARTITION BY Category) AS q3 FROM clean WHERE {c} IS NOT NULL" for c in stats.IQR_COLUMNS)
    + ") SELECT Category, count(*) FILTER (q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))) AS outliers FROM q GROUP BY 1"))
def _(spark, folder):
    return stats.iqr_outliers(base.clean(spark, folder))
