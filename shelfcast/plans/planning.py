"""Registered queries: drift, capacity, sensing, scenarios, data quality, run history and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast import constants as K
from shelfcast.functions.numeric import tidy
from shelfcast.operators import capacity, contracts, drift, features, history, quality, scenarios, sensing
from shelfcast.plans import base
from shelfcast.plans.base import BRAND, CLEAN, SKU, Query, sql
from shelfcast.plans.demand import FEATURES, day, num, rsql, show
from shelfcast.sources import feeds

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def stamp_sql(col):
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {col}"


# ---- drift -----------------------------------------------------------------------------------------------------

#: The middle of the shipping days.
SPLIT_DAY = """(SELECT CAST(min(l_shipdate) AS DATE) + date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE))::INTEGER // 2 FROM lineitem)"""
DRIFT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


def halves(spark, folder):
    lines = feeds.table(spark, folder, "lineitem")
    first, last = F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")
    middle = lines.agg(F.date_add(first, F.floor(F.datediff(last, first) / 2).cast("int"))).scalar()
    early = F.col("l_shipdate") < middle.cast("timestamp_ntz")
    return lines.where(early), lines.where(~early)


KS = "vals AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, {c}::DOUBLE AS value, CASE WHEN l_shipdate < {SPLIT_DAY} THEN 1 ELSE 0 END AS r FROM lineitem" for c in DRIFT_COLUMNS
) + """),
cells AS (SELECT metric, value, sum(r) AS r, sum(1 - r) AS c FROM vals GROUP BY 1, 2),
cum AS (SELECT metric, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY metric) AS nr, sum(c) OVER (PARTITION BY metric) AS nc
  FROM cells WINDOW w AS (PARTITION BY metric ORDER BY value))"""


@register("ks_statistics", sql(KS, """SELECT metric, max(nr)::BIGINT AS n_ref, max(nc)::BIGINT AS n_cur, round(max(abs(cr / nr - cc / nc)), 6) AS statistic
FROM cum GROUP BY 1"""))
def _(spark, folder):
    return show(drift.ks_statistics(*halves(spark, folder), DRIFT_COLUMNS), "metric", "n_ref", "n_cur", digits=6, **num("statistic"))


@register("data_drift")
def _(spark, folder):
    return drift.data_drift(drift.ks_statistics(*halves(spark, folder), DRIFT_COLUMNS))


VALS = f"vals AS (SELECT l_extendedprice AS v, CASE WHEN l_shipdate < {SPLIT_DAY} THEN 1 ELSE 0 END AS r FROM lineitem)"
VERDICT = "CASE WHEN psi < 0.1 THEN 'no drift' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"


@register("psi_equal_width", sql(VALS, f""",
e AS (SELECT min(v) FILTER (r = 1) AS lo, max(v) FILTER (r = 1) AS hi FROM vals),
b AS (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9) AS bin, sum(r) AS r, sum(1 - r) AS c FROM vals, e WHERE v BETWEEN lo AND hi GROUP BY 1),
f AS (SELECT coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM range(10) g(bin) LEFT JOIN b USING (bin)),
s AS (SELECT (r + 1e-6) / (sum(r) OVER () + 1e-5) AS p, (c + 1e-6) / (sum(c) OVER () + 1e-5) AS q FROM f),
x AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM s)
SELECT 'prediction_drift' AS drift_type, round(psi, 6) AS statistic, psi > 0.1 AS is_drifted, {VERDICT} AS interpretation FROM x"""))
def _(spark, folder):
    out = drift.prediction_verdict(drift.psi_equal_width(*halves(spark, folder), "l_extendedprice"))
    return show(out, "drift_type", "is_drifted", "interpretation", digits=6, **num("statistic"))


@register("psi_deciles", sql(VALS, """,
e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM vals WHERE r = 1),
b AS (SELECT len(list_filter(e, lambda x: x <= v)) AS bin, sum(r) AS r, sum(1 - r) AS c FROM vals, e GROUP BY 1),
s AS (SELECT coalesce(r, 0) / sum(r) OVER () + 1e-6 AS p, coalesce(c, 0) / sum(c) OVER () + 1e-6 AS q FROM range(10) g(bin) LEFT JOIN b USING (bin))
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s"""))
def _(spark, folder):
    return show(drift.psi_deciles(*halves(spark, folder), "l_extendedprice"), digits=6, **num("psi"))


DAILY_ERROR = FEATURES + """,
daily AS (SELECT unique_id AS model, ds, abs(y - rolling_mean_7) / y * 100 AS mape FROM feat WHERE y > 0 AND rolling_mean_7 IS NOT NULL)"""


def daily_errors(spark, folder):
    feat = features.demand_features(base.brand_demand(spark, folder)).where("y > 0 and rolling_mean_7 is not null")
    return feat.select(F.col("unique_id").alias("model"), "ds", (F.abs(F.col("y") - F.col("rolling_mean_7")) / F.col("y") * 100).alias("mape"))


@register("concept_drift", sql(DAILY_ERROR, """,
l AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ds DESC) AS rn FROM daily)
SELECT model, count(*) AS days_seen, count(*) FILTER (mape > 20) AS days_above, round(avg(mape), 4) AS statistic, count(*) FILTER (mape > 20) = 7 AS is_drifted,
  CASE WHEN count(*) FILTER (mape > 20) = 7 THEN 'AUTO_RETRAIN' ELSE 'MONITOR' END AS action FROM l WHERE rn <= 7 GROUP BY 1"""))
def _(spark, folder):
    return show(drift.concept_drift(daily_errors(spark, folder)), "model", "days_seen", "days_above", "is_drifted", "action", **num("statistic"))


@register("breach_streaks", sql(DAILY_ERROR, """,
w AS (SELECT *, min(mape) OVER s AS lo, count(*) OVER s AS n FROM daily WINDOW s AS (PARTITION BY model ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT model, strftime(ds, '%Y-%m-%d') AS ds, round(mape, 4) AS mape FROM w WHERE lo > 20 AND n = 7"""))
def _(spark, folder):
    return show(drift.breach_streaks(daily_errors(spark, folder)), "model", day(), **num("mape"))


@register("monitoring_summary", sql(DAILY_ERROR, """SELECT model, count(*) AS history_length, round(arg_max(mape, ds), 4) AS latest_mape, 0.05::DOUBLE AS ks_threshold, 0.1::DOUBLE AS psi_threshold,
20.0::DOUBLE AS mape_threshold, 7 AS retrain_trigger_days FROM daily GROUP BY 1"""))
def _(spark, folder):
    out = drift.monitoring_summary(daily_errors(spark, folder))
    return show(out, "model", "history_length", "ks_threshold", "psi_threshold", "mape_threshold", "retrain_trigger_days", **num("latest_mape"))


def yearly(spark, folder):
    """The newest year of demand and the year before it, matched by series and day of the year counted backwards."""
    y = base.brand_demand(spark, folder)
    back = F.datediff(y.agg(F.max("ds")).scalar(), F.col("ds"))
    key = F.concat_ws("|", "unique_id", (back % 365).cast("string"))
    return (y.where(F.floor(back / 365) == n).select(key.alias("k"), "y") for n in (1, 0))


@register("aligned_error", sql(BRAND, """,
o AS (SELECT unique_id, y, (SELECT max(ds) FROM y) - ds AS back FROM y),
a AS (SELECT unique_id || '|' || (back % 365) AS k, y AS r FROM o WHERE back // 365 = 1), b AS (SELECT unique_id || '|' || (back % 365) AS k, y AS c FROM o WHERE back // 365 = 0)
SELECT count(*) AS n, round(avg(abs((r - c) / CASE WHEN r = 0 THEN 1 ELSE r END)) * 100, 4) AS mape_pct FROM a JOIN b USING (k)"""))
def _(spark, folder):
    return show(drift.aligned_error(*yearly(spark, folder), "k", "y"), "n", **num("mape_pct"))


@register("combined_drift")
def _(spark, folder):
    return drift.combined_verdict(*yearly(spark, folder), "k", "y")


@register("retrain_decision", sql(DAILY_ERROR, """,
l AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ds DESC) AS rn FROM daily),
c AS (SELECT model, count(*) FILTER (mape > 20) = 7 AS d FROM l WHERE rn <= 7 GROUP BY 1)
SELECT count(*) AS checks, count(*) FILTER (d) AS drifted, bool_or(d) AS retrain FROM c"""))
def _(spark, folder):
    return drift.retrain_decision(drift.concept_drift(daily_errors(spark, folder)))


# ---- capacity --------------------------------------------------------------------------------------------------

WEEKLY = """
dd AS (SELECT CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS demand FROM lineitem GROUP BY 1),
used AS (SELECT 'W' || (floor((ds - (SELECT min(ds) FROM dd)) / 7) + 1)::BIGINT AS period, sum(demand) AS demand, 4200.0::DOUBLE AS capacity FROM dd GROUP BY 1)"""


def weekly(spark, folder):
    lines = feeds.table(spark, folder, "lineitem")
    per_day = lines.groupBy(feeds.ship_day(F.col("l_shipdate")).alias("ds")).agg(F.sum("l_quantity").alias("demand"))
    return capacity.weekly_buckets(per_day)


def used(spark, folder):
    return capacity.utilization(weekly(spark, folder), capacity.daily_capacity(capacity.default_profiles(spark, 1, 0.6)))


@register("capacity_profiles", """SELECT 'LINE-' || lpad((i + 1)::VARCHAR, 2, '0') AS line_id, 'group_' || chr(65 + i::INTEGER) AS product_group,
1000.0::DOUBLE * (1 + i * 0.2::DOUBLE) AS max_throughput_per_day, 2.0::DOUBLE AS changeover_time_hours, 0.85::DOUBLE AS efficiency_factor,
round(sum(l_quantity) / (count(DISTINCT CAST(l_shipdate AS DATE)) * 1000 * (1 + i * 0.2) * 0.85), 4) AS load FROM lineitem, range(3) r(i) GROUP BY i""")
def _(spark, folder):
    daily = feeds.table(spark, folder, "lineitem").agg(F.sum("l_quantity") / F.countDistinct(F.to_date("l_shipdate"))).scalar()
    out = capacity.default_profiles(spark)
    return out.withColumn("load", F.round(daily / (F.col("max_throughput_per_day") * F.col("efficiency_factor")), 4))


@register("capacity_utilization", sql(WEEKLY, """SELECT period, demand, capacity, round(least(demand / capacity, 2), 6) AS utilization,
CASE WHEN demand / capacity > 1 THEN 'over capacity' WHEN demand / capacity > 0.85 THEN 'above target' ELSE 'ok' END AS state FROM used"""))
def _(spark, folder):
    return show(used(spark, folder), "period", "demand", "capacity", "state", digits=6, **num("utilization"))


@register("capacity_feasibility", sql(WEEKLY, """SELECT count(*) FILTER (demand > capacity) = 0 AS feasible, round(avg(least(demand / capacity, 2)), 6) AS avg_utilization,
round(max(least(demand / capacity, 2)), 6) AS max_utilization, count(*) FILTER (demand > capacity) AS bottleneck_count, round(least(1, sum(capacity) / sum(demand)), 6) AS demand_coverage FROM used"""))
def _(spark, folder):
    return show(capacity.feasibility(used(spark, folder)), "feasible", "bottleneck_count", digits=6, **num("avg_utilization", "max_utilization", "demand_coverage"))


@register("capacity_adjustments", sql(WEEKLY, """SELECT period, demand - capacity AS deficit, CASE WHEN demand - capacity <= 3500 THEN 'overtime' ELSE 'outsource' END AS action,
CASE WHEN demand - capacity <= 3500 THEN 3500.0 ELSE demand - capacity END::DOUBLE AS additional_capacity,
CASE WHEN demand - capacity <= 3500 THEN 4200.0 ELSE (demand - capacity) * 2 END::DOUBLE AS estimated_cost FROM used WHERE demand > capacity"""))
def _(spark, folder):
    return capacity.adjustments(capacity.bottlenecks(used(spark, folder)), lines=1)


@register("snapshot_weekly_demand", sql(CLEAN, "SELECT 'W' || i AS period, round(sum(Daily_Demand_Est) * 7, 4) AS demand FROM clean, range(1, 5) r(i) GROUP BY i"))
def _(spark, folder):
    return show(capacity.snapshot_demand(base.clean(spark, folder)), "period", **num("demand"))


# ---- sensing ---------------------------------------------------------------------------------------------------

SIGNALS = """
signals AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'pos' WHEN 'click' THEN 'social' WHEN 'view' THEN 'weather' ELSE event_type END AS source,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(ts AS DATE) - (SELECT CAST(min(ts) AS DATE) FROM events) END AS day_no,
  'SKU-' || lpad(user_id::VARCHAR, 6, '0') AS product_id, value AS signal_value, 0.6::DOUBLE + (event_id % 41) / 100.0::DOUBLE AS confidence FROM events),
weighted AS (SELECT *, CASE source WHEN 'pos' THEN 0.6::DOUBLE WHEN 'social' THEN 0.25::DOUBLE WHEN 'weather' THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END
  * confidence * 0.5::DOUBLE * power(0.5::DOUBLE, greatest(0, 13 - day_no) / 7.0::DOUBLE) AS w FROM signals),
per_product AS (SELECT product_id, count(*) AS signals, sum(w * signal_value) / sum(w) AS signal FROM weighted GROUP BY 1)"""
BASE_FORECAST = """,
bf AS (SELECT product_id, 1 AS period, (SELECT avg(Daily_Demand_Est) FROM clean) AS forecast FROM (
  SELECT product_id FROM per_product UNION ALL SELECT 'SKU-none')),
adj AS (SELECT bf.*, coalesce(forecast * 0.7 + signal * 0.3, forecast) AS adjusted_forecast,
  CASE WHEN signal IS NOT NULL AND forecast > 0 THEN (forecast * 0.7 + signal * 0.3 - forecast) / forecast * 100 ELSE 0 END AS adjustment_pct FROM bf LEFT JOIN per_product USING (product_id))"""
SPIKES = """,
st AS (SELECT product_id, avg(signal_value) AS m, stddev_samp(signal_value) AS sd FROM signals GROUP BY 1 HAVING count(*) >= 2),
spk AS (SELECT s.*, (signal_value - m) / sd AS sigma FROM signals s JOIN st USING (product_id) WHERE sd > 0 AND (signal_value - m) / sd > 2.5)"""


@register("signal_weights", sql(SIGNALS, "SELECT event_id, source, product_id, round(w, 8) AS weight FROM weighted"))
def _(spark, folder):
    return feeds.demand_signals(spark, folder).select("event_id", "source", "product_id", F.round(sensing.signal_weight(), 8).alias("weight"))


@register("product_signals", sql(SIGNALS, "SELECT product_id, signals, round(signal, 4) AS signal FROM per_product"))
def _(spark, folder):
    return show(sensing.product_signal(feeds.demand_signals(spark, folder)), "product_id", "signals", **num("signal"))


def sensed(spark, folder):
    signals = feeds.demand_signals(spark, folder)
    products = signals.select("product_id").distinct().unionByName(spark.range(1).select(F.lit("SKU-none").alias("product_id")))
    return signals, sensing.adjust_forecast(sensing.base_forecast(base.clean(spark, folder), products), signals)


@register("forecast_adjustments", sql(CLEAN + "," + SIGNALS + BASE_FORECAST, f"SELECT product_id, period, {rsql('forecast', 'adjusted_forecast', 'adjustment_pct')} FROM adj"))
def _(spark, folder):
    return show(sensed(spark, folder)[1], "product_id", "period", **num("forecast", "adjusted_forecast", "adjustment_pct"))


@register("demand_spikes", sql(SIGNALS + SPIKES, "SELECT event_id, product_id, source, round(signal_value, 4) AS magnitude, round(sigma, 4) AS sigma FROM spk"))
def _(spark, folder):
    out = sensing.spikes(feeds.demand_signals(spark, folder))
    return show(out, "event_id", "product_id", "source", magnitude="signal_value", sigma="sigma")


@register("sensing_kpis", sql(CLEAN + "," + SIGNALS + BASE_FORECAST + SPIKES, """SELECT (SELECT count(*) FROM signals) AS active_signals, (SELECT count(*) FROM spk) AS spike_count,
round(avg(abs(adjustment_pct)), 4) AS avg_adjustment_pct, count(*) AS products_sensed FROM adj"""))
def _(spark, folder):
    signals, adjusted = sensed(spark, folder)
    out = sensing.sensing_kpis(signals, sensing.spikes(signals), adjusted)
    return show(out, "active_signals", "spike_count", "products_sensed", **num("avg_adjustment_pct"))


@register("signal_timeline", sql(SIGNALS, """SELECT event_id, source, row_number() OVER (PARTITION BY source ORDER BY event_id) AS position, signal_value FROM (
SELECT * FROM signals WHERE source IN ('pos', 'social', 'weather') ORDER BY event_id LIMIT 100)"""))
def _(spark, folder):
    return sensing.signal_timeline(feeds.demand_signals(spark, folder), ["pos", "social", "weather"]).select("event_id", "source", "position", "signal_value")


# ---- scenarios -------------------------------------------------------------------------------------------------

DAILY_CAP = 130.0


def warehouse_weeks(spark, folder):
    per_day = base.sku_facts(spark, folder).groupBy("warehouse", "ds").agg(F.sum("y").alias("demand"))
    weeks = capacity.weekly_buckets(per_day).groupBy("warehouse", "period").agg(F.sum("demand").alias("demand"))
    weeks = weeks.withColumn("period", F.expr("cast(substr(period, 2) as int)"))
    # Weeks without sales have zero demand; supply arrives in them all the same.
    last = weeks.agg(F.max("period")).scalar()
    grid = weeks.select("warehouse").distinct().select("warehouse", F.explode(F.sequence(F.lit(1), last)).alias("period"))
    return grid.join(weeks, ["warehouse", "period"], "left").fillna(0.0, ["demand"])


BALANCED = ["warehouse", "horizon"]


def simulated(spark, folder, mode):
    weeks = scenarios.horizons(warehouse_weeks(spark, folder), ["warehouse"])
    return scenarios.simulate(weeks, F.lit(DAILY_CAP), scenarios.default_scenarios(spark), BALANCED, mode)


def sop_sql(factor):
    return SKU + f""",
first AS (SELECT min(ds) AS d FROM facts),
wk0 AS (SELECT warehouse, (floor((ds - d) / 7) + 1)::INTEGER AS period, sum(y) AS demand FROM facts, first GROUP BY 1, 2),
wk AS (SELECT w.warehouse, p.period, coalesce(wk0.demand, 0) AS demand FROM (SELECT DISTINCT warehouse FROM facts) w
  CROSS JOIN (SELECT unnest(range(1, (SELECT max(period) + 1 FROM wk0)))::INTEGER AS period) p LEFT JOIN wk0 ON wk0.warehouse = w.warehouse AND wk0.period = p.period),
hz AS (SELECT warehouse, (period - 1) // 12 AS horizon, (period - 1) % 12 + 1 AS period, demand FROM wk),
full12 AS (SELECT h.warehouse, h.horizon, t.p::INTEGER AS period, h.demand FROM (SELECT *, max(period) OVER (PARTITION BY warehouse, horizon) AS n FROM hz) h
  JOIN range(1, 13) t(p) ON (t.p - 1) % h.n + 1 = h.period),
sc AS (SELECT * FROM (VALUES ('baseline', 1.0::DOUBLE, 1.0::DOUBLE, 0.95::DOUBLE), ('optimistic', 1.2, 1.1, 0.98), ('conservative', 0.85, 0.95, 0.90)) v(scenario, dm, cm, rel)),
inp AS (SELECT scenario, warehouse, horizon, period, demand * dm AS demand, {DAILY_CAP} * 7 * cm AS capacity, {DAILY_CAP} * 7 * cm * ({factor}) AS supply FROM full12, sc),
steps(scenario, warehouse, horizon, period, demand, capacity, fulfilled, inventory) AS (
  SELECT scenario, warehouse, horizon, 0, 0.0::DOUBLE, capacity, 0.0::DOUBLE, capacity * 0.3 FROM inp WHERE period = 1
  UNION ALL SELECT i.scenario, i.warehouse, i.horizon, i.period, i.demand, i.capacity, least(i.demand, s.inventory + i.supply), s.inventory + i.supply - least(i.demand, s.inventory + i.supply)
  FROM steps s JOIN inp i ON i.scenario = s.scenario AND i.warehouse = s.warehouse AND i.horizon = s.horizon AND i.period = s.period + 1),
det AS (SELECT *, round(least(demand / capacity, 2), 3) AS utilization, demand - fulfilled > 1e-9 AS stockout,
  inventory * 0.25 * (7 / 365.0::DOUBLE) + (demand - fulfilled) * 50 AS cost FROM steps WHERE period > 0),
kpi AS (SELECT scenario, warehouse, horizon, sum(fulfilled) / sum(demand) AS fill_rate, avg(utilization) AS avg_utilization, sum(cost) AS inventory_cost,
  count(*) FILTER (stockout) AS stockout_events, count(*) AS periods FROM det GROUP BY 1, 2, 3)"""


def recursive(factor, body):
    return "WITH RECURSIVE " + sop_sql(factor).strip() + "\n" + body


EXPECTED = "rel + (1 - rel) * 0.7"


@register("scenario_periods", recursive("1", "SELECT scenario, warehouse, horizon, period, round(demand, 2) AS demand, round(fulfilled, 4) AS fulfilled, round(inventory, 4) + 0.0 AS inventory, stockout FROM det"))
def _(spark, folder):
    out = simulated(spark, folder, "always")
    return out.select(
        "scenario", "warehouse", "horizon", "period", F.round("demand", 2).alias("demand"), F.round("fulfilled", 4).alias("fulfilled"),
        tidy(F.col("inventory")).alias("inventory"), (F.col("missing") > 1e-9).alias("stockout"),
    )


@register("scenario_kpis", recursive(EXPECTED, "SELECT scenario, warehouse, horizon, round(fill_rate, 6) AS fill_rate, round(avg_utilization, 6) AS avg_utilization, round(inventory_cost, 4) AS inventory_cost, periods, fill_rate >= 0.95 AS meets_target FROM kpi"))
def _(spark, folder):
    out = scenarios.scenario_kpis(simulated(spark, folder, "expected"), BALANCED)
    return out.select(
        "scenario", "warehouse", "horizon", F.round("fill_rate", 6).alias("fill_rate"), F.round("avg_utilization", 6).alias("avg_utilization"),
        F.round("inventory_cost", 4).alias("inventory_cost"), "periods", "meets_target",
    )


@register("scenario_comparison", recursive(EXPECTED, "SELECT warehouse, horizon, count(*) AS scenarios_compared, arg_max(scenario, row(round(fill_rate, 9), -inventory_cost)) AS best_scenario, round(max(fill_rate), 6) AS best_fill_rate, max(fill_rate) >= 0.95 AS target_met FROM kpi GROUP BY 1, 2"))
def _(spark, folder):
    rows = scenarios.scenario_kpis(simulated(spark, folder, "expected"), BALANCED).withColumn("fill_rate", F.round("fill_rate", 9))
    return show(scenarios.compare(rows, BALANCED), "warehouse", "horizon", "scenarios_compared", "best_scenario", "target_met", digits=6, **num("best_fill_rate"))


@register("scenario_random_supply")
def _(spark, folder):
    return scenarios.scenario_kpis(simulated(spark, folder, "random"), BALANCED)


# ---- quality and contracts -------------------------------------------------------------------------------------

DEMAND_FEED = "feed AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, 'P' || l_partkey AS product_id, l_quantity AS demand, l_extendedprice / l_quantity AS price, p_type AS category FROM lineitem JOIN part ON l_partkey = p_partkey)"


def demand_feed(spark, folder):
    lines = feeds.table(spark, folder, "lineitem")
    types = feeds.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    return lines.join(types, "l_partkey").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.col("l_quantity").alias("demand"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "category",
    )


KNOWN = ", ".join(f"'{c}'" for c in quality.DEMAND_SUITE[11][1]["value_set"])


@register("quality_demand_suite", sql(DEMAND_FEED, f""",
a AS (SELECT count(*) AS n, count(*) FILTER (date IS NULL) AS dn, count(*) FILTER (product_id IS NULL) AS pn, count(*) FILTER (demand IS NULL) AS qn,
  avg(CASE WHEN demand BETWEEN 0 AND 100000 THEN 1.0 ELSE 0.0 END) AS db, avg(CASE WHEN price BETWEEN 0.01 AND 50000 THEN 1.0 ELSE 0.0 END) AS pb,
  count(*) FILTER (date IS NOT NULL AND try_strptime(date, '%Y-%m-%d') IS NULL) AS df, count(*) FILTER (category NOT IN ({KNOWN})) AS cx,
  avg(demand) AS dm, stddev_samp(demand) AS ds FROM feed)
SELECT 0 AS rule, true AS passed, NULL::DOUBLE AS observed FROM a UNION ALL SELECT 1, n BETWEEN 1 AND 10000000, n::DOUBLE FROM a UNION ALL SELECT 2, dn = 0, dn FROM a
UNION ALL SELECT 3, pn = 0, pn FROM a UNION ALL SELECT 4, qn = 0, qn FROM a UNION ALL SELECT 5, true, NULL FROM a UNION ALL SELECT 6, db >= 0.99, round(db, 6) FROM a
UNION ALL SELECT 7, true, NULL FROM a UNION ALL SELECT 8, pb >= 0.99, round(pb, 6) FROM a UNION ALL SELECT 9, df = 0, df FROM a UNION ALL SELECT 10, pn = 0, pn FROM a
UNION ALL SELECT 11, cx = 0, cx FROM a UNION ALL SELECT 12, dm BETWEEN 1 AND 10000, round(dm, 6) FROM a UNION ALL SELECT 13, ds BETWEEN 0 AND 50000, round(ds, 6) FROM a"""))
def _(spark, folder):
    return quality.run_suite(demand_feed(spark, folder), quality.DEMAND_SUITE).select("rule", "passed", F.round("observed", 6).alias("observed"))


def inventory_feed(spark, folder):
    facts = base.sku_facts(spark, folder)
    return facts.select(
        F.col("ds").cast("string").alias("date"), F.col("unique_id").alias("product_id"), (F.col("y") * 3).cast("long").alias("inventory_level"),
        "warehouse", (F.col("y") * 2).alias("reorder_point"), (F.col("y") % 30).alias("lead_time_days"), F.col("price").alias("unit_cost"),
        "category",
    )


@register("quality_inventory_summary", sql(SKU, """,
f AS (SELECT unique_id AS product_id, (y * 3)::BIGINT AS lvl, warehouse, y * 2 AS rop, y % 30 AS lead, price FROM facts),
r AS (SELECT true AS p FROM f LIMIT 1),
a AS (SELECT count(*) BETWEEN 1 AND 5000000 AS r1, count(*) FILTER (lvl NOT BETWEEN 0 AND 1000000) = 0 AS r6, avg(CASE WHEN lead BETWEEN 0 AND 365 THEN 1.0 ELSE 0.0 END) >= 0.99 AS r7,
  avg(CASE WHEN price BETWEEN 0.01 AND 100000 THEN 1.0 ELSE 0.0 END) >= 0.99 AS r8, count(*) FILTER (rop NOT BETWEEN 0 AND 500000) = 0 AS r9,
  count(DISTINCT warehouse) FILTER (warehouse IN ('NYC', 'LAX', 'CHI')) = 3 AS r11, count(DISTINCT product_id) * 1.0 / count(*) BETWEEN 0.001 AND 1 AS r12 FROM f)
SELECT 13 AS evaluated, 6 + r1::INT + r6::INT + r7::INT + r8::INT + r9::INT + r11::INT + r12::INT AS passed,
  13 - (6 + r1::INT + r6::INT + r7::INT + r8::INT + r9::INT + r11::INT + r12::INT) AS failed, r1 AND r6 AND r7 AND r8 AND r9 AND r11 AND r12 AS success FROM a"""))
def _(spark, folder):
    return quality.suite_summary(quality.run_suite(inventory_feed(spark, folder), quality.INVENTORY_SUITE))


@register("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, folder):
    return quality.duplicates(feeds.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


DIRTY_DEMAND = """dirty AS (SELECT CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_type END AS unique_id,
  CASE WHEN event_id % 37 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS ds,
  CASE WHEN event_id % 41 = 0 THEN 'many' WHEN event_id % 43 = 0 THEN '-1' ELSE CAST(value::DECIMAL(18,2) AS VARCHAR) END AS y FROM events)"""


def dirty_demand(spark, folder):
    e = F.col("event_id")
    return feeds.table(spark, folder, "events").select(
        F.when(e % 31 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("unique_id"),
        F.when(e % 37 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("ds"),
        F.when(e % 41 == 0, "many").when(e % 43 == 0, "-1").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("y"),
    )


@register("contract_violations", sql(DIRTY_DEMAND, """SELECT 'unique_id' AS "column", count(*) FILTER (unique_id IS NULL) AS broken FROM dirty
UNION ALL SELECT 'ds', count(*) FILTER (try_cast(ds AS DATE) IS NULL) FROM dirty
UNION ALL SELECT 'y', count(*) FILTER (try_cast(y AS DOUBLE) IS NULL OR try_cast(y AS DOUBLE) < 0) FROM dirty"""))
def _(spark, folder):
    return contracts.violation_counts(dirty_demand(spark, folder), contracts.DEMAND)


@register("contract_valid_rows", sql(DIRTY_DEMAND, """SELECT unique_id, ds, count(*) AS n, round(sum(try_cast(y AS DOUBLE)), 2) AS y FROM dirty
WHERE unique_id IS NOT NULL AND try_cast(ds AS DATE) IS NOT NULL AND try_cast(y AS DOUBLE) >= 0 GROUP BY 1, 2"""))
def _(spark, folder):
    valid, _ = contracts.enforce(dirty_demand(spark, folder), contracts.DEMAND)
    return valid.groupBy("unique_id", "ds").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y")).select("unique_id", day(), "n", "y")


@register("contract_quarantine", sql(DIRTY_DEMAND, """SELECT violations, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN unique_id IS NULL THEN 'unique_id' END,
CASE WHEN try_cast(ds AS DATE) IS NULL THEN 'ds' END, CASE WHEN try_cast(y AS DOUBLE) IS NULL OR try_cast(y AS DOUBLE) < 0 THEN 'y' END) AS violations FROM dirty)
WHERE violations <> '' GROUP BY 1"""))
def _(spark, folder):
    _, rejected = contracts.enforce(dirty_demand(spark, folder), contracts.DEMAND)
    return rejected.groupBy(F.concat_ws(",", "violations").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


# ---- run history -----------------------------------------------------------------------------------------------

RUNS = """
runs AS (SELECT 'batch_' || lpad(o_orderkey::VARCHAR, 10, '0') AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  'feed_' || o_custkey || '_dirty.csv' AS source_file, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds((60 + o_orderkey % 7200)::BIGINT) END AS completed_at FROM orders),
results AS (SELECT 'batch_' || lpad(l_orderkey::VARCHAR, 10, '0') AS batch_id, ['etl', 'stats', 'supply_chain', 'ml', 'capacity', 'sensing', 'sop'][l_linenumber] AS analysis_type,
  sum(l_quantity)::BIGINT AS units, round(sum(l_extendedprice), 2) AS value, l_linenumber AS position FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def runs(spark, folder):
    return feeds.stage_runs(spark, folder)


def results(spark, folder):
    return feeds.stage_results(spark, folder)


@register("recent_runs", sql(RUNS, f"SELECT batch_id, status, source_file, {stamp_sql('started_at')} FROM runs ORDER BY runs.started_at DESC, batch_id LIMIT 50"))
def _(spark, folder):
    return history.recent_runs(runs(spark, folder)).select("batch_id", "status", "source_file", stamp("started_at"))


@register("run_status", sql(RUNS, """, d AS (SELECT batch_id, count(*) AS n, string_agg(analysis_type, ',' ORDER BY position) AS s FROM results GROUP BY 1)
SELECT batch_id, status, coalesce(s, '') AS completed_stages, floor(coalesce(n, 0) * 100 / 7)::INTEGER AS progress_pct FROM runs LEFT JOIN d USING (batch_id)"""))
def _(spark, folder):
    out = history.run_status(runs(spark, folder), results(spark, folder))
    return out.select("batch_id", "status", F.concat_ws(",", "completed_stages").alias("completed_stages"), "progress_pct")


@register("stage_progress", sql(RUNS, """SELECT analysis_type, status, count(*) AS n, max(CASE status WHEN 'completed' THEN floor(position * 100 / 7) WHEN 'running' THEN floor((position - 1) * 100 / 7) ELSE 0 END)::INTEGER AS progress_pct
FROM results JOIN runs USING (batch_id) GROUP BY 1, 2"""))
def _(spark, folder):
    joined = results(spark, folder).join(runs(spark, folder), "batch_id")
    return joined.groupBy("analysis_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.max(history.stage_progress(F.col("analysis_type"), F.col("status"))).alias("progress_pct")
    )


@register("run_detail", sql(RUNS, """SELECT batch_id, status, count(analysis_type) AS analyses, coalesce(sum(units), 0)::BIGINT AS units FROM runs LEFT JOIN results USING (batch_id) GROUP BY 1, 2"""))
def _(spark, folder):
    out = history.run_detail(runs(spark, folder), results(spark, folder))
    units = F.aggregate("analyses", F.lit(0).cast("long"), lambda s, a: s + F.get_json_object(a.result_json, "$.units").cast("long"))
    return out.select("batch_id", "status", F.coalesce(F.size("analyses").cast("long"), F.lit(0)).alias("analyses"), F.coalesce(units, F.lit(0)).alias("units"))


@register("analysis_by_type", sql(RUNS, "SELECT batch_id, units, value FROM results WHERE analysis_type = 'supply_chain'"))
def _(spark, folder):
    out = history.analysis_of(results(spark, folder), "supply_chain")
    return out.select(
        "batch_id", F.get_json_object("result_json", "$.units").cast("long").alias("units"), F.get_json_object("result_json", "$.value").cast("double").alias("value")
    )


@register("latest_kpis", sql(RUNS, f""", l AS (SELECT * FROM runs WHERE status = 'completed' ORDER BY completed_at DESC, batch_id DESC LIMIT 1)
SELECT batch_id, {stamp_sql('completed_at')}, units FROM l JOIN results USING (batch_id) WHERE analysis_type = 'stats'"""))
def _(spark, folder):
    out = history.latest_kpis(runs(spark, folder), results(spark, folder))
    return out.select("batch_id", stamp("completed_at"), F.get_json_object("result_json", "$.units").cast("long").alias("units"))


@register("kpi_history", sql(RUNS, f"""SELECT batch_id, {stamp_sql('completed_at')}, units, value FROM runs JOIN results USING (batch_id)
WHERE status = 'completed' AND analysis_type = 'stats' ORDER BY runs.completed_at DESC, batch_id LIMIT 20"""))
def _(spark, folder):
    return history.kpi_history(runs(spark, folder), results(spark, folder)).select("batch_id", stamp("completed_at"), "units", "value")


@register("run_page", sql(RUNS, "SELECT batch_id, status FROM runs ORDER BY batch_id LIMIT 500 OFFSET 1000"))
def _(spark, folder):
    return history.page(runs(spark, folder), ["batch_id"], 1000, 500).select("batch_id", "status")


# ---- audit and operations --------------------------------------------------------------------------------------

LOG = """
log AS (SELECT 'evt-' || event_id AS event_id, ts, 'user-' || user_id AS user_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'PUT' ELSE 'POST' END AS action,
  '/api/' || event_type || '/' || (event_id % 10) AS resource, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 503 WHEN event_type = 'error' THEN 404
  WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status_code, value * 4 AS duration_ms FROM events),
hw AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS slot, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors, quantile_cont(duration_ms, 0.5) AS p50,
  quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99 FROM log GROUP BY 1)"""


def log(spark, folder):
    return feeds.request_log(spark, folder)


@register("audit_query", sql(LOG, f"""SELECT event_id, {stamp_sql('ts')}, user_id, resource, status_code FROM log WHERE action = 'POST' AND resource LIKE '/api/error%'
AND status_code BETWEEN 400 AND 499 ORDER BY log.ts DESC, event_id DESC LIMIT 100 OFFSET 10"""))
def _(spark, folder):
    out = history.audit_query(log(spark, folder), action="POST", resource_prefix="/api/error", min_status=400, max_status=499, limit=100, offset=10)
    return out.select("event_id", stamp("ts"), "user_id", "resource", "status_code")


@register("audit_recent", sql(LOG, f"SELECT event_id, {stamp_sql('ts')}, user_id, status_code FROM log ORDER BY log.ts DESC, event_id DESC LIMIT 50"))
def _(spark, folder):
    return history.audit_query(log(spark, folder), limit=50).select("event_id", stamp("ts"), "user_id", "status_code")


@register("audit_stats", sql(LOG, """SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(*) FILTER (status_code >= 400) AS error_count, round(avg(duration_ms), 4) AS avg_duration_ms,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM log"""))
def _(spark, folder):
    out = history.audit_stats(log(spark, folder))
    return show(out, "total_events", "unique_users", "error_count", stamp("earliest"), stamp("latest"), **num("avg_duration_ms"))


@register("window_health", sql(LOG, f"SELECT {stamp_sql('slot')}, requests, errors, {rsql('p50', 'p95', 'p99')}, round(errors / requests, 6) AS error_rate FROM hw"))
def _(spark, folder):
    out = history.window_health(log(spark, folder))
    return show(out, stamp("slot"), "requests", "errors", F.round("error_rate", 6).alias("error_rate"), **num("p50", "p95", "p99"))


@register("service_objectives", sql(LOG, """, a AS (SELECT (1 - sum(errors) / sum(requests)) * 100 AS av, avg(CASE WHEN p95 < 500 THEN 1.0 ELSE 0.0 END) * 100 AS w95,
  avg(CASE WHEN p99 < 2000 THEN 1.0 ELSE 0.0 END) * 100 AS w99, sum(errors) AS e, sum(requests) * 0.001 AS b FROM hw)
SELECT 'api-availability' AS objective, round(av, 4) AS value, av >= 99.9 AS met FROM a UNION ALL SELECT 'api-latency-p95', round(w95, 4), w95 >= 99 FROM a
UNION ALL SELECT 'api-latency-p99', round(w99, 4), w99 >= 99 FROM a UNION ALL SELECT 'error-budget', round(e / b * 100, 4), e <= b FROM a"""))
def _(spark, folder):
    return show(history.service_levels(log(spark, folder)), "objective", "met", **num("value"))


@register("forecast_objective", sql(DAILY_ERROR, """, p AS (SELECT model, avg(mape) AS m FROM daily GROUP BY 1)
SELECT count(*) AS products, round(avg(CASE WHEN m < 15 THEN 1.0 ELSE 0.0 END) * 100, 4) AS value, avg(CASE WHEN m < 15 THEN 1.0 ELSE 0.0 END) * 100 >= 95 AS met FROM p"""))
def _(spark, folder):
    per = daily_errors(spark, folder).groupBy("model").agg(F.avg("mape").alias("mape"))
    return show(history.forecast_objective(per), "products", "met", **num("value"))


@register("pipeline_objective", sql(RUNS, """SELECT count(*) AS runs, round(avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) * 100, 4) AS value,
avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) * 100 >= 95 AS met FROM runs WHERE status <> 'running'"""))
def _(spark, folder):
    return show(history.pipeline_objective(runs(spark, folder)), "runs", "met", **num("value"))


@register("check_freshness", sql(LOG, """, g AS (SELECT epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (ORDER BY ts) AS p, date_trunc('hour', ts) AS h, date_trunc('hour', lag(ts) OVER (ORDER BY ts)) AS ph FROM log WHERE status_code = 503)
SELECT round(max((t - p) / 3.6e9), 4) AS longest_gap_hours, max((t - p) / 3.6e9) <= 6 AS met FROM g WHERE h <> ph"""))
def _(spark, folder):
    return show(history.freshness(log(spark, folder), F.col("status_code") == 503), "met", **num("longest_gap_hours"))


@register("alerts", sql(LOG, f"""SELECT {stamp_sql('slot')}, 'HighErrorRate' AS alert, 'warning' AS severity, round(errors / requests, 4) AS value FROM hw WHERE errors / requests > 0.05
UNION ALL SELECT {stamp_sql('slot')}, 'HighLatency', 'warning', round(p95 / 1000, 4) FROM hw WHERE p95 > 500"""))
def _(spark, folder):
    return show(history.alerts(history.window_health(log(spark, folder))), stamp("slot"), "alert", "severity", **num("value"))


@register("rate_limit_breaches", sql(LOG, """, s AS (SELECT user_id, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds((k * 10)::BIGINT) AS slot FROM log, range(6) r(k))
SELECT user_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS requests FROM s GROUP BY user_id, s.slot HAVING count(*) > 1"""))
def _(spark, folder):
    out = history.rate_limit_breaches(log(spark, folder), limit=1)
    return out.select("user_id", stamp("slot"), "requests")


@register("latency_histogram", sql(LOG, " UNION ALL ".join(
    f"SELECT '{e}' AS le, count(*) FILTER (duration_ms / 1000 <= {e}) AS requests FROM log" for e in K.LATENCY_BUCKETS) + " UNION ALL SELECT 'Infinity', count(*) FROM log"))
def _(spark, folder):
    return history.latency_histogram(log(spark, folder), K.LATENCY_BUCKETS).select(F.col("le").cast("string").alias("le"), "requests")
