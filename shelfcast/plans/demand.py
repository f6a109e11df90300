"""Registered queries: demand series, features, forecasts, evaluation and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.forecasting import closed_form, evaluation, registry, regression, trees
from shelfcast.functions.numeric import tidy
from shelfcast.operators import features, hierarchy
from shelfcast.plans import base
from shelfcast.plans.base import BRAND, SKU, SKU_DAILY, Query, sql
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


def day(col="ds"):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def show(df, *keys, digits=4, **numbers):
    return df.select(*keys, *[tidy(F.col(c), digits).alias(n) for n, c in numbers.items()])


def num(*names):
    return {n: n for n in names}


def rsql(*names, digits=4):
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


DS = "strftime(ds, '%Y-%m-%d') AS ds"

# ---- series and features ---------------------------------------------------------------------------------------


@register("brand_demand", sql(BRAND, f"SELECT unique_id, {DS}, y FROM y"))
def _(spark, folder):
    return feeds.brand_demand(spark, folder).select("unique_id", day(), "y")


FEATURES = BRAND + """,
feat AS (SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7, lag(y, 14) OVER w AS lag_14, lag(y, 28) OVER w AS lag_28,
  avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
  coalesce(stddev_samp(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS rolling_std_7,
  avg(y) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS rolling_mean_28,
  isodow(ds) - 1 AS day_of_week, month(ds) AS month, dayofyear(ds) AS day_of_year
  FROM y WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"""
FEATURE_NUMBERS = ("lag_1", "lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_std_7", "rolling_mean_28")
CALENDAR = "day_of_week, month, day_of_year"


@register("demand_features", sql(FEATURES, f"SELECT unique_id, {DS}, y, {CALENDAR}, {rsql(*FEATURE_NUMBERS, digits=6)} FROM feat"))
def _(spark, folder):
    out = features.demand_features(base.brand_demand(spark, folder))
    return show(out, "unique_id", day(), "y", "day_of_week", "month", "day_of_year", digits=6, **num(*FEATURE_NUMBERS))


@register("latest_features", sql(FEATURES, f"""SELECT unique_id, {DS}, y, {rsql(*FEATURE_NUMBERS, digits=6)} FROM (
SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS rn FROM feat) WHERE rn = 1"""))
def _(spark, folder):
    out = features.latest_features(features.demand_features(base.brand_demand(spark, folder)))
    return show(out, "unique_id", day(), "y", digits=6, **num(*FEATURE_NUMBERS))


@register("feature_upsert", sql(FEATURES, f"""SELECT unique_id, {DS}, y, {rsql('rolling_mean_7', digits=6)} FROM (
SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS rn FROM feat) WHERE rn = 1"""))
def _(spark, folder):
    feat = features.demand_features(base.brand_demand(spark, folder)).select("unique_id", "ds", "y", "rolling_mean_7")
    older = features.latest_features(feat.where("ds < date'2000-01-01'"))
    return show(features.upsert_features(older, feat.where("ds >= date'2000-01-01'")), "unique_id", day(), "y", digits=6, **num("rolling_mean_7"))


@register("training_slice", sql(FEATURES, f"""SELECT unique_id, {DS}, y, {rsql('rolling_mean_7', digits=6)} FROM feat
WHERE unique_id IN ('Brand#1', 'Brand#7') AND ds BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"""))
def _(spark, folder):
    feat = features.demand_features(base.brand_demand(spark, folder))
    out = features.training_slice(feat, ["Brand#1", "Brand#7"], "1997-01-01", "1997-12-31")
    return show(out, "unique_id", day(), "y", digits=6, **num("rolling_mean_7"))


HOLIDAY = """CASE WHEN month(ds) = 11 AND day(ds) BETWEEN 22 AND 28 OR month(ds) = 12 AND day(ds) >= 15
  OR month(ds) = 7 AND day(ds) = 4 OR month(ds) = 1 AND day(ds) <= 3 THEN 1 ELSE 0 END"""
DRIVERS = SKU + f""",
xf AS (SELECT unique_id, ds, CASE WHEN round(discount, 6) > 0.05 THEN 1 ELSE 0 END AS promo_flag, {HOLIDAY} AS is_holiday,
  15.0 + 10.0 * sin(2 * pi() * dayofyear(ds) / 365.0) AS temperature FROM facts),
xp AS (SELECT unique_id, ds, price, CASE WHEN y % 7 = 0 THEN 0.0 ELSE y * 2 END AS stock_level FROM facts)"""


@register("feature_table", sql(DRIVERS, f"""SELECT unique_id, {DS}, facts.y AS y,
round(avg(facts.y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS rolling_mean_7,
promo_flag, is_holiday, round(temperature, 4) AS temperature, round(xp.price, 8) AS price, stock_level
FROM facts LEFT JOIN xf USING (unique_id, ds) LEFT JOIN xp USING (unique_id, ds)"""))
def _(spark, folder):
    facts = base.sku_facts(spark, folder)
    out = features.feature_table(feeds.demand_of(facts), feeds.future_drivers(facts), feeds.past_drivers(facts))
    return out.select(
        "unique_id", day(), "y", F.round("rolling_mean_7", 6).alias("rolling_mean_7"), "promo_flag", "is_holiday",
        F.round("temperature", 4).alias("temperature"), F.round("price", 8).alias("price"), "stock_level",
    )


@register("dataset_statistics", sql(SKU_DAILY, """, p AS (SELECT unique_id, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS z FROM y GROUP BY 1)
SELECT count(*) AS total_rows, count(DISTINCT unique_id) AS n_skus, count(DISTINCT ds) AS n_days, (SELECT count(*) FROM p WHERE z > 0.5) AS n_intermittent_skus,
  round((SELECT count(*) FROM p WHERE z > 0.5) * 100.0 / count(DISTINCT unique_id), 4) AS intermittent_pct, round(avg(y), 4) AS mean_demand,
  quantile_cont(y, 0.5) AS median_demand, round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS zero_demand_pct FROM y"""))
def _(spark, folder):
    out = features.dataset_statistics(base.sku_daily(spark, folder))
    return show(out, "total_rows", "n_skus", "n_days", "n_intermittent_skus", "median_demand", **num("intermittent_pct", "mean_demand", "zero_demand_pct"))


@register("series_profile", sql(SKU_DAILY, """SELECT unique_id, count(*) AS n_days, round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share
FROM y GROUP BY 1"""))
def _(spark, folder):
    return show(features.series_profile(base.sku_daily(spark, folder)), "unique_id", "n_days", digits=6, **num("zero_share"))


@register("censored_days", sql(DRIVERS + """,
spans AS (SELECT unique_id, min(ds) AS a, max(ds) AS b FROM facts GROUP BY 1),
days AS (SELECT unique_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS ds FROM spans),
filled AS (SELECT unique_id, ds, coalesce(facts.y, 0.0) AS y FROM days LEFT JOIN facts USING (unique_id, ds)),
stock AS (SELECT unique_id, (ds + INTERVAL 1 DAY)::DATE AS ds, stock_level FROM xp)""",
    "SELECT unique_id, count(*) AS days FROM filled JOIN stock USING (unique_id, ds) WHERE y = 0 AND stock_level = 0 GROUP BY 1"))
def _(spark, folder):
    # Stock is known at the close of the day before.
    stock = feeds.past_drivers(base.sku_facts(spark, folder)).withColumn("ds", F.date_add("ds", 1))
    return features.censored_days(base.sku_daily(spark, folder), stock).groupBy("unique_id").agg(F.count(F.lit(1)).alias("days"))


@register("promotion_lift", sql(DRIVERS, """SELECT promo_flag, count(*) AS days, round(avg(y), 4) AS mean_demand
FROM facts JOIN xf USING (unique_id, ds) GROUP BY 1"""))
def _(spark, folder):
    facts = base.sku_facts(spark, folder)
    return show(features.promotion_lift(feeds.demand_of(facts), feeds.future_drivers(facts)), "promo_flag", "days", **num("mean_demand"))


@register("price_elasticity", sql(SKU, "SELECT category, count(*) AS n, round(regr_slope(ln(y), ln(price)), 6) AS elasticity FROM facts GROUP BY 1"))
def _(spark, folder):
    return show(features.price_elasticity(base.sku_facts(spark, folder)), "category", "n", digits=6, **num("elasticity"))


@register("substitution_effect", sql(SKU, """,
g AS (SELECT *, CASE WHEN round(discount, 6) > 0.05 THEN 1 ELSE 0 END AS own,
  sum(CASE WHEN round(discount, 6) > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY warehouse, category, subcategory, ds) AS promoted FROM facts)
SELECT category, CASE WHEN promoted - own > 0 THEN 'peer promoted' ELSE 'no peer promoted' END AS peers, count(*) AS days, round(avg(y), 4) AS mean_demand
FROM g WHERE own = 0 GROUP BY 1, 2"""))
def _(spark, folder):
    out = features.substitution_effect(base.sku_facts(spark, folder), F.round("discount", 6) > 0.05)
    return show(out, "category", "peers", "days", **num("mean_demand"))


@register("table_fingerprint", sql(BRAND, """, h AS (SELECT sha256(unique_id || ',' || strftime(ds, '%Y-%m-%d') || ',' || CAST(y::BIGINT AS VARCHAR)) AS d FROM y)
SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(d, 1, 12))::BIGINT) AS VARCHAR) AS hash_a,
  CAST(sum(('0x' || substr(d, 13, 12))::BIGINT) AS VARCHAR) AS hash_b FROM h"""))
def _(spark, folder):
    y = base.brand_demand(spark, folder)
    return features.table_fingerprint(y.select("unique_id", day(), F.col("y").cast("long").alias("y")))


# ---- forecasts -------------------------------------------------------------------------------------------------

HORIZON = 14
POS = BRAND + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY unique_id) AS n FROM y)"""
NAIVE = POS + """,
fit AS (SELECT unique_id, avg(y) FILTER (n - 1 - t < 30) AS level, stddev_pop(y) FILTER (n - 1 - t < 30) AS sd, max(ds) AS last_ds FROM pos GROUP BY 1),
naive AS (SELECT unique_id, last_ds + s::INTEGER AS ds, greatest(level, 0) AS y_hat, sd FROM fit, range(1, 15) r(s))"""


def forecast_view(df, *extra):
    return df.select("unique_id", day(), F.round("y_hat", 4).alias("y_hat"), *extra)


@register("forecast_naive", sql(NAIVE, f"SELECT unique_id, {DS}, round(y_hat, 4) AS y_hat FROM naive"))
def _(spark, folder):
    return forecast_view(closed_form.naive(base.brand_demand(spark, folder), HORIZON))


@register("forecast_zero_shot", sql(NAIVE.replace("range(1, 15)", "range(1, 31)"), f"SELECT unique_id, {DS}, round(y_hat, 4) AS y_hat FROM naive"))
def _(spark, folder):
    return forecast_view(closed_form.zero_shot(base.brand_demand(spark, folder), 30))


@register("forecast_weighted_trend", sql(POS, f""",
w AS (SELECT *, power(1 - 2.0::DOUBLE / (least(30, n) + 1), n - 1 - t) AS w FROM pos),
fit AS (SELECT unique_id, sum(w * y) / sum(w) AS level, coalesce(regr_slope(y, t) FILTER (n - 1 - t < 30), 0) AS slope, max(ds) AS last_ds FROM w GROUP BY 1)
SELECT unique_id, strftime(last_ds + s::INTEGER, '%Y-%m-%d') AS ds, round(greatest(level + slope * s, 0), 4) AS y_hat FROM fit, range(1, 15) r(s)"""))
def _(spark, folder):
    return forecast_view(closed_form.weighted_trend(base.brand_demand(spark, folder), HORIZON))


WAVES_FIT = ", ".join(
    f"sum((y - a0 - a1 * u - a2 * u * u) * {fn}(2 * pi() * {k} * t / period)) * 2 / max(n) AS {tag}{k}"
    for k in (1, 2, 3) for tag, fn in (("c", "cos"), ("s", "sin"))
)
WAVES_AT = " + ".join(
    f"{tag}{k} * {fn}(2 * pi() * {k} * (n + s - 1) / period)" for k in (1, 2, 3) for tag, fn in (("c", "cos"), ("s", "sin"))
)


@register("forecast_trend_harmonics", sql(POS, f""",
u AS (SELECT *, t - (n - 1) / 2.0::DOUBLE AS u, least(7.0::DOUBLE, n / 2.0::DOUBLE) AS period FROM pos),
m AS (SELECT unique_id, sum(y) AS sy, sum(u * y) AS suy, sum(u * u * y) AS su2y, sum(u * u) AS su2, sum(u * u * u * u) AS su4 FROM u GROUP BY 1),
p AS (SELECT u.*, suy / su2 AS a1, (n * su2y - su2 * sy) / (n * su4 - su2 * su2) AS a2,
  (sy - (n * su2y - su2 * sy) / (n * su4 - su2 * su2) * su2) / n AS a0 FROM u JOIN m USING (unique_id)),
fit AS (SELECT unique_id, max(a0) AS a0, max(a1) AS a1, max(a2) AS a2, max(n) AS n, max(period) AS period, max(ds) AS last_ds, {WAVES_FIT} FROM p GROUP BY 1)
SELECT unique_id, strftime(last_ds + s::INTEGER, '%Y-%m-%d') AS ds,
  round(greatest(a0 + a1 * (n + s - 1 - (n - 1) / 2.0::DOUBLE) + a2 * (n + s - 1 - (n - 1) / 2.0::DOUBLE) * (n + s - 1 - (n - 1) / 2.0::DOUBLE) + {WAVES_AT}, 0), 4) AS y_hat
FROM fit, range(1, 15) r(s)"""))
def _(spark, folder):
    return forecast_view(closed_form.trend_harmonics(base.brand_demand(spark, folder), HORIZON))


@register("forecast_seasonal_trend", sql(POS, """,
ma AS (SELECT *, CASE WHEN t >= 3 AND n - 1 - t >= 3 THEN avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS m FROM pos),
ends AS (SELECT unique_id, regr_slope(m, t) FILTER (t >= 3 AND t < 10) AS hk, regr_intercept(m, t) FILTER (t >= 3 AND t < 10) AS hc,
  regr_slope(m, t) FILTER (t >= n - 11 AND t < n - 4) AS tk, regr_intercept(m, t) FILTER (t >= n - 11 AND t < n - 4) AS tc, regr_slope(y, t) AS slope, max(ds) AS last_ds FROM ma GROUP BY 1),
tr AS (SELECT ma.*, coalesce(m, CASE WHEN t < 3 THEN hk * t + hc ELSE tk * t + tc END) AS trend, slope, last_ds FROM ma JOIN ends USING (unique_id)),
ph AS (SELECT unique_id, t % 7 AS phase, avg(y - trend) AS s FROM tr GROUP BY 1, 2),
fit AS (SELECT unique_id, max(trend) FILTER (t = n - 1) AS last_trend, max(slope) AS slope, max(n) AS n, max(last_ds) AS last_ds FROM tr GROUP BY 1)
SELECT fit.unique_id AS unique_id, strftime(last_ds + s::INTEGER, '%Y-%m-%d') AS ds,
  round(greatest(last_trend + slope * r.s + ph.s - (SELECT avg(q.s) FROM ph q WHERE q.unique_id = fit.unique_id), 0), 4) AS y_hat
FROM fit, range(1, 15) r(s), ph WHERE ph.unique_id = fit.unique_id AND ph.phase = (n + r.s - 1) % 7""".replace("last_ds + s::INTEGER", "last_ds + r.s::INTEGER")))
def _(spark, folder):
    return forecast_view(closed_form.seasonal_trend(base.brand_demand(spark, folder), HORIZON))


@register("forecast_ridge")
def _(spark, folder):
    return forecast_view(regression.ridge(base.brand_demand(spark, folder), HORIZON))


@register("forecast_seasonal_ar")
def _(spark, folder):
    return forecast_view(regression.seasonal_ar(base.sku_daily(spark, folder), HORIZON))


@register("forecast_boosted_trees")
def _(spark, folder):
    y = base.brand_demand(spark, folder)
    return forecast_view(trees.predict(trees.fit(y, **trees.PRESETS["lightgbm"]), y, HORIZON))


@register("tree_importances")
def _(spark, folder):
    return trees.importances(trees.fit(base.brand_demand(spark, folder), **trees.PRESETS["lightgbm"]), spark)


def mixed_demand(spark, folder):
    """Sparse and dense series together."""
    return base.sku_daily(spark, folder).unionByName(base.brand_demand(spark, folder))


MIXED = SKU_DAILY.replace("y AS (SELECT unique_id, ds, coalesce", "yk AS (SELECT unique_id, ds, coalesce") + "," + BRAND.replace("y AS (", "yb AS (") + """,
y AS (SELECT * FROM yk UNION ALL SELECT * FROM yb),
prof AS (SELECT unique_id, count(*) AS n_days, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS z FROM y GROUP BY 1)"""
ROUTE = "CASE WHEN n_days < 60 THEN 'chronos2_zs' WHEN z > {0} THEN 'sarimax' ELSE 'lightgbm' END"


@register("routing_assignments", sql(MIXED, f"SELECT unique_id, n_days, round(z, 6) AS zero_share, {ROUTE.format(0.5)} AS model, {ROUTE.format(0.3)} AS serving_model FROM prof"))
def _(spark, folder):
    y = mixed_demand(spark, folder)
    assigned = registry.assign(y).withColumn("serving_model", registry.route(F.col("n_days"), F.col("zero_share"), intermittent=0.3))
    return show(assigned, "unique_id", "n_days", "model", "serving_model", digits=6, **num("zero_share"))


@register("routing_summary", sql(MIXED, f"SELECT {ROUTE.format(0.5)} AS model, count(*) AS series FROM prof GROUP BY 1"))
def _(spark, folder):
    return registry.routing_summary(registry.assign(mixed_demand(spark, folder)))


@register("routing_fallback", sql(MIXED, f"SELECT CASE WHEN m = 'lightgbm' THEN 'xgboost' WHEN m = 'chronos2_zs' THEN 'xgboost' ELSE m END AS model_used, count(*) AS series FROM (SELECT {ROUTE.format(0.5)} AS m FROM prof) GROUP BY 1"))
def _(spark, folder):
    out = registry.with_fallback(registry.assign(mixed_demand(spark, folder)), ["xgboost", "sarimax", "naive_ma30"])
    return out.groupBy("model_used").agg(F.count(F.lit(1)).alias("series"))


@register("routed_forecast")
def _(spark, folder):
    return forecast_view(registry.routed_forecast(mixed_demand(spark, folder), HORIZON), "model")


@register("forecast_bands", sql(NAIVE, f"SELECT unique_id, {DS}, round(y_hat, 4) AS y_hat, round(y_hat - 1.96 * sd, 4) AS lower, round(y_hat + 1.96 * sd, 4) AS upper FROM naive"))
def _(spark, folder):
    y = base.brand_demand(spark, folder)
    out = registry.with_bands(closed_form.naive(y, HORIZON), y)
    return forecast_view(out, F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@register("stale_fallback", sql(NAIVE, f""",
older AS (SELECT unique_id, avg(y) AS level FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS rn FROM y WHERE ds < DATE '2001-10-28') WHERE rn <= 30 GROUP BY 1)
SELECT unique_id, strftime(naive.ds, '%Y-%m-%d') AS ds, round(CASE WHEN bad THEN CASE WHEN naive.ds <= lim THEN level END ELSE y_hat END, 4) AS y_hat, bad AND naive.ds <= lim AS is_stale
FROM (SELECT *, CAST(regexp_replace(unique_id, '[^0-9]', '', 'g') AS INTEGER) % 5 = 0 AS bad FROM naive) naive JOIN older USING (unique_id)
  JOIN (SELECT unique_id, max(ds) + 14 AS lim FROM y WHERE ds < DATE '2001-10-28' GROUP BY 1) USING (unique_id)"""))
def _(spark, folder):
    y = base.brand_demand(spark, folder)
    every = closed_form.naive(y, HORIZON)
    older = closed_form.naive(y.where("ds < date'2001-10-28'"), HORIZON)
    failed = F.regexp_replace("unique_id", "[^0-9]", "").cast("int") % 5 == 0
    return forecast_view(registry.stale_fallback(every, every.where(~failed), older), "is_stale")


# ---- evaluation ------------------------------------------------------------------------------------------------

FOLDS = BRAND + """,
dd AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT ds FROM y)),
ff AS (SELECT k AS fold, total - 1 - k * 30 AS e, total - k * 30 - 14 AS s FROM (SELECT max(total) AS total FROM dd), range(12) r(k)),
folds AS (SELECT fold::INTEGER AS fold, (SELECT ds FROM dd WHERE i = s - 1) AS train_end, (SELECT ds FROM dd WHERE i = s) AS test_start,
  (SELECT ds FROM dd WHERE i = e) AS test_end FROM ff WHERE s - 1 >= 60)"""
CV = FOLDS + """,
tr AS (SELECT fold, unique_id, ds, y, row_number() OVER (PARTITION BY fold, unique_id ORDER BY ds DESC) AS rn FROM y JOIN folds ON ds <= train_end),
fc AS (SELECT fold, unique_id, last_ds + s::INTEGER AS ds, level AS y_hat FROM (
  SELECT fold, unique_id, avg(y) FILTER (rn <= 30) AS level, max(ds) AS last_ds FROM tr GROUP BY 1, 2), range(1, 15) r(s)),
err AS (SELECT fc.*, y.y FROM fc JOIN y USING (unique_id, ds) JOIN folds USING (fold) WHERE ds BETWEEN test_start AND test_end),
fr AS (SELECT fold, count(*) AS n, avg(abs((y - y_hat) / y)) FILTER (y > 0) * 100 AS mape,
  avg(abs((CASE WHEN y = 0 THEN 1 ELSE y END - y_hat) / CASE WHEN y = 0 THEN 1 ELSE y END)) * 100 AS mape_eps,
  sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse, avg(abs(y - y_hat)) AS mae FROM err GROUP BY 1)"""


@register("cv_folds", sql(FOLDS, "SELECT fold, CAST(train_end AS VARCHAR) AS train_end, CAST(test_start AS VARCHAR) AS test_start, CAST(test_end AS VARCHAR) AS test_end FROM folds"))
def _(spark, folder):
    return evaluation.folds(base.brand_demand(spark, folder)).select("fold", *[F.col(c).cast("string").alias(c) for c in ("train_end", "test_start", "test_end")])


@register("walk_forward_naive", sql(CV, f"SELECT fold, n, {rsql('mape', 'mape_eps', 'rmse', 'mae')} FROM fr"))
def _(spark, folder):
    return show(evaluation.walk_forward(base.brand_demand(spark, folder), closed_form.naive), "fold", "n", **num("mape", "mape_eps", "rmse", "mae"))


def naive_errors(spark, folder):
    y = base.brand_demand(spark, folder)
    return evaluation.walk_forward_errors(y, closed_form.naive, evaluation.folds(y))


@register("conformal_intervals", sql(CV, f""",
lv AS (SELECT least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / count(*))) AS lv FROM err),
o AS (SELECT abs(y - y_hat) AS a, row_number() OVER (ORDER BY abs(y - y_hat)) - 1 AS i, count(*) OVER () AS n FROM err),
q AS (SELECT max(a) FILTER (i = floor((n - 1) * lv)) + (max((n - 1) * lv) - floor(max((n - 1) * lv))) *
  (max(a) FILTER (i = least(floor((n - 1) * lv) + 1, n - 1)) - max(a) FILTER (i = floor((n - 1) * lv))) AS q FROM o, lv)
SELECT fold, count(*) AS n, round(max(q), 4) AS half_width, round(avg(CASE WHEN y BETWEEN greatest(0, y_hat - q) AND y_hat + q THEN 1.0 ELSE 0.0 END), 4) AS coverage
FROM err, q GROUP BY 1"""))
def _(spark, folder):
    errors = naive_errors(spark, folder)
    q = evaluation.global_half_width(errors)
    banded = evaluation.conformal_intervals(errors, q).withColumn("q", q)
    out = banded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.max("q").alias("half_width"), evaluation.coverage(F.col("y"), F.col("y_lo_90"), F.col("y_hi_90")).alias("coverage")
    )
    return show(out, "fold", "n", **num("half_width", "coverage"))


@register("conformal_by_series", sql(CV, """, g AS (SELECT unique_id, abs(y - y_hat) AS a, row_number() OVER (PARTITION BY unique_id ORDER BY abs(y - y_hat)) - 1 AS i,
  count(*) OVER (PARTITION BY unique_id) AS n FROM err),
h AS (SELECT *, (n - 1) * least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) AS sp FROM g)
SELECT unique_id, round(max(a) FILTER (i = floor(sp)) + (max(sp) - floor(max(sp))) * (max(a) FILTER (i = least(floor(sp) + 1, n - 1)) - max(a) FILTER (i = floor(sp))), 4) AS half_width
FROM h GROUP BY 1"""))
def _(spark, folder):
    return show(evaluation.calibrate(naive_errors(spark, folder), ["unique_id"]), "unique_id", **num("half_width"))


CV_TWO = CV + """,
fc2 AS (SELECT fold, unique_id, last_ds + s::INTEGER AS ds, level AS y_hat FROM (
  SELECT fold, unique_id, avg(y) FILTER (rn <= 7) AS level, max(ds) AS last_ds FROM tr GROUP BY 1, 2), range(1, 15) r(s)),
fr2 AS (SELECT fold, avg(abs((y.y - y_hat) / y.y)) FILTER (y.y > 0) * 100 AS mape FROM fc2 JOIN y USING (unique_id, ds) JOIN folds USING (fold)
  WHERE ds BETWEEN test_start AND test_end GROUP BY 1)"""


def short_naive(demand, horizon, keys=closed_form.SERIES):
    return closed_form.naive(demand, horizon, keys, 7)


def paired_folds(spark, folder):
    y = base.brand_demand(spark, folder)
    one = evaluation.walk_forward(y, short_naive).select("fold", F.col("mape").alias("base"))
    two = evaluation.walk_forward(y, closed_form.naive).select("fold", "mape")
    return one.join(two, "fold").withColumn("model", F.lit("naive_ma30"))


@register("effect_size", sql(CV_TWO, """SELECT 'naive_ma30' AS model, round(d, 4) AS d, CASE WHEN abs(d) < 0.5 THEN 'S' WHEN abs(d) < 0.8 THEN 'M' ELSE 'L' END AS magnitude FROM (
SELECT (avg(fr2.mape) - avg(fr.mape)) / sqrt((var_samp(fr2.mape) + var_samp(fr.mape)) / 2) AS d FROM fr JOIN fr2 USING (fold))"""))
def _(spark, folder):
    return show(evaluation.effect_size(paired_folds(spark, folder)), "model", "magnitude", **num("d"))


@register("signed_rank", sql(CV_TWO, """,
d AS (SELECT fr2.mape - fr.mape AS d FROM fr JOIN fr2 USING (fold)), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS r FROM d),
w AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r),
patterns AS (SELECT bits, sum(CASE WHEN (bits >> (r.r - 1)::INTEGER) & 1 = 1 THEN r.r ELSE 0 END) AS s FROM range(4096) b(bits), r GROUP BY 1)
SELECT 'naive_ma30' AS model, 12 AS folds, w::DOUBLE AS statistic, round((SELECT avg(CASE WHEN s >= w THEN 1.0 ELSE 0.0 END) FROM patterns), 6) AS p_value FROM w"""))
def _(spark, folder):
    out = evaluation.signed_rank(paired_folds(spark, folder))
    return out.select("model", "folds", "statistic", F.round("p_value", 6).alias("p_value"))


BENCHMARK_MODELS = tuple(registry.available_models())


@register("benchmark_table")
def _(spark, folder):
    return evaluation.benchmark_table(evaluation.fold_errors(base.brand_demand(spark, folder), BENCHMARK_MODELS))


@register("champion_gate", sql(CV_TWO, """, t AS (SELECT 'naive_ma30' AS model, avg(mape) AS m FROM fr UNION ALL SELECT 'naive_ma7', avg(mape) FROM fr2)
SELECT arg_min(model, m) AS champion, round(min(m), 4) AS mape, min(m) <= 25 AS passed FROM t"""))
def _(spark, folder):
    y = base.brand_demand(spark, folder)
    parts = [
        evaluation.walk_forward(y, m).select(F.lit(n).alias("model"), "fold", "mape")
        for n, m in (("naive_ma30", closed_form.naive), ("naive_ma7", short_naive))
    ]
    table = evaluation.mean_interval(parts[0].unionByName(parts[1])).withColumnRenamed("mean", "mape_mean")
    return show(evaluation.champion(table), "champion", "passed", **num("mape"))


@register("threshold_sensitivity")
def _(spark, folder):
    return show(evaluation.threshold_sensitivity(base.brand_demand(spark, folder)), "threshold_days", "folds", **num("mape"))


@register("ablation")
def _(spark, folder):
    return evaluation.ablation(base.brand_demand(spark, folder))


@register("promotion_error_slices", sql(CV, """, pr AS (SELECT p_brand AS unique_id, CAST(l_shipdate AS DATE) AS ds, round(avg(l_discount), 6) > 0.05 AS promo
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT CASE WHEN promo THEN 'promotion' ELSE 'regular' END AS slice, count(*) AS n, round(avg(abs((y - y_hat) / y)) FILTER (y > 0) * 100, 4) AS mape,
  round(avg(abs(y - y_hat)), 4) AS mae FROM err JOIN pr USING (unique_id, ds) GROUP BY 1"""))
def _(spark, folder):
    lines = feeds.table(spark, folder, "lineitem").select("l_partkey", "l_discount", feeds.ship_day(F.col("l_shipdate")).alias("ds"))
    brands = feeds.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("unique_id"))
    promo = lines.join(brands, "l_partkey").groupBy("unique_id", "ds").agg((F.round(F.avg("l_discount"), 6) > 0.05).alias("promo"))
    errors = naive_errors(spark, folder).join(promo, ["unique_id", "ds"])
    out = evaluation.error_slices(errors, F.when(F.col("promo"), "promotion").otherwise("regular"), "slice")
    return show(out, "slice", "n", **num("mape", "mae"))


# ---- hierarchy -------------------------------------------------------------------------------------------------

ROLL = """
SELECT CASE gid WHEN 7 THEN 'national' WHEN 3 THEN 'warehouse' WHEN 1 THEN 'category' ELSE 'sku' END AS level,
  CASE gid WHEN 7 THEN 'Total' WHEN 3 THEN warehouse WHEN 1 THEN node ELSE unique_id END AS unique_id, ds, v FROM (
  SELECT ds, warehouse, node, unique_id, grouping(ds, warehouse, node, unique_id) AS gid, sum({v}) AS v
  FROM (SELECT *, warehouse || '/' || category || '/' || subcategory AS node FROM {t})
  GROUP BY GROUPING SETS ((ds), (ds, warehouse), (ds, warehouse, node), (ds, warehouse, node, unique_id)))"""


@register("hierarchy_nodes", sql(SKU, """, s AS (SELECT DISTINCT unique_id, warehouse, category, subcategory FROM facts)
SELECT 'national' AS level, 'Total' AS node_id, unique_id FROM s UNION ALL SELECT 'warehouse', warehouse, unique_id FROM s
UNION ALL SELECT 'category', warehouse || '/' || category || '/' || subcategory, unique_id FROM s UNION ALL SELECT 'sku', unique_id, unique_id FROM s"""))
def _(spark, folder):
    return hierarchy.nodes(feeds.static_of(base.sku_facts(spark, folder)))


@register("hierarchy_levels", sql(SKU, f"SELECT level, unique_id, {DS}, v AS y FROM ({ROLL.format(v='y', t='facts')})"))
def _(spark, folder):
    facts = base.sku_facts(spark, folder)
    return hierarchy.aggregate_levels(feeds.demand_of(facts), feeds.static_of(facts)).select("level", "unique_id", day(), "y")


@register("hierarchy_coherence", sql(SKU, """SELECT strftime(ds, '%Y-%m-%d') AS ds, round(n, 2) AS national, round(w, 2) AS warehouses, abs(n - w) <= 0.01 AS coherent
FROM (SELECT CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
JOIN (SELECT ds, sum(v) AS w FROM (SELECT ds, warehouse, sum(y) AS v FROM facts GROUP BY 1, 2) GROUP BY 1) USING (ds)"""))
def _(spark, folder):
    facts = base.sku_facts(spark, folder)
    out = hierarchy.coherence(hierarchy.roll_up(facts))
    return out.select(day(), F.round("national", 2).alias("national"), F.round("warehouses", 2).alias("warehouses"), "coherent")


CUT = "2001-10-01"


def base_forecasts(spark, folder):
    """Naive forecasts of every node from history before the cut, with the level of each node."""
    rolled = base.pinned(spark, folder, "rolled", lambda: hierarchy.roll_up(spine_with_path(spark, folder)))
    history = rolled.where(F.col("ds") < F.lit(CUT))
    return closed_form.naive(history, HORIZON, ["level", "unique_id"]), rolled


def spine_with_path(spark, folder):
    static = feeds.static_of(base.sku_facts(spark, folder))
    span = base.sku_daily(spark, folder)
    # Every series runs to the last day before the cut, so that all forecasts cover the same days.
    last = F.date_sub(F.lit(CUT).cast("date"), 1)
    ends = span.groupBy("unique_id").agg(F.max("ds").alias("b")).where(F.col("b") < last)
    extra = ends.select("unique_id", F.explode(F.sequence(F.date_add("b", 1), last)).alias("ds"), F.lit(0.0).alias("y"))
    return span.unionByName(extra).join(static, "unique_id")


NODES = SKU_DAILY + f""",
s AS (SELECT DISTINCT unique_id, warehouse, category, subcategory FROM facts),
ext AS (SELECT unique_id, ds, y FROM y UNION ALL SELECT unique_id, unnest(generate_series(b + INTERVAL 1 DAY, DATE '{CUT}' - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE, 0.0
  FROM (SELECT unique_id, max(ds) AS b FROM y GROUP BY 1) WHERE b < DATE '{CUT}' - 1),
leaf AS (SELECT ext.*, warehouse, category, subcategory FROM ext JOIN s USING (unique_id)),
rolled AS ({ROLL.format(v='y', t='leaf')}),
fit AS (SELECT level, unique_id, avg(v) AS m, var_pop(v) AS var, max(ds) AS last_ds FROM (SELECT *, row_number() OVER (PARTITION BY level, unique_id ORDER BY ds DESC) AS rn
  FROM rolled WHERE ds < DATE '{CUT}') WHERE rn <= 30 GROUP BY 1, 2),
bf AS (SELECT level, unique_id, last_ds + k::INTEGER AS ds, greatest(m, 0) AS y_hat FROM fit, range(1, 15) r(k))"""


@register("hierarchy_base_forecasts", sql(NODES, f"SELECT level, unique_id, {DS}, round(y_hat, 4) AS y_hat FROM bf"))
def _(spark, folder):
    return base_forecasts(spark, folder)[0].select("level", "unique_id", day(), F.round("y_hat", 4).alias("y_hat"))


BU = NODES + """,
bus AS (SELECT s.*, ds, y_hat FROM bf JOIN s USING (unique_id) WHERE level = 'sku'),
bu AS (SELECT level, unique_id, ds, greatest(v, 0) AS y_hat_reconciled FROM (""" + ROLL.format(v="y_hat", t="bus") + "))"


@register("reconcile_bottom_up", sql(BU, f"SELECT level, unique_id, {DS}, round(y_hat_reconciled, 4) AS y_hat_reconciled FROM bu"))
def _(spark, folder):
    forecasts, _ = base_forecasts(spark, folder)
    out = hierarchy.reconcile(forecasts, feeds.static_of(base.sku_facts(spark, folder)), "bottom_up")
    return out.select("level", "unique_id", day(), F.round("y_hat_reconciled", 4).alias("y_hat_reconciled"))


OLS = BU + """,
o0 AS (SELECT s.*, s.warehouse || '/' || s.category || '/' || s.subcategory AS node, k.ds, 1.0::DOUBLE AS a,
  k.y_hat + c.y_hat + w.y_hat + n.y_hat AS b FROM s JOIN bf k ON k.level = 'sku' AND k.unique_id = s.unique_id
  JOIN bf c ON c.level = 'category' AND c.ds = k.ds AND c.unique_id = s.warehouse || '/' || s.category || '/' || s.subcategory
  JOIN bf w ON w.level = 'warehouse' AND w.ds = k.ds AND w.unique_id = s.warehouse JOIN bf n ON n.level = 'national' AND n.ds = k.ds),
o1 AS (SELECT * REPLACE (b - a * sum(b) OVER g / (1 + sum(a) OVER g) AS b, a - a * sum(a) OVER g / (1 + sum(a) OVER g) AS a) FROM o0 WINDOW g AS (PARTITION BY ds, node)),
o2 AS (SELECT * REPLACE (b - a * sum(b) OVER g / (1 + sum(a) OVER g) AS b, a - a * sum(a) OVER g / (1 + sum(a) OVER g) AS a) FROM o1 WINDOW g AS (PARTITION BY ds, warehouse)),
o3 AS (SELECT unique_id, warehouse, category, subcategory, ds, b - a * sum(b) OVER g / (1 + sum(a) OVER g) AS y_hat FROM o2 WINDOW g AS (PARTITION BY ds)),
ols AS (SELECT level, unique_id, ds, greatest(v, 0) AS y_hat_reconciled FROM (""" + ROLL.format(v="y_hat", t="o3") + "))"


@register("reconcile_least_squares", sql(OLS, f"SELECT level, unique_id, {DS}, round(y_hat_reconciled, 4) AS y_hat_reconciled FROM ols"))
def _(spark, folder):
    forecasts, _ = base_forecasts(spark, folder)
    out = hierarchy.reconcile(forecasts, feeds.static_of(base.sku_facts(spark, folder)), "mint_ols")
    return out.select("level", "unique_id", day(), tidy(F.col("y_hat_reconciled")).alias("y_hat_reconciled"))


@register("reconcile_weighted")
def _(spark, folder):
    forecasts, rolled = base_forecasts(spark, folder)
    recent = closed_form.positions(rolled.where(F.col("ds") < F.lit(CUT)), ["level", "unique_id"]).where("back < 30")
    weights = recent.groupBy("level", "unique_id").agg(F.var_pop("y").alias("variance"))
    out = hierarchy.reconcile(forecasts, feeds.static_of(base.sku_facts(spark, folder)), "mint_wls", weights)
    return out.select("level", "unique_id", day(), tidy(F.col("y_hat_reconciled")).alias("y_hat_reconciled"))


@register("reconcile_comparison", sql(OLS, """,
e1 AS (SELECT avg(abs((v - y_hat_reconciled) / v)) FILTER (v > 0) * 100 AS m FROM rolled JOIN bu USING (unique_id, ds)),
e2 AS (SELECT avg(abs((v - y_hat_reconciled) / v)) FILTER (v > 0) * 100 AS m FROM rolled JOIN ols USING (unique_id, ds))
SELECT round(e1.m, 4) AS mape_bottom_up, round(e2.m, 4) AS mape_least_squares, round((e1.m - e2.m) / e1.m * 100, 4) AS improvement_pct,
  (e1.m - e2.m) / e1.m * 100 >= 8 AS target_met FROM e1, e2"""))
def _(spark, folder):
    forecasts, rolled = base_forecasts(spark, folder)
    static = feeds.static_of(base.sku_facts(spark, folder))
    out = hierarchy.compare_methods(
        rolled.select("unique_id", "ds", "y"), hierarchy.reconcile(forecasts, static, "bottom_up"), hierarchy.reconcile(forecasts, static)
    )
    return show(out, "target_met", **num("mape_bottom_up", "mape_least_squares", "improvement_pct"))


@register("warehouse_error_slices", sql(NODES, """, e AS (SELECT s.warehouse, v AS y, y_hat FROM rolled JOIN bf USING (level, unique_id, ds) JOIN s USING (unique_id) WHERE level = 'sku')
SELECT warehouse, count(*) AS n, round(avg(abs((y - y_hat) / y)) FILTER (y > 0) * 100, 4) AS mape, round(sqrt(avg((y - y_hat) * (y - y_hat))), 4) AS rmse, round(avg(abs(y - y_hat)), 4) AS mae FROM e GROUP BY 1"""))
def _(spark, folder):
    forecasts, rolled = base_forecasts(spark, folder)
    errors = rolled.join(forecasts, ["level", "unique_id", "ds"]).where("level = 'sku'").join(
        feeds.static_of(base.sku_facts(spark, folder)), "unique_id"
    )
    return show(evaluation.error_slices(errors, F.col("warehouse"), "warehouse"), "warehouse", "n", **num("mape", "rmse", "mae"))


@register("history_error_slices", sql(CV, """, h AS (SELECT fold, unique_id, count(*) AS days FROM y JOIN folds ON ds <= train_end GROUP BY 1, 2)
SELECT CASE WHEN days < 1000 THEN 'short' ELSE 'long' END AS history, count(*) AS n, round(avg(abs((y - y_hat) / y)) FILTER (y > 0) * 100, 4) AS mape,
  round(avg(abs(y - y_hat)), 4) AS mae FROM err JOIN h USING (fold, unique_id) GROUP BY 1"""))
def _(spark, folder):
    y = base.brand_demand(spark, folder)
    fold_table = evaluation.folds(y)
    train, _ = evaluation.split(y, fold_table)
    lengths = features.series_profile(train, ["fold", "unique_id"])
    errors = evaluation.walk_forward_errors(y, closed_form.naive, fold_table).join(lengths, ["fold", "unique_id"])
    out = evaluation.error_slices(errors, F.when(F.col("n_days") < 1000, "short").otherwise("long"), "history")
    return show(out, "history", "n", **num("mape", "mae"))
