"""Registered queries: learning on the inventory snapshot, with the library's presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.learning import anomaly, classify, cluster, multipliers, neighbours, prepare, reduce, regress
from shelfcast.plans import base
from shelfcast.plans.base import CLEAN, ENRICHED, Query, sql
from shelfcast.session import pin

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def encoded(spark, folder):
    return base.pinned(spark, folder, "encoded", lambda: prepare.encode(base.clean(spark, folder)))


def class_rows(spark, folder):
    rows = prepare.frame(encoded(spark, folder), prepare.CLASSIFICATION_FEATURES, "Stock_Status_Enc")
    train, test = prepare.stratified_split(rows)
    marked = base.pinned(spark, folder, "class-rows", lambda: train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True))))
    return marked.where(~F.col("held_out")).drop("held_out"), marked.where("held_out").drop("held_out")


def points(spark, folder):
    rows = prepare.frame(encoded(spark, folder), prepare.REGRESSION_FEATURES, "Stock_Status_Enc")
    return base.pinned(spark, folder, "points", lambda: prepare.scaled(None).fit(rows).transform(rows))


FRACTION = "('0x' || substr(md5('42|' || Product_ID), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
COMPLETE = """full_rows AS (SELECT * FROM enriched WHERE Unit_Cost IS NOT NULL AND Daily_Demand_Est IS NOT NULL AND Safety_Stock_Target IS NOT NULL
  AND Lead_Time_Days IS NOT NULL AND Demand_Intensity IS NOT NULL),
sized AS (SELECT *, {f} AS part, row_number() OVER (PARTITION BY Stock_Status ORDER BY {f}, Product_ID) AS rk, count(*) OVER (PARTITION BY Stock_Status) AS size FROM full_rows),
split AS (SELECT *, CASE WHEN (SELECT min(size) FROM sized) >= 5 THEN rk <= round(size * 0.2::DOUBLE) ELSE part < 0.2 END AS is_test FROM sized)"""
COMPLETE = COMPLETE.replace("{f}", FRACTION)


ENCODINGS = """(dense_rank() OVER (ORDER BY coalesce(Category, 'nan')) - 1)::DOUBLE AS Category_Enc,
(dense_rank() OVER (ORDER BY coalesce(Vendor_Name, 'nan')) - 1)::DOUBLE AS Vendor_Enc, (dense_rank() OVER (ORDER BY Stock_Status) - 1)::DOUBLE AS Stock_Status_Enc"""
FEATURES = prepare.CLASSIFICATION_FEATURES
# Seven nearest training rows of every test row, by brute force over standardised features.
NEIGHBOURS = f"""enc AS (SELECT *, {ENCODINGS} FROM enriched),
{COMPLETE.replace("FROM enriched", "FROM enc")},
st AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(FEATURES))} FROM split WHERE NOT is_test),
z AS (SELECT Product_ID, is_test, Stock_Status_Enc AS label, [{", ".join(f"(({c} - m{i}) / s{i})::DOUBLE" for i, c in enumerate(FEATURES))}] AS x FROM split, st),
d AS (SELECT q.Product_ID AS query, t.Product_ID AS neighbour, t.label, list_distance(q.x, t.x) AS distance FROM z q JOIN z t ON q.is_test AND NOT t.is_test),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS position FROM d)"""


@register("encoded_categories", sql(ENRICHED, """SELECT Product_ID, (dense_rank() OVER (ORDER BY coalesce(Category, 'nan')) - 1)::DOUBLE AS Category_Enc,
(dense_rank() OVER (ORDER BY coalesce(Vendor_Name, 'nan')) - 1)::DOUBLE AS Vendor_Enc, (dense_rank() OVER (ORDER BY Stock_Status) - 1)::DOUBLE AS Stock_Status_Enc FROM enriched"""))
def _(spark, folder):
    return prepare.encode(base.clean(spark, folder)).select("Product_ID", "Category_Enc", "Vendor_Enc", "Stock_Status_Enc")


@register("train_test_split", sql(ENRICHED + "," + COMPLETE, "SELECT Product_ID, is_test FROM split"))
def _(spark, folder):
    train, test = class_rows(spark, folder)
    return train.select("Product_ID", F.lit(False).alias("is_test")).unionByName(test.select("Product_ID", F.lit(True).alias("is_test")))


@register("feature_scaling", sql(ENRICHED + "," + COMPLETE, f"""SELECT round(avg(Unit_Cost), 4) AS mean_cost, round(stddev_samp(Unit_Cost), 4) AS sd_cost, round(avg(Lead_Time_Days), 4) AS mean_lead,
round(stddev_samp(Lead_Time_Days), 4) AS sd_lead FROM split WHERE NOT is_test"""))
def _(spark, folder):
    train, _ = class_rows(spark, folder)
    scaler = prepare.scaled(None).fit(train).stages[0]
    mean, sd = scaler.mean.toArray(), scaler.std.toArray()
    return spark.createDataFrame(
        [(round(float(mean[0]), 4), round(float(sd[0]), 4), round(float(mean[4]), 4), round(float(sd[4]), 4))],
        "mean_cost double, sd_cost double, mean_lead double, sd_lead double",
    )


def class_predictions(spark, folder):
    """Test predictions of all nine models, fitted once for accuracy and confusion."""
    return base.pinned(spark, folder, "class-predictions", lambda: classify.predictions(*class_rows(spark, folder), classify.classifiers()))


@register("classifier_accuracy")
def _(spark, folder):
    return classify.accuracies(class_predictions(spark, folder))


@register("classifier_cross_validation")
def _(spark, folder):
    train, _ = class_rows(spark, folder)
    return classify.cross_validate(train, classify.classifiers())


@register("classifier_confusion")
def _(spark, folder):
    predicted = class_predictions(spark, folder)
    three = classify.accuracies(predicted).orderBy(F.col("accuracy").desc(), "model").limit(3).select("model")
    return classify.confusion(predicted.join(F.broadcast(three), "model"), ["model"])


@register("classifier_importances")
def _(spark, folder):
    train, _ = class_rows(spark, folder)
    models, out = classify.classifiers(), None
    rows = pin(prepare.scaled(None).fit(train).transform(train).select("features", "label"), "scaled")
    for name in ("Random Forest", "Gradient Boosting", "Decision Tree", "Logistic Regression"):
        part = classify.importances(models[name].fit(rows), spark).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("boosted_stumps")
def _(spark, folder):
    train, test = class_rows(spark, folder)
    scaler = prepare.scaled(None).fit(train)
    model = classify.SteppedTrees().fit(scaler.transform(train))
    return classify.confusion(model.transform(scaler.transform(test)))


@register("nearest_neighbours", sql(ENRICHED + "," + NEIGHBOURS, "SELECT query, neighbour, label, round(distance, 6) AS distance, position FROM r WHERE position <= 7"))
def _(spark, folder):
    train, test = class_rows(spark, folder)
    scaler = prepare.scaled(None).fit(train)
    found = neighbours.nearest_of_all(scaler.transform(train), scaler.transform(test))
    return found.withColumn("distance", F.round("distance", 6))


@register("nearest_neighbour_votes", sql(ENRICHED + "," + NEIGHBOURS, """,
v AS (SELECT query, label AS choice, count(*) AS n FROM r WHERE position <= 7 GROUP BY 1, 2),
b AS (SELECT query, choice AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, choice) = 1),
c AS (SELECT label, prediction, count(*) AS n FROM b JOIN z ON query = Product_ID GROUP BY 1, 2)
SELECT label, prediction, n, round(n / sum(n) OVER (PARTITION BY label) * 100, 6) AS row_pct FROM c"""))
def _(spark, folder):
    train, test = class_rows(spark, folder)
    scaler = prepare.scaled(None).fit(train)
    found = neighbours.nearest_of_all(scaler.transform(train), scaler.transform(test))
    return classify.confusion(neighbours.vote(found, test)).withColumn("row_pct", F.round("row_pct", 6))


def value_predictions(spark, folder):
    rows = prepare.frame(encoded(spark, folder), prepare.REGRESSION_FEATURES, "Inventory_Value")
    return regress.predictions(*prepare.train_test(rows), regress.regressors())


@register("regression_scores")
def _(spark, folder):
    return regress.compare(value_predictions(spark, folder))


@register("regression_residuals")
def _(spark, folder):
    predicted = value_predictions(spark, folder)
    return regress.residual_summary(predicted[regress.best(regress.compare(predicted))])


@register("kmeans_search")
def _(spark, folder):
    return cluster.kmeans_search(points(spark, folder))


@register("kmeans_status")
def _(spark, folder):
    return cluster.status_by_cluster(cluster.kmeans_labels(points(spark, folder), 3))


@register("kmeans_profiles")
def _(spark, folder):
    return cluster.profiles(cluster.kmeans_labels(points(spark, folder), 3), prepare.REGRESSION_FEATURES)


@register("hierarchical_clusters")
def _(spark, folder):
    return cluster.status_by_cluster(cluster.hierarchical_labels(points(spark, folder), 3))


@register("density_clusters")
def _(spark, folder):
    return cluster.cluster_counts(cluster.density_clusters(points(spark, folder)))


@register("pca_variance")
def _(spark, folder):
    return reduce.explained(points(spark, folder))


@register("pca_loadings")
def _(spark, folder):
    return reduce.loadings(points(spark, folder))


@register("anomaly_flags")
def _(spark, folder):
    train, test = prepare.train_test(points(spark, folder))
    return anomaly.detect(train, test)


@register("anomaly_agreement")
def _(spark, folder):
    train, test = prepare.train_test(points(spark, folder))
    return anomaly.agreement(anomaly.detect(train, test))


@register("anomaly_feature_ratios")
def _(spark, folder):
    train, test = prepare.train_test(points(spark, folder))
    flagged = anomaly.flag_top(reduce.reconstruction_error(reduce.fit(train, 6), test), "error", 0.05, "is_unusual")
    return anomaly.feature_ratios(flagged, "is_unusual", prepare.REGRESSION_FEATURES)


MEANS = CLEAN + """,
m AS (SELECT Category, avg(Daily_Demand_Est) AS d, avg(Unit_Cost) AS c, avg(Safety_Stock_Target) AS s, avg(Lead_Time_Days) AS l, count(*) AS n FROM clean GROUP BY 1),
b AS (SELECT *, CASE WHEN s > 0 THEN greatest(0.5, least(3.0, d * l * 0.5 / s)) ELSE 0.5 END AS k FROM m),
o AS (SELECT Category, k AS multiplier, (s * 0.25 + greatest(0, d * l * 0.5 - s) * 2) * c * n AS current_cost, (s * k * 0.25 + greatest(0, d * l * 0.5 - s * k) * 2) * c * n AS optimal_cost FROM b)"""


@register("safety_multipliers", sql(MEANS, "SELECT Category, round(multiplier, 6) AS multiplier, round(current_cost, 2) AS current_cost, round(optimal_cost, 2) AS optimal_cost FROM o"))
def _(spark, folder):
    out = multipliers.best_multipliers(multipliers.category_means(base.clean(spark, folder)))
    return out.select("Category", F.round("multiplier", 6).alias("multiplier"), F.round("current_cost", 2).alias("current_cost"), F.round("optimal_cost", 2).alias("optimal_cost"))


@register("safety_multiplier_grid", sql(MEANS, """SELECT Category, round(arg_min(k, (c, k)), 4) AS multiplier, round(min(c), 2) AS optimal_cost FROM (
SELECT Category, 0.5::DOUBLE + i * (2.5::DOUBLE / 250) AS k, (s * (0.5::DOUBLE + i * (2.5::DOUBLE / 250)) * 0.25 + greatest(0, d * l * 0.5 - s * (0.5::DOUBLE + i * (2.5::DOUBLE / 250))) * 2) * c * n AS c FROM m, range(251) r(i)) GROUP BY 1"""))
def _(spark, folder):
    out = multipliers.grid_multipliers(multipliers.category_means(base.clean(spark, folder)))
    return out.select("Category", F.round("multiplier", 4).alias("multiplier"), F.round("optimal_cost", 2).alias("optimal_cost"))


@register("safety_savings", sql(MEANS, """SELECT round(sum(current_cost), 2) AS current_cost, round(sum(optimal_cost), 2) AS optimal_cost, round(sum(current_cost) - sum(optimal_cost), 2) AS savings,
round((sum(current_cost) - sum(optimal_cost)) / sum(current_cost) * 100, 4) AS savings_pct FROM o"""))
def _(spark, folder):
    out = multipliers.savings(multipliers.best_multipliers(multipliers.category_means(base.clean(spark, folder))))
    money = [F.round(c, 2).alias(c) for c in ("current_cost", "optimal_cost", "savings")]
    return out.select(*money, F.round("savings_pct", 4).alias("savings_pct"))
