"""Descriptive statistics and hypothesis tests as aggregations over value counts and moments."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.normal import normal_quantile
from shelfcast.functions.numeric import equal_width_bin, finite, hits
from shelfcast.functions.tails import as_udf, chi2_upper, correlation_p, f_upper, t_quantile
from shelfcast.operators.scale import attach, exact_quantiles, mid_ranks, running_totals, scalars, value_counts

# The columns of the correlation view.
CORRELATION_COLUMNS = (
    "Unit_Cost", "Current_Stock", "Daily_Demand_Est", "Safety_Stock_Target", "Lead_Time_Days",
    "Reorder_Point", "Inventory_Value", "DSI", "Stock_Coverage_Ratio", "Supply_Risk_Score",
)
SUMMARY_COLUMNS = ("Unit_Cost", "Current_Stock", "Daily_Demand_Est", "Lead_Time_Days", "Inventory_Value", "DSI")


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed column is a finite number."""
    return df.select(*[finite(F.col(c)).alias(c) for c in columns]).dropna()


def pearson_pairs(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Pearson r of each column pair in one aggregation."""
    pairs = list(combinations(columns, 2))
    data = complete(df, columns)
    row = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(a, b).alias("r")) for a, b in pairs
        ]).alias("cells"),
    )
    return row.select("n", F.explode("cells").alias("c")).select("c.left", "c.right", "n", "c.r")


def pearson_p_values(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p_value", as_udf(correlation_p)(F.col("r"), F.col("n").cast("double")))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Full population matrix, 1 on the diagonal and 0 where a column is constant."""
    data = complete(df, columns)
    cells = [
        F.struct(
            F.lit(a).alias("left"), F.lit(b).alias("right"),
            (F.lit(1.0) if a == b else F.coalesce(F.nanvl(F.corr(a, b), F.lit(None).cast("double")), F.lit(0.0))).alias("r"),
        )
        for a in columns for b in columns
    ]
    return data.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def spearman_matrix(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Rank correlation of each column pair (MLlib ranks with a distributed sort)."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(complete(df, columns)).select("v")
    matrix = Correlation.corr(vectors, "v", "spearman").head()[0].toArray()
    rows = [
        (a, b, float(matrix[i][j]))
        for (i, a), (j, b) in combinations(list(enumerate(columns)), 2)
    ]
    return df.sparkSession.createDataFrame(rows, "left string, right string, rho double")


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r and Spearman rho of one pair; ranks come from value counts, so ties cost one row each."""
    data = complete(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), ["x", "y"])
    pairs = data.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    rank_x = mid_ranks(value_counts(data, F.col("x"))).select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    rank_y = mid_ranks(value_counts(data, F.col("y"))).select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    ranked = attach(attach(pairs, rank_x, ["x"]), rank_y, ["y"])
    m = ranked.agg(
        F.sum("w").alias("n"),
        *[
            F.sum(F.col("w") * e).alias(name)
            for name, e in {
                "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"),
                "sxy": F.col("x") * F.col("y"), "rx": F.col("rx"), "ry": F.col("ry"), "rxx": F.col("rx") * F.col("rx"),
                "ryy": F.col("ry") * F.col("ry"), "rxy": F.col("rx") * F.col("ry"),
            }.items()
        ],
    )

    def corr(sx, sy, sxx, syy, sxy) -> Column:
        n = F.col("n")
        return (n * F.col(sxy) - F.col(sx) * F.col(sy)) / F.sqrt(
            (n * F.col(sxx) - F.col(sx) * F.col(sx)) * (n * F.col(syy) - F.col(sy) * F.col(sy))
        )

    return m.select(
        F.lit(x).alias("x"), F.lit(y).alias("y"), "n",
        corr("sx", "sy", "sxx", "syy", "sxy").alias("pearson"),
        corr("rx", "ry", "rxx", "ryy", "rxy").alias("spearman"),
    )


def adjusted_skew(col: str) -> Column:
    """Bias-corrected sample skewness."""
    n = F.count(col).cast("double")
    return F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurtosis(col: str) -> Column:
    """Bias-corrected sample excess kurtosis."""
    n = F.count(col).cast("double")
    return ((n + 1) * F.kurtosis(col) + 6) * (n - 1) / ((n - 2) * (n - 3))


def long_values(df: DataFrame, columns: Sequence[str], drop_dsi_sentinel: bool = True) -> DataFrame:
    """(metric, value) rows of the listed columns, finite only; the DSI sentinel is not a value."""
    wide = df.select(*[finite(F.col(c)).alias(c) for c in columns])
    out = wide.unpivot([], list(columns), "metric", "value").where("value is not null")
    return out.where("metric <> 'DSI' or value < 999") if drop_dsi_sentinel else out


def distribution_summary(df: DataFrame, columns: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    """Moments per metric with the Jarque-Bera statistic."""
    moments = long_values(df, columns).groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        adjusted_skew("value").alias("skew"), adjusted_kurtosis("value").alias("kurt"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    jb = F.col("n") / 6.0 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4.0)
    return moments.withColumn("jarque_bera", jb).drop("g1", "g2")


def normality(summary: DataFrame) -> DataFrame:
    p = F.exp(-F.col("jarque_bera") / 2)
    return summary.withColumn("p_value", p).withColumn("is_normal", p > 0.05)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts and densities of equal-width bins over the range of the data."""
    data = df.select(finite(value).alias("v")).where("v is not null")
    ends = scalars(data, lo=F.min("v"), hi=F.max("v"), n=F.count("v"))
    width = (ends["hi"] - ends["lo"]) / float(bins)
    return (
        data.select(equal_width_bin(F.col("v"), ends["lo"], ends["hi"], bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (ends["lo"] + F.col("bin") * width).alias("low"), "n", (F.col("n") / ends["n"] / width).alias("density"))
    )


def density_curve(df: DataFrame, value: Column, points: int = 300) -> DataFrame:
    """Gaussian kernel density on an even grid (Scott bandwidth). Partial aggregation keeps one row per grid point."""
    counts = value_counts(df, finite(value))
    ends = scalars(counts, lo=F.min("value"), hi=F.max("value"), n=F.sum("n"),
                   s1=F.sum(F.col("value") * F.col("n")), s2=F.sum(F.col("value") * F.col("value") * F.col("n")))
    n = ends["n"].cast("double")
    sd = F.sqrt((ends["s2"] - ends["s1"] * ends["s1"] / n) / (n - 1))
    width = sd * F.pow(n, F.lit(-0.2))
    grid = counts.select("value", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
    x = ends["lo"] + F.col("step") * (ends["hi"] - ends["lo"]) / (points - 1)
    z = (x - F.col("value")) / width
    return grid.groupBy("step").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("k")).select(
        "step", x.alias("x"), (F.col("k") / (n * width * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density")
    )


def quantile_pairs(df: DataFrame, value: Column) -> DataFrame:
    """Normal quantile against each distinct value (Filliben positions at the middle of its ties)."""
    counts = value_counts(df, finite(value))
    ranked = mid_ranks(counts)
    n = scalars(counts, n=F.sum("n"))["n"].cast("double")
    last = F.pow(F.lit(0.5), 1 / n)
    position = (
        F.when(F.col("rank") == 1, 1 - last).when(F.col("rank") == n, last).otherwise((F.col("rank") - 0.3175) / (n + 0.365))
    )
    return ranked.select("value", F.col("n"), "rank", normal_quantile(position).alias("theoretical"))


def one_way_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between and within group mean squares and their F."""
    g = df.select(F.col(group).alias("g"), finite(F.col(value)).alias("v")).dropna().groupBy("g").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")
    )
    whole = scalars(g, n=F.sum("n"), m=F.sum(F.col("n") * F.col("m")) / F.sum("n"))
    row = g.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - whole["m"], 2)).alias("between"),
        F.sum(F.col("n") * F.col("s")).alias("within"),
    )
    return row.select(
        F.lit(value).alias("metric"), "groups", "n",
        ((F.col("between") / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))).alias("f"),
    )


def anova_p(row: DataFrame) -> DataFrame:
    p = as_udf(f_upper)(F.col("f"), (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double"))
    return row.withColumn("p_value", p)


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tie-corrected H from group rank sums. Ranks are made on distinct values and joined to (group, value) counts."""
    cells = value_counts(df.select(F.col(group).alias("g"), F.col(value)).where("g is not null"), finite(F.col(value)), by=["g"])
    values = cells.groupBy("value").agg(F.sum("n").alias("n"))
    ranks = mid_ranks(values).select("value", "rank")
    sums = attach(cells, ranks, ["value"]).groupBy("g").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r")
    )
    ties = scalars(values, t=F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")))["t"]
    row = sums.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")
    )
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return row.select(F.lit(value).alias("metric"), "groups", "n", (h / (1 - ties / (n * n * n - n))).alias("h"))


def kruskal_p(row: DataFrame) -> DataFrame:
    return row.withColumn("p_value", as_udf(chi2_upper)(F.col("h"), (F.col("groups") - 1).cast("double")))


def chi_square(df: DataFrame, left: str, right: str) -> DataFrame:
    """Independence of two categorical columns, from their contingency counts."""
    cells = df.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna().groupBy("a", "b").agg(
        F.count(F.lit(1)).cast("double").alias("o")
    )
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    n = scalars(cells, n=F.sum("o"))["n"]
    # Sum over all cells of o^2/e - n; empty cells add nothing, so the full grid is never built.
    seen = cells.join(rows, "a").join(cols, "b")
    dof = scalars(rows, k=F.count(F.lit(1)))["k"] - 1, scalars(cols, k=F.count(F.lit(1)))["k"] - 1
    return seen.agg(F.sum(F.col("o") * F.col("o") * n / (F.col("ra") * F.col("cb"))).alias("s")).select(
        (F.col("s") - n).alias("chi2"), (dof[0] * dof[1]).alias("dof")
    )


def chi_square_p(row: DataFrame) -> DataFrame:
    return row.withColumn("p_value", as_udf(chi2_upper)(F.col("chi2"), F.col("dof").cast("double")))


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, R squared and standard error of a straight line."""
    data = complete(df.select(F.col(x).alias("x"), F.col(y).alias("y")), ["x", "y"])
    row = data.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
        F.avg("x").alias("x_mean"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    )
    err = F.sqrt((1 - F.col("r2")) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    return row.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "slope", "intercept", "r2", err.alias("std_err"), "sxx", "x_mean", "x_min", "x_max")


def ols_band(line: DataFrame, points: int = 100) -> DataFrame:
    """Fitted mean with its 95 % band on an even grid."""
    t = as_udf(t_quantile)(F.lit(0.975), (F.col("n") - 2).cast("double"))
    grid = line.withColumn("t", t).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
    at = F.col("x_min") + F.col("step") * (F.col("x_max") - F.col("x_min")) / (points - 1)
    grid = grid.withColumn("at", at)
    fit = F.col("slope") * F.col("at") + F.col("intercept")
    residual = F.col("std_err") * F.sqrt("sxx")
    half = F.col("t") * residual * F.sqrt(1 / F.col("n") + F.pow(F.col("at") - F.col("x_mean"), 2) / F.col("sxx"))
    return grid.select("x", "y", "step", "at", fit.alias("fit"), (fit - half).alias("lo"), (fit + half).alias("hi"))


def z_outliers(df: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """Rows whose population z-score is at least ``limit`` away from zero."""
    m = scalars(df, mean=F.avg(value), sd=F.stddev_pop(value))
    z = (F.col(value) - m["mean"]) / m["sd"]
    return df.withColumn("z", z).where(F.abs("z") >= limit)


IQR_COLUMNS = ("Inventory_Value", "Current_Stock", "Daily_Demand_Est", "Unit_Cost")


def iqr_outliers(df: DataFrame, by: str = "Category", columns: Sequence[str] = IQR_COLUMNS) -> DataFrame:
    """Values outside the 1.5 IQR fences per group, summed over columns; a zero IQR flags nothing."""
    long = df.select(by, *columns).unpivot([by], list(columns), "metric", "value").where("value is not null")
    fences = exact_quantiles(long, F.col("value"), {"q1": 0.25, "q3": 0.75}, by=[by, "metric"])
    iqr = F.col("q3") - F.col("q1")
    out = (iqr > 0) & ((F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr))
    return attach(long, fences, [by, "metric"]).groupBy(by).agg(hits(out).alias("outliers"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of n rows: the smallest seeded hashes of a key."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("__h", digest).orderBy("__h", key).limit(n).drop("__h")


def five_numbers(df: DataFrame, by: str, value: str) -> DataFrame:
    """Min, lower quartile, median, upper quartile and max by floor index, with the mean, per group."""
    cells = value_counts(df.where(F.col(by).isNotNull()), F.col(value), by=[by])
    placed = running_totals(cells, [F.col("value")], {"upto": F.col("n")}, by=[by])
    sizes = cells.groupBy(by).agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("value")).alias("total"))
    at = attach(placed, sizes, [by])

    def pick(q: float) -> Column:
        rank = F.floor(F.col("size") * q) + 1
        return F.max(F.when((rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto")), F.col("value")))

    return at.groupBy(by).agg(
        F.min("value").alias("low"), pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"),
        F.max("value").alias("high"), (F.max("total") / F.max("size")).alias("mean"),
    )
