"""The distributed building blocks against brute force, with a hot group and a hot value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 60_000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdef"), n)),
        "v": np.where(rng.random(n) < 0.35, 7.0, rng.lognormal(3, 2, n).round(3)),
        "id": np.arange(n),
    })
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_running_totals(skewed):
    pdf, df = skewed
    out = scale.running_totals(df, [F.col("v").desc(), F.col("id")], {"c": F.col("v"), "k": F.lit(1)}, by=["g"]).toPandas()
    want = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True]).copy()
    want["c"], want["k"] = want.groupby("g")["v"].cumsum(), want.groupby("g").cumcount() + 1
    m = out.merge(want, on="id")
    assert len(m) == len(pdf)
    np.testing.assert_allclose(m["c_x"], m["c_y"])
    assert (m["k_x"] == m["k_y"]).all()


def test_running_totals_spread_over_slices(skewed):
    _, df = skewed
    sliced = df.repartitionByRange(8, "v", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sliced) < 0.35 * 60_000  # the hot value alone does not decide a slice


def test_global_running_total(skewed):
    pdf, df = skewed
    out = scale.running_totals(df, [F.col("id")], {"c": F.col("v")}, inclusive=False).orderBy("id").toPandas()
    np.testing.assert_allclose(out["c"], pdf["v"].cumsum() - pdf["v"], atol=1e-6)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("packed", [100_000, 0])
def test_exact_quantiles(skewed, by, packed, monkeypatch):
    monkeypatch.setattr(scale, "PACKED", packed)
    pdf, df = skewed
    probs = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}
    out = scale.exact_quantiles(df, F.col("v"), probs, by).toPandas()
    groups = pdf.groupby("g")["v"] if by else [("all", pdf["v"])]
    for name, values in groups:
        row = out[out["g"] == name].iloc[0] if by else out.iloc[0]
        for p, q in probs.items():
            assert row[p] == pytest.approx(np.quantile(values, q)), (name, p)


def test_quantiles_of_nothing(skewed):
    _, df = skewed
    assert scale.exact_quantiles(df.where("v < 0"), F.col("v"), {"m": 0.5}).head().m is None


def test_mid_ranks(skewed):
    pdf, df = skewed
    out = scale.mid_ranks(scale.value_counts(df, F.col("v"))).toPandas().set_index("value")["rank"]
    want = pdf.assign(r=pdf["v"].rank()).groupby("v")["r"].first()
    pd.testing.assert_series_equal(out.sort_index(), want, check_names=False)


def test_top_rows(skewed):
    pdf, df = skewed
    got = [r.id for r in scale.top_rows(df, [F.col("v").desc(), F.col("id")], 5).orderBy("position").collect()]
    assert got == pdf.sort_values(["v", "id"], ascending=[False, True])["id"].head(5).tolist()
