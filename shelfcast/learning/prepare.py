"""Model frames from a clean inventory snapshot: leak-free features, encoded text, repeatable splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.numeric import hash_fraction
from shelfcast.operators.inventory import enrich_base
from shelfcast.operators.scale import running_totals

# Feature lists. The classifier must not see columns that define the stock status.
CLASSIFICATION_FEATURES = (
    "Unit_Cost", "Current_Stock", "Daily_Demand_Est", "Safety_Stock_Target", "Lead_Time_Days",
    "Demand_Intensity", "Category_Enc", "Vendor_Enc",
)
REGRESSION_FEATURES = (*CLASSIFICATION_FEATURES, "Reorder_Point", "DSI", "Stock_Coverage_Ratio")
ENCODED = {"Category": "Category_Enc", "Vendor_Name": "Vendor_Enc", "Stock_Status": "Stock_Status_Enc"}


def encode(clean: DataFrame, columns: dict[str, str] = ENCODED) -> DataFrame:
    """Base columns plus text columns numbered in alphabetical order; a missing text is its own value.

    Numbers come from a distributed running count over the distinct texts, so a column with very many names (vendors)
    never passes through the driver.
    """
    out = enrich_base(clean)
    for source, target in columns.items():
        text = F.coalesce(source, F.lit("nan"))
        names = clean.select(text.alias("__text")).distinct()
        numbers = running_totals(names, [F.col("__text")], {"__n": F.lit(1)})
        numbers = numbers.select("__text", (F.col("__n") - 1).cast("double").alias(target))
        out = out.withColumn("__text", text).join(numbers, "__text", "left").drop("__text")
    return out


def frame(encoded: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Complete rows with an assembled, unscaled feature vector."""
    complete = encoded.dropna(subset=[*features, label])
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw_features")
    return assembler.transform(complete).withColumn("label", F.col(label).cast("double"))


def with_fold(df: DataFrame, key: str = "Product_ID", seed: int = 42, folds: int = 5) -> DataFrame:
    """A part in [0, 1) and a fold number per row from hashes of its key; a hash split keeps class shares in expectation."""
    return df.withColumn("part", hash_fraction(F.col(key), seed)).withColumn(
        "fold", F.floor(hash_fraction(F.col(key), seed + 1) * folds).cast("int")
    )


def train_test(df: DataFrame, test_share: float = 0.2, key: str = "Product_ID", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    parted = with_fold(df, key, seed)
    return parted.where(F.col("part") >= test_share), parted.where(F.col("part") < test_share)


def stratified_split(df: DataFrame, test_share: float = 0.2, key: str = "Product_ID", seed: int = 42, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """As ``train_test``, but every label gives its share: in each, the rows with the smallest hashes are the test rows.

    Labels keep their shares only if the rarest one has at least ``least`` rows; else the plain hash split is used. Ranks
    are running counts, so a label with most rows spreads over tasks.
    """
    parted = with_fold(df, key, seed)
    sizes = parted.groupBy("label").agg(F.count(F.lit(1)).alias("rows_of_label"))
    rarest = sizes.agg(F.min("rows_of_label")).scalar()
    ranked = running_totals(parted, [F.col("part"), F.col(key)], {"rank_in_label": F.lit(1)}, by=["label"]).join(sizes, "label")
    own_share = F.col("rank_in_label") <= F.round(F.col("rows_of_label") * F.lit(test_share))
    is_test = F.when(rarest >= least, own_share).otherwise(F.col("part") < test_share)
    marked = ranked.withColumn("is_test", is_test)
    return tuple(marked.where(side).select(*parted.columns) for side in (~F.col("is_test"), F.col("is_test")))


def scaled(stage) -> Pipeline:
    """Standardise on the training rows only, then the given estimator on ``features``."""
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, stage] if stage is not None else [scaler])
