"""Files in and out: checked CSV feeds, snapshots by batch, results as JSON, newest-file choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators.etl import RAW_COLUMNS

_NUMERIC = ("Daily_Demand_Est", "Safety_Stock_Target", "Lead_Time_Days")
RAW_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in _NUMERIC else T.StringType()) for c in RAW_COLUMNS])


class FeedError(ValueError):
    """An input file cannot be used."""


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file; only its first line is read."""
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip():
        raise FeedError(f"CSV file is empty: {path}")
    return [c.strip().strip('"') for c in first[0][0].split(",")]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Dirty inventory CSV with an explicit schema, in any column order."""
    header = csv_header(spark, path)
    missing = sorted(set(RAW_COLUMNS) - set(header))
    if missing:
        raise FeedError(f"CSV missing required columns: {missing}")
    types = {f.name: f.dataType for f in RAW_SCHEMA}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if df.limit(1).count() == 0:
        raise FeedError(f"CSV file contains no data rows: {path}")
    return df


def looks_like_csv(spark: SparkSession, path: str) -> bool:
    """At least two columns and one row."""
    head = spark.read.text(path).limit(2).collect()
    return len(head) == 2 and head[0][0].count(",") >= 1


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def newest_file(spark: SparkSession, folder: str, pattern: str = "*[dD]irty*.csv") -> DataFrame:
    """Path of the file changed last, then by name, among those that match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", F.lower("path"))).alias("path"))


def append_snapshot(clean: DataFrame, path: str, batch_id: str) -> None:
    """Store a clean snapshot under its batch; writing the same batch again replaces it."""
    tagged = clean.withColumn("ingested_at", F.current_timestamp())
    tagged.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_result(row: DataFrame, path: str, batch_id: str, kind: str) -> None:
    """Store an analysis result as one JSON document."""
    doc = row.select(F.to_json(F.struct("*")).alias("result_json"), F.current_timestamp().alias("created_at"))
    doc.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/analysis_type={kind}")
