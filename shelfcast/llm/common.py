"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and a word, as the contracts spell them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def without_spaces(text: Column) -> Column:
    """``text`` without any character of ``SPACES``."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def small_batches(df: DataFrame, most: int = 1000, most_bytes: int = 1 << 20) -> DataFrame:
    """``df``, after bounding how many rows and bytes its session hands to Python at a time: texts can be long.

    An executor keeps the off-heap buffers of its largest batches. The settings stay for later queries of the session, where
    they change no result; smaller ones are left as they are.
    """
    conf, sizes = df.sparkSession.conf, df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    for name, bound in (("maxRecordsPerBatch", most), ("maxBytesPerBatch", most_bytes)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < sizes.byteStringAsBytes(conf.get(name)) <= bound:
            conf.set(name, str(bound))
    return df


def boxed(df: DataFrame, *extra: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside computed columns, so no column name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *extra)


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], share: int = 1000, salts: int = 64, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side`` on equal ``on`` (nulls equal), where one key may hold most of ``rows``.

    Keys with more than one in ``share`` of all rows are fewer than ``share``, so their list is broadcast; their rows are
    dealt over ``salts`` numbers and their rows of ``side`` repeated for each. ``rows`` is read twice and must be stable
    (a pinned table or a plain scan). ``how`` is inner or left.
    """
    spark = rows.sparkSession
    most = max(rows.count() // share, salts)
    hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).limit(share).collect()
    if not hot:
        salted, dealt = rows.withColumn("__salt", F.lit(0)), side.withColumn("__salt", F.lit(0))
    else:
        few = spark.createDataFrame([tuple(r[c] for c in on) + (True,) for r in hot], rows.select(*on).withColumn("__hot", F.lit(True)).schema)
        salt = F.when(F.col("__hot"), F.floor(F.rand(7) * salts).cast("int")).otherwise(0)
        salted = _mark(rows, few, on).withColumn("__salt", salt).drop("__hot")
        each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        dealt = _mark(side, few, on).withColumn("__salt", F.explode(each)).drop("__hot")
    right = dealt.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("__salt").alias("__dealt"), *[c for c in side.columns if c not in on])
    same = F.col("__salt") == F.col("__dealt")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return salted.join(right, same, how).drop("__salt", "__dealt", *[f"__{c}" for c in on])


def _mark(df: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    few = few.select(*[F.col(c).alias(f"__{c}") for c in on], "__hot")
    same = F.lit(True)
    for c in on:
        same = same & df[c].eqNullSafe(few[f"__{c}"])
    return df.join(F.broadcast(few), same, "left").drop(*[f"__{c}" for c in on])


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls equal; the columns of ``on`` appear once."""
    side = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(side, same, how).drop(*[f"__{c}" for c in on])
