"""A full batch: seven stages over one clean snapshot, each stored as a JSON result, progress and failure recorded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.constants import STAGES
from shelfcast.learning import classify, multipliers, prepare
from shelfcast.operators import capacity, etl, inventory, scenarios, sensing, supply
from shelfcast.session import pin
from shelfcast.sources.files import append_result, append_snapshot


def nest(df: DataFrame, name: str) -> DataFrame:
    """A small result table as one row with one array."""
    return df.agg(F.collect_list(F.struct(*df.columns)).alias(name))


def stage_functions(signals: DataFrame | None) -> dict[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    """Stage name to a function of (prepared feed, clean snapshot) giving one result row."""
    def ml(_, clean: DataFrame) -> DataFrame:
        rows = prepare.frame(prepare.encode(clean), prepare.CLASSIFICATION_FEATURES, "Stock_Status_Enc")
        train, test = prepare.stratified_split(rows)
        scores = classify.compare(train, test, classify.classifiers())
        saved = multipliers.savings(multipliers.best_multipliers(multipliers.category_means(clean)))
        return nest(scores, "classification").withColumn("savings", saved.select("savings").scalar())

    def planned(_, clean: DataFrame) -> DataFrame:
        used = capacity.utilization(capacity.snapshot_demand(clean), capacity.daily_capacity(capacity.default_profiles(clean.sparkSession)))
        todo = capacity.adjustments(capacity.bottlenecks(used)).agg(F.count(F.lit(1))).scalar()
        return capacity.feasibility(used).withColumn("adjustments", todo)

    def sensed(_, clean: DataFrame) -> DataFrame:
        seen = signals if signals is not None else clean.sparkSession.createDataFrame(
            [], "event_id long, source string, timestamp string, product_id string, signal_value double, confidence double"
        )
        products = clean.select(F.col("Product_ID").alias("product_id")).where("product_id is not null").distinct()
        adjusted = sensing.adjust_forecast(sensing.base_forecast(clean, products), seen)
        return sensing.sensing_kpis(seen, sensing.spikes(seen), adjusted)

    def sop(_, clean: DataFrame) -> DataFrame:
        weekly = capacity.snapshot_demand(clean).select(F.expr("cast(substr(period, 2) as int)").alias("period"), "demand")
        cap = capacity.daily_capacity(capacity.default_profiles(clean.sparkSession))
        kpis = scenarios.scenario_kpis(scenarios.simulate(weekly, cap, scenarios.default_scenarios(clean.sparkSession)))
        best = scenarios.compare(kpis).select("best_scenario").scalar()
        return nest(kpis, "scenarios").withColumn("best_scenario", best)

    return {
        "etl": lambda prepared, clean: etl.feed_counters(prepared),
        "stats": lambda prepared, clean: inventory.kpis(inventory.health(clean)),
        "supply_chain": lambda prepared, clean: nest(supply.lead_time_stockouts(supply.simulation_parameters(clean)), "stockouts").withColumn(
            "best_vendor", supply.vendor_scores(inventory.enrich_base(clean)).agg(F.max_by("Vendor_Name", "score")).scalar()
        ),
        "ml": ml,
        "capacity": planned,
        "sensing": sensed,
        "sop": sop,
    }


def run_batch(
    raw: DataFrame, batch_id: str, folder: str, signals: DataFrame | None = None, source_file: str = "",
    stages: dict[str, Callable] | None = None,
) -> DataFrame:
    """Run all stages in order and give the run's status rows, which are also stored.

    The first stage that fails ends the run; its name and error are recorded and later stages stay unrun.
    """
    spark: SparkSession = raw.sparkSession
    steps = stages or stage_functions(signals)
    rows, failed = [], None
    prepared = clean = None
    for number, name in enumerate(STAGES, 1):
        try:
            if prepared is None:
                prepared = pin(etl.prepare(raw), "prepared")
                clean = prepared.select(*etl.CLEAN_COLUMNS)
                append_snapshot(clean, f"{folder}/snapshots", batch_id)
            append_result(steps[name](prepared, clean), f"{folder}/results", batch_id, name)
            rows.append((batch_id, source_file, name, "completed", number * 100 // len(STAGES), None))
        except Exception as error:  # noqa: BLE001 - any stage error is recorded and ends the run
            failed = (batch_id, source_file, name, "failed", (number - 1) * 100 // len(STAGES), str(error))
            break
    status = spark.createDataFrame(
        rows + ([failed] if failed else []),
        "batch_id string, source_file string, stage string, status string, progress_pct int, error string",
    )
    status.write.mode("overwrite").parquet(f"{folder}/runs/run={batch_id}")
    return status
