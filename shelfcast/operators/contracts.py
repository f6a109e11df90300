"""Table contracts: coerce types, then split rows into valid and rejected, or stop."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    nullable: bool = False
    check: str | None = None  # ge, gt or isin
    bound: Any = None

    def broken(self) -> Column:
        """True where a coerced value breaks the rule; a failed coercion is a null."""
        c = F.col(self.name)
        bad = F.lit(False) if self.nullable else c.isNull()
        if self.check == "ge":
            bad = bad | (c < self.bound)
        elif self.check == "gt":
            bad = bad | (c <= self.bound)
        elif self.check == "isin":
            bad = bad | ~c.isin(*self.bound)
        return F.coalesce(bad, F.lit(False))


@dataclass(frozen=True)
class Contract:
    name: str
    rules: tuple[Rule, ...]
    strict: bool = True


def _text(*names: str) -> tuple[Rule, ...]:
    return tuple(Rule(n, "string") for n in names)


# The contracts of the demand tables.
DEMAND = Contract("demand", (*_text("unique_id"), Rule("ds", "date"), Rule("y", "double", check="ge", bound=0)))
STATIC = Contract("static", _text("unique_id", "warehouse", "category", "subcategory"))
FUTURE = Contract("future", (
    *_text("unique_id"), Rule("ds", "date"), Rule("promo_flag", "int", check="isin", bound=(0, 1)),
    Rule("is_holiday", "int", check="isin", bound=(0, 1)), Rule("temperature", "double"),
))
PAST = Contract("past", (
    *_text("unique_id"), Rule("ds", "date"), Rule("price", "double", check="gt", bound=0), Rule("stock_level", "double", check="ge", bound=0),
))
FORECAST = Contract("forecast", (
    *_text("unique_id"), Rule("ds", "date"), Rule("y_hat", "double"), Rule("y_lo_90", "double", True), Rule("y_hi_90", "double", True),
    *_text("model"),
), strict=False)
EVALUATION = Contract("evaluation", (
    *_text("model"), Rule("mape", "double", True, "ge", 0), Rule("rmse", "double", check="ge", bound=0), Rule("mae", "double", check="ge", bound=0),
), strict=False)


class ContractError(ValueError):
    """A table does not fit its contract."""


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Check columns and cast leniently. NaN counts as missing."""
    names = [r.name for r in contract.rules]
    missing = [n for n in names if n not in df.columns]
    extra = [c for c in df.columns if c not in names]
    if missing:
        raise ContractError(f"{contract.name}: missing columns {missing}")
    if contract.strict and extra:
        raise ContractError(f"{contract.name}: unexpected columns {extra}")
    cast = []
    for r in contract.rules:
        c = F.col(r.name).try_cast(r.type)
        cast.append((F.nanvl(c, F.lit(None).cast("double")) if r.type == "double" else c).alias(r.name))
    return df.select(*cast, *extra)


def judge(df: DataFrame, contract: Contract) -> DataFrame:
    """Coerced rows with an array of the columns that break their rule."""
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in contract.rules]))
    return coerce(df, contract).withColumn("violations", broken)


def enforce(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations)."""
    judged = judge(df, contract)
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def require(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows as they pass; the first row that breaks the contract stops the job."""
    judged = judge(df, contract)
    message = F.concat(F.lit(f"{contract.name} contract broken by: "), F.concat_ws(",", "violations"))
    kept = judged.where(F.when(F.size("violations") == 0, True).otherwise(F.raise_error(message).cast("boolean")))
    return kept.drop("violations")


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    checked = coerce(df, contract)
    cells = [F.struct(F.lit(r.name).alias("column"), F.count(F.when(r.broken(), 1)).alias("broken")) for r in contract.rules]
    return checked.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
