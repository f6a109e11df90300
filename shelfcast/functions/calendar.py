"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(ds: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ds)


def retail_holiday(ds: Column) -> Column:
    """1 in Thanksgiving week, from 15 December, on 4 July and on 1-3 January."""
    month, day = F.month(ds), F.dayofmonth(ds)
    flag = (
        ((month == 11) & day.between(22, 28))
        | ((month == 12) & (day >= 15))
        | ((month == 7) & (day == 4))
        | ((month == 1) & (day <= 3))
    )
    return flag.cast("int")


def day_index(ds: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(ds)


def strptime_pattern(fmt: str) -> str:
    """Spark datetime pattern for a strftime format made of the usual date and time fields."""
    fields = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy"}
    out = fmt
    for code, pattern in fields.items():
        out = out.replace(code, pattern)
    return out
