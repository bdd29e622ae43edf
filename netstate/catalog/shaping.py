"""Output shaping shared by the registered queries: rounding, and arrays and times as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.constants import STATE_FEATURES

HOUR = 3600


def rounded(df: DataFrame, columns: Sequence[str] = STATE_FEATURES, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.expr(f"round({c}, {places})") for c in columns})


def time_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(column: str | Column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
