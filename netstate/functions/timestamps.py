"""Timestamp parsing for flow exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.functions.values import number

# Fixed layouts of flow-export timestamps: those that name the year first, and those that name a day and a month first.
YEAR_FIRST = ["yyyy-M-d H:mm[:ss][.SSSSSS]", "yyyy/M/d H:mm[:ss][.SSSSSS]", "yyyy-M-d", "yyyy/M/d"]
MONTH_FIRST = ["M/d/yyyy H:mm[:ss][.SSSSSS]", "M/d/yyyy h:mm[:ss] a", "M/d/yyyy", "M-d-yyyy H:mm[:ss]", "M-d-yyyy"]
DAY_FIRST = [layout.replace("M", "?").replace("d", "M").replace("?", "d") for layout in MONTH_FIRST]


def parse_text(column: Column, day_first: bool = False) -> Column:
    """Timestamp of one text value on its own terms, NULL when no layout fits. Offsets are converted to UTC.

    ``3/7/2017`` is the 7th of March, or with `day_first` the 3rd of July; where one order is impossible, as in
    ``25/12/2017``, the other one holds.
    """
    text = F.upper(F.trim(column.cast("string")))
    orders = [*YEAR_FIRST, *(DAY_FIRST + MONTH_FIRST if day_first else MONTH_FIRST + DAY_FIRST)]
    named = F.try_to_timestamp(F.when(text.rlike("^[0-9]{4}-"), text))
    return F.coalesce(named, *[F.try_to_timestamp(text, F.lit(layout)) for layout in orders])


def parse_timestamps(
    df: DataFrame, column: str, output: str = "timestamp_parsed", day_first: bool = False
) -> DataFrame:
    """Parse a timestamp column; when no value parses as a date, read it as epoch seconds or milliseconds.

    The unit is milliseconds when the median exceeds 1e12. Unparseable rows stay with NULL.
    """
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return df.withColumn(output, F.col(column).cast("timestamp"))
    numeric = kind not in ("string", "varchar", "char")
    parsed = F.lit(None).cast("timestamp") if numeric else parse_text(F.col(column), day_first)
    epoch = number(F.col(column))
    summary = df.select(parsed.alias("p"), epoch.alias("e")).agg(
        F.count("p").alias("dates"), F.percentile_approx("e", 0.5, 10_000).alias("median")
    )
    found = summary.first()
    if found["dates"] or found["median"] is None:
        return df.withColumn(output, parsed)
    scale = 1_000 if found["median"] > 1e12 else 1_000_000
    return df.withColumn(output, F.timestamp_micros((epoch * scale).cast("long")))
