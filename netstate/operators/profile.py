"""Source profiles: label histograms, column ranges, invalid cells, duplicates and category shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.functions.columns import find_label_column, quoted
from netstate.functions.values import finite_number

SESSION = ("session_id",)
NUMERIC = {"double", "float", "integer", "long", "short", "byte", "decimal"}


def row_hash(columns: Sequence[Column]) -> list[Column]:
    """128 bits over a row: two 64-bit hashes that take the values in opposite order.

    Spark's hash passes over NULL, so each value is followed by a flag that tells whether it is NULL.
    """
    flagged = [(c, c.isNull()) for c in columns]
    forward = [part for pair in flagged for part in pair]
    backward = [part for pair in reversed(flagged) for part in pair]
    return [F.xxhash64(*forward).alias("_h1"), F.xxhash64(F.lit("second"), *backward).alias("_h2")]


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = SESSION) -> DataFrame:
    """Rows per key that repeat an earlier row in every column."""
    chosen = [F.col(quoted(c)) for c in (columns or df.columns)]
    copies = df.select(*keys, *row_hash(chosen)).groupBy(*keys, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    return copies.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def label_histogram(df: DataFrame, label: str | None = None, keys: Sequence[str] = SESSION) -> DataFrame:
    """Rows per trimmed raw label."""
    label = label or find_label_column(df.columns)
    if label is None:
        raise ValueError("The source has no label column.")
    trimmed = F.trim(F.col(quoted(label)).cast("string")).alias("label")
    return df.groupBy(*keys, trimmed).agg(F.count(F.lit(1)).alias("rows"))


def _invalid(df: DataFrame, name: str) -> Column:
    """NULL, NaN or infinite, whether typed or spelled out."""
    column = F.col(quoted(name))
    kind = df.schema[name].dataType.typeName()
    if kind in ("double", "float"):
        return column.isNull() | F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    if kind == "string":
        return column.isNull() | column.isin("Infinity", "-Infinity", "inf", "-inf", "NaN", "nan", "")
    return column.isNull()


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = SESSION) -> DataFrame:
    """Per key and column: present cells, invalid cells, numeric range, and whether it holds at most one value.

    All columns are measured in one pass with fixed-width buffers. A column is constant when its least and greatest
    values agree; texts are compared by their 64-bit hash.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    structs = []
    for name in columns:
        column = F.col(quoted(name))
        kind = df.schema[name].dataType.typeName()
        numeric = kind in NUMERIC or kind == "string"
        value = finite_number(column) if numeric else F.lit(None).cast("double")
        comparable = column if kind in NUMERIC else F.when(column.isNotNull(), F.xxhash64(column))
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(column).alias("non_null_values"),
                F.count_if(_invalid(df, name)).alias("invalid_values"),
                F.min(value).alias("numeric_min"),
                F.max(value).alias("numeric_max"),
                F.coalesce(F.min(comparable) == F.max(comparable), F.lit(True)).alias("is_constant"),
            )
        )
    return df.groupBy(*keys).agg(F.array(*structs).alias("_columns")).select(*keys, F.inline("_columns"))


def source_profile(df: DataFrame, keys: Sequence[str] = SESSION, order: str | None = "flow_seq") -> DataFrame:
    """One row per source: rows, columns, invalid cells and duplicate rows.

    `order` names a generated row id, which is no source column.
    """
    columns = [c for c in df.columns if c not in keys and c != order]
    invalid = reduce(lambda a, b: a + b, [_invalid(df, c).cast("long") for c in columns])
    chosen = [F.col(quoted(c)) for c in columns]
    hashed = df.select(*keys, invalid.alias("_invalid"), *row_hash(chosen))
    copies = hashed.groupBy(*keys, "_h1", "_h2").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_invalid").alias("_invalid")
    )
    return copies.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.lit(len(columns)).alias("columns"),
        F.sum("_invalid").alias("invalid_values"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
    )


def combined_profile(profile: DataFrame) -> DataFrame:
    """Totals over all sources."""
    return profile.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.sum("rows").alias("rows"),
        F.sum("invalid_values").alias("invalid_values"),
        F.sum("duplicate_rows").alias("duplicate_rows_within_sessions"),
    )


def category_shares(df: DataFrame, columns: Sequence[str], max_values: int = 100) -> DataFrame:
    """Value shares in percent of each column with at most `max_values` values; only the value count otherwise."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns]
    )
    counted = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"))
    few = counted.join(F.broadcast(sizes), "column").where(F.col("values") <= max_values)
    listed = few.select("column", "value", "values", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))
    many = sizes.where(F.col("values") > max_values).select(
        "column", F.lit(None).cast("string").alias("value"), "values", F.lit(None).cast("double").alias("percent")
    )
    return listed.unionByName(many)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation and range per column, one row each."""
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.col(quoted(c))).alias("n"),
            F.avg(F.col(quoted(c))).alias("mean"),
            F.stddev_samp(F.col(quoted(c))).alias("stddev"),
            F.min(F.col(quoted(c))).cast("double").alias("min"),
            F.max(F.col(quoted(c))).cast("double").alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*structs).alias("_c")).select(F.inline("_c"))
