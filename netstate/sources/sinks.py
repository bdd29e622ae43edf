"""Sinks and caches: every table goes to a new path or a keyed cache entry, never over its own input."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.plans.digests import identity_key
from netstate.sources.flow_files import missing_files


def write_labelled_flows(flows: DataFrame, path: str, format: str = "parquet") -> None:
    """Flows with their state columns."""
    writer = flows.write.mode("errorifexists")
    writer.option("header", True).csv(path) if format == "csv" else writer.format(format).save(path)


def write_by_session(table: DataFrame, path: str, session: str = "session_id") -> None:
    """States or transitions, one folder per session, so that session filters prune files.

    Rows keep their partitioning: a session that owns most of the rows is written by many tasks.
    """
    table.write.mode("errorifexists").partitionBy(session).parquet(path)


def write_session_csv(
    flows: DataFrame, folder: str, sessions: Sequence[str], order: str, names: Mapping[str, Mapping[str, str]],
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One folder of CSV parts per session, `<session>.csv`, whose parts and rows stand in the order of `order`.

    `names` maps the columns of a session to its headers, in the order of the file. `shape` adds columns row by row once the
    rows are placed, so that they are neither sampled nor exchanged. `flows` is read twice a session; give it stored.
    """
    # The writer itself shows these as the cast would; a cast first would make each text twice.
    plain = {"double", "float", "byte", "short", "integer", "long"}
    for session in sessions:
        own = flows.where(F.col("session_id") == session)
        ordered = own.repartitionByRange(F.col(order)).sortWithinPartitions(order)
        shaped = shape(ordered) if shape else ordered
        kinds = {f.name: f.dataType.typeName() for f in shaped.schema.fields}
        shown = shaped.select(
            *[(F.col(c) if kinds[c] in plain else F.col(c).cast("string")).alias(header) for c, header in names[session].items()]
        )
        writer = shown.write.mode("errorifexists").option("header", True)
        # Leading blanks belong to the values and headers of the public dataset.
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.csv(f"{folder.rstrip('/')}/{session}.csv")


def write_sequences(sequences: DataFrame, path: str, split: str = "split") -> None:
    sequences.write.mode("errorifexists").partitionBy(split).parquet(path)


def write_manifest(spark: SparkSession, manifest: Mapping[str, object], path: str) -> None:
    """A one-row JSON manifest."""
    row = spark.createDataFrame([{k: str(v) for k, v in manifest.items()}])
    row.coalesce(1).write.mode("overwrite").json(path)


def write_column_statistics(statistics: DataFrame, path: str) -> None:
    statistics.write.mode("overwrite").option("header", True).csv(path)


def read_windows(spark: SparkSession, path: str, sessions: Sequence[str] | None = None) -> DataFrame:
    """Stored window states, only the folders of the asked sessions."""
    table = spark.read.parquet(path)
    return table.where(F.col("session_id").isin(list(sessions))) if sessions else table


def cached_table(
    spark: SparkSession, root: str, identity: Mapping, build: Callable[[], DataFrame], rebuild: bool = False
) -> tuple[DataFrame, bool]:
    """Table under ``root/key=<sha-256 of identity>``: read when a finished entry exists, built otherwise.

    Returns the table and whether it came from the cache.
    """
    entry = f"{root.rstrip('/')}/key={identity_key(identity)}"
    if not rebuild and not missing_files(spark, [f"{entry}/_SUCCESS"]):
        return spark.read.parquet(entry), True
    build().write.mode("overwrite").parquet(entry)
    return spark.read.parquet(entry), False


def recent_dataset(spark: SparkSession, datasets: Mapping[str, object], min_windows: int = 5) -> str | None:
    """The newest dataset with at least `min_windows` windows.

    `datasets` maps a table path to a value that grows with its age order, e.g. its creation time.
    """
    for path in sorted(datasets, key=lambda p: datasets[p], reverse=True):
        if missing_files(spark, [path]):
            continue
        if spark.read.parquet(path).limit(min_windows).count() >= min_windows:
            return path
    return None


def timeline(states: DataFrame, limit: int = 500) -> DataFrame:
    """The last windows in order, counters as whole numbers, NULL where a value is no number."""
    counters = [
        "flow_count", "total_packets", "total_bytes", "packets_per_second", "bytes_per_second", "flows_per_second",
        "benign_flow_count", "ddos_flow_count", "dos_flow_count", "portscan_flow_count", "attack_present",
    ]
    whole = {c: F.col(c).try_cast("double").try_cast("bigint") for c in counters if c in states.columns}
    latest = states.orderBy(F.col("window_id").desc_nulls_first()).limit(limit)
    return latest.withColumns(whole).orderBy(F.col("window_id").asc_nulls_last())
