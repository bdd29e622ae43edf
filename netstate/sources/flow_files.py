"""Flow CSV files: ordered sessions, header probes, row numbers in source order, fingerprints."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netstate.functions.columns import find_label_column, match_features, quoted
from netstate.functions.values import literal_map

# Fixed session order of the public intrusion dataset, one capture file each.
SESSION_FILES = [
    "Monday-WorkingHours.pcap_ISCX.csv",
    "Tuesday-WorkingHours.pcap_ISCX.csv",
    "Wednesday-workingHours.pcap_ISCX.csv",
    "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
    "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
    "Friday-WorkingHours-Morning.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
]


#: A file of up to 2**FILE_BITS bytes has its own range of row numbers.
FILE_BITS = 44
#: Files below this size fit in one row of the binary reader.
SINGLE_ROW_BYTES = 2_000_000_000


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line only."""
    return spark.read.option("header", True).csv(path).columns


def probe_features(spark: SparkSession, path: str) -> dict[str, str]:
    """Feature -> column of a CSV file; raises with the missing features."""
    return match_features(header(spark, path))


def missing_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that do not exist, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    absent = []
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        if not location.getFileSystem(conf).exists(location):
            absent.append(path)
    return absent


def _text_schema(columns: Sequence[str], corrupt: str | None = None, numbers: Iterable[str] = ()) -> T.StructType:
    names, doubles = [*columns, *([corrupt] if corrupt else [])], set(numbers)
    return T.StructType([T.StructField(name, T.DoubleType() if name in doubles else T.StringType()) for name in names])


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _plain(path: str) -> str:
    """A path with one slash after the scheme, as two parts of Spark write it differently."""
    return re.sub(r"^([A-Za-z0-9]+:)/+", r"\1/", path)


def _with_source(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `session_id` (file stem) and `flow_seq`, a row number that follows the order of files and of rows in a file.

    A CSV split is read front to back by one task, so the row id of Spark orders rows inside a split, and the split's
    byte offset orders the splits of a file. Files stand in the order of `order`; `flow_seq` is unique over all of them.
    """
    file_path = F.col("_metadata.file_path")
    rank = F.lit(0).cast("long")
    if len(order) > 1:
        ranks = {_plain(path): i for i, path in enumerate(order)}
        rank = F.try_element_at(literal_map(ranks), F.regexp_replace(file_path, r"^([A-Za-z0-9]+:)/+", "$1/")).cast("long")
    return (
        df.withColumn("_file", F.shiftleft(rank, FILE_BITS))
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("session_id", file_stem(file_path))
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        # A row takes at least one byte, so a position in a full split stays below the next split's offset.
        .withColumn("flow_seq", F.col("_file") + F.col("_block") + F.col("_row"))
        .drop("_file", "_block", "_row")
    )


def by_header(spark: SparkSession, paths: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, paths) for each distinct header, in the order of the first file that has it."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(header(spark, path)), []).append(path)
    return [(list(names), own) for names, own in groups.items()]


def read_flow_csv(
    spark: SparkSession, path: str | Sequence[str], numbers: Callable[[list[str]], Iterable[str]] | None = None
) -> DataFrame:
    """Flow CSV files as text columns with `session_id` and `flow_seq`. Types are applied where columns are used.

    Files are grouped by their header and put together by column name; a column that a file lacks is NULL there. A path
    may be a glob. `numbers` names the columns of a header that the parser gives as doubles, without a text in between;
    a field that is no number is NULL, and the rest of its row stays. Give the same columns for all files.
    """
    paths = [found for p in ([path] if isinstance(path, str) else path) for found in matching_files(spark, p)]
    parts = [
        _with_source(
            spark.read.option("header", True).option("mode", "PERMISSIVE")
            .schema(_text_schema(names, numbers=numbers(names) if numbers else ())).csv(own),
            paths,
        )
        for names, own in by_header(spark, paths)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a path, folder or glob stands for, sorted; raises when there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    location = jvm.org.apache.hadoop.fs.Path(pattern)
    system = location.getFileSystem(conf)
    found = []
    for status in system.globStatus(location) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath().toString() for s in inner if not s.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(f"No file matches {pattern}")
    return sorted(found)


def read_sessions(
    spark: SparkSession, directory: str, files: Sequence[str] = tuple(SESSION_FILES),
    numbers: Callable[[list[str]], Iterable[str]] | None = None,
) -> DataFrame:
    """The listed capture files in order, with `session_rank`; raises when one is missing.

    A listed name may be a folder of part files, which stand in the order of their names; the session is called by the
    listed name without its ending. Source order is (session_rank, flow_seq). `numbers`: see `read_flow_csv`.
    """
    paths = [f"{directory.rstrip('/')}/{name}" for name in files]
    absent = missing_files(spark, paths)
    if absent:
        raise FileNotFoundError(f"Required source files are missing: {absent}")
    parts = [
        read_flow_csv(spark, path, numbers).withColumns({"session_id": F.lit(name.rsplit(".", 1)[0]), "session_rank": F.lit(rank)})
        for rank, (path, name) in enumerate(zip(paths, files))
    ]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined


def read_labelled(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all CSV files that match a glob, split into well-formed and malformed rows.

    Files are grouped by header as in `read_flow_csv`. Raises when a file has no label column.
    """
    good, bad = [], []
    every = matching_files(spark, pattern)
    for columns, paths in by_header(spark, every):
        if find_label_column(columns) is None:
            raise ValueError(f"Labelled sources need a label column: {paths}")
        raw = (
            spark.read.option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt")
            .option("columnPruning", False)
            .schema(_text_schema(columns, "_corrupt"))
            .csv(paths)
        )
        rows = _with_source(raw, every)
        # Spark refuses to read the corrupt-record column alone, so the test also names a data column.
        malformed = F.concat(F.col("_corrupt"), F.coalesce(F.col(quoted(columns[0])), F.lit(""))).isNotNull()
        good.append(rows.where(~malformed).drop("_corrupt"))
        bad.append(rows.where(malformed))
    return tuple(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for parts in (good, bad))


def fingerprints(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Name, size and a digest of source files of any size, by rows of text in the splits that Spark reads.

    Files of less than 2 GB get the sha-256 of their bytes. A larger file never stands in one row: its `sha256` is NULL,
    and `line_digest`, which every file has, is the sum of the hashes of its lines.
    """
    paths = [found for p in ([path] if isinstance(path, str) else path) for found in matching_files(spark, p)]
    files = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    small = files.where(F.col("length") < SINGLE_ROW_BYTES).select(
        name.alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )
    large = files.where(F.col("length") >= SINGLE_ROW_BYTES).select(
        name.alias("name"), F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("sha256")
    )
    lines = spark.read.text(paths).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.xxhash64("value").cast("decimal(38,0)").alias("h")
    )
    digests = lines.groupBy("name").agg(F.sum("h").cast("string").alias("line_digest"), F.count(F.lit(1)).alias("lines"))
    return small.unionByName(large).join(digests, "name", "left")
