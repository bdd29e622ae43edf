"""Time the headline queries, each on its second run, and print one JSON line.

`queries` are whole seconds per query, `parts` split them into building the DataFrame (with the jobs that this starts),
planning and running. `large` repeats the two passes that have a published rate over 28 copies of the flows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from netstate.catalog import all_queries
from netstate.session import build_session

HEADLINE = [
    "window_state_vectors", "proxy_state_vectors", "source_profile", "column_statistics", "signature_states",
    "flood_evidence", "port_sweeps", "packet_features", "flow_assembly", "multistep_sequences", "sequences_gap_aware",
    "leakage_check", "ranking_metrics", "summary_metrics", "attack_candidates",
]
LARGE = ["proxy_state_vectors", "source_profile", "window_state_vectors"]
COPIES = 28


def timed(function, spark, directory: str) -> tuple[float, list[float]]:
    """Seconds of the second run, whole and by part; the first run loads and compiles."""
    for _ in range(2):
        started = time.perf_counter()
        frame = function(spark, directory)
        built = time.perf_counter()
        frame._jdf.queryExecution().executedPlan()
        planned = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        ended = time.perf_counter()
    return round(ended - started, 3), [round(x, 3) for x in (built - started, planned - built, ended - planned)]


def copied_events(spark, directory: str) -> tuple[str, int]:
    """A folder with the events table repeated under new ids and later times, and its rows."""
    target = tempfile.mkdtemp(prefix="bench-")
    events = spark.read.parquet(f"{directory}/events.parquet")
    rows = events.count()
    copies = events.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    moved = copies.withColumns(
        {"event_id": F.col("event_id") + F.col("_i") * rows, "ts": F.col("ts") + F.make_dt_interval(F.col("_i") * 365)}
    ).drop("_i")
    moved.write.parquet(f"{target}/events.parquet")
    return target, rows * COPIES


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    functions = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    timings, parts, large = {}, {}, {}
    for name in wanted:
        timings[name], parts[name] = timed(functions[name], spark, directory)
    if not sys.argv[1:]:
        folder, rows = copied_events(spark, directory)
        for name in LARGE:
            seconds, _ = timed(functions[name], spark, folder)
            large[name] = {"rows": rows, "seconds": seconds, "rows_per_second": round(rows / seconds)}
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "parts": parts, "large": large,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
