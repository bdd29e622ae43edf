"""ATT&CK metadata files as tables: techniques with their defences, file version and provenance; and what a mapping took from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.operators.attack_context import PROBABILITIES, VALID_TACTICS, mapping_summary, with_forecast_context

DEFENCE = "struct<id: string, name: string, url: string, analytics: array<string>>"
#: Nested columns of a metadata file; what a file lacks is null.
METADATA_SCHEMA = f"""schema string, attack_version string, data_modified string, domain string,
  source struct<publisher: string, repository: string, url: string, stix_bundle_sha256: string>,
  collection struct<stix_id: string, id: string, name: string, modified: string>,
  detection_strategies array<{DEFENCE}>, mitigations array<{DEFENCE}>,
  techniques array<struct<stix_id: string, technique_id: string, technique_name: string, tactics: array<string>, url: string,
    object_version: string, modified: string>>"""

# The schema and publisher of the files, and the defences the local playbook names for a state.
FILE_SCHEMA = "mitre-attack-enterprise-subset/v1"
PUBLISHER = "The MITRE Corporation"
PLAYBOOK = "local_risk_matched_playbook"
STATE_MITIGATIONS = {"DDoS": ["M1037"], "DoS": ["M1037"]}
STATE_DETECTIONS = {"DDoS": ["DET0518"]}


def read_attack_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per technique: its columns, the file's mitigations and detection_strategies, its version and source, and problems.

    The file is read with METADATA_SCHEMA, so a technique with another shape has nulls, which are problems, as are an id of
    another form, a URL that does not end with the id, unknown tactics and ids that occur twice. A file without schema,
    version, source or publisher, or without techniques, raises an error.
    """
    document = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(path)
    source = F.col("source")
    faults = {
        "schema": ~F.col("schema").eqNullSafe(F.lit(FILE_SCHEMA)), "attack_version": F.col("attack_version").isNull(),
        "data_modified": F.col("data_modified").isNull(), "collection": F.col("collection").isNull(),
        "publisher": ~source["publisher"].eqNullSafe(F.lit(PUBLISHER)), "source": source["url"].isNull() | source["stix_bundle_sha256"].isNull(),
        "techniques": F.coalesce(F.size("techniques"), F.lit(0)) < 1,
    }
    rows = document.agg(F.count(F.lit(1)).alias("files"), *[F.bool_or(fault).alias(name) for name, fault in faults.items()]).first()
    wrong = [name for name in faults if rows[name]] if rows["files"] else ["any document"]
    if wrong:
        raise ValueError(f"The ATT&CK metadata has no valid {', '.join(wrong)}.")
    techniques = document.select(
        F.explode("techniques").alias("t"), F.col("attack_version"), F.col("data_modified").alias("attack_data_modified"),
        source["url"].alias("metadata_source"), source["stix_bundle_sha256"].alias("metadata_sha256"),
        *[F.coalesce(F.col(c), F.array().cast(f"array<{DEFENCE}>")).alias(c) for c in ("mitigations", "detection_strategies")],
    ).select("t.*", "attack_version", "attack_data_modified", "metadata_source", "metadata_sha256", "mitigations", "detection_strategies")
    copies = techniques.groupBy("technique_id").agg(F.count(F.lit(1)).alias("_copies"))
    ends = F.col("url").endswith(F.concat(F.lit("/"), F.translate("technique_id", ".", "/")))
    allowed = F.array(*[F.lit(t) for t in VALID_TACTICS])
    checks = {
        "missing field": F.greatest(*[F.col(c).isNull() for c in ("stix_id", "technique_id", "technique_name", "tactics", "url", "modified")]),
        "invalid id": ~F.col("technique_id").rlike(r"^T\d{4}(\.\d{3})?$"), "url does not match id": ~ends,
        "invalid tactic": (F.size("tactics") < 1) | (F.size(F.array_except("tactics", allowed)) > 0), "duplicate id": F.col("_copies") > 1,
    }
    problems = F.array_compact(F.array(*[F.when(F.coalesce(fault, F.lit(True)), F.lit(name)) for name, fault in checks.items()]))
    return techniques.join(copies, "technique_id", "left").withColumn("problems", problems).drop("_copies")


def _for_state(state: Column, table: dict[str, list[str]]) -> Column:
    nothing = F.array().cast("array<string>")
    return F.coalesce(*[F.when(state == s, F.array(*[F.lit(i) for i in ids])) for s, ids in table.items()], nothing)


def _resolved(ids: Column, known: str) -> Column:
    """The file's entries of these ids, in the order of the ids; an id the file lacks has no name."""
    def entry(wanted: Column) -> Column:
        found = F.filter(known, lambda d: d["id"] == wanted)
        return F.struct(wanted.alias("id"), F.get(found, F.lit(0))["name"].alias("name"), F.get(found, F.lit(0))["url"].alias("url"))

    return F.transform(ids, entry)


def with_provenance(
    forecasts: DataFrame, candidates: DataFrame, metadata: DataFrame, keys: Sequence[str], probabilities: Sequence[str] = PROBABILITIES
) -> DataFrame:
    """`mapping_summary` with the metadata's version and the provenance of its actions.

    action_mitigations and action_detections name what the playbook takes for the state that guides it (the current attack, or
    the forecast one if it is at least as likely as not), with names and URLs from the file. attack_mapping is set where a
    technique is possible. metadata is a table of `read_attack_metadata`, of which one row carries the file.
    """
    summary = mapping_summary(forecasts, candidates, keys)
    attacks = list({*STATE_MITIGATIONS, "PortScan"})
    current, next_ = F.col("current_state"), F.col("predicted_next_state")
    guided = F.when(current.isin(attacks), current).when(next_.isin(attacks) & (F.col("forecast_probability") >= 0.50), next_)
    guide = with_forecast_context(forecasts, probabilities).select(*keys, "forecast_probability", guided.alias("guidance_state"))
    file = metadata.select("attack_version", "attack_data_modified", "metadata_source", "mitigations", "detection_strategies").limit(1)
    joined = summary.join(guide, list(keys), "left").join(F.broadcast(file), F.lit(True), "left")  # the file is one row
    state = F.col("guidance_state")
    return joined.select(
        *summary.columns, "forecast_probability", F.when(F.col("mapping_status") == "POSSIBLE", F.lit("possible_attack_context")).alias("attack_mapping"),
        "attack_version", "attack_data_modified", "metadata_source", F.lit(PLAYBOOK).alias("action_source"),
        _resolved(_for_state(state, STATE_MITIGATIONS), "mitigations").alias("action_mitigations"),
        _resolved(_for_state(state, STATE_DETECTIONS), "detection_strategies").alias("action_detections"),
        F.lit(True).alias("requires_operator_validation"),
    )
