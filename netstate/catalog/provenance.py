"""Registered queries: ATT&CK metadata read from a file, and the provenance of mapped actions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.catalog.models import CONTEXT, FORECASTS, _forecasts
from netstate.catalog.sql import FLOWS, states, with_ctes
from netstate.operators import attack_context as ctx
from netstate.scale import ensure_checkpoint_dir, stage
from netstate.sources.attack_metadata import FILE_SCHEMA, PUBLISHER, read_attack_metadata, with_provenance
from netstate.sources.tables import derive_flows

QUERIES = {}
ORACLE = {}
VERSION, MODIFIED, SOURCE = "19.1", "2026-05-12", "https://example.org/enterprise-attack.json"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """A metadata file with the techniques of the states that occur in the flows, written and read again."""
    seen = derive_flows(spark, d).select(F.col("current_state").alias("state")).distinct()
    site = "https://attack.mitre.org"
    entry = F.struct(
        F.concat(F.lit("attack-pattern--"), F.col("technique_id")).alias("stix_id"), "technique_id", "technique_name", F.array("tactic").alias("tactics"),
        F.concat(F.lit(f"{site}/techniques/"), F.translate("technique_id", ".", "/")).alias("url"), F.lit("1.0").alias("object_version"), F.lit(MODIFIED).alias("modified"),
    )
    techniques = ctx.technique_dimension(spark).join(seen, "state", "left_semi").agg(F.sort_array(F.collect_list(entry)).alias("techniques"))
    detection = F.struct(F.lit("DET0518").alias("id"), F.lit("Detection of network denial of service").alias("name"), F.lit(f"{site}/detectionstrategies/DET0518").alias("url"), F.array(F.lit("AN1434")).alias("analytics"))
    mitigation = F.struct(F.lit("M1037").alias("id"), F.lit("Filter Network Traffic").alias("name"), F.lit(f"{site}/mitigations/M1037").alias("url"))
    document = techniques.select(
        F.lit(FILE_SCHEMA).alias("schema"), F.lit(VERSION).alias("attack_version"), F.lit(MODIFIED).alias("data_modified"),
        F.struct(F.lit(PUBLISHER).alias("publisher"), F.lit(SOURCE).alias("url"), F.lit("0" * 64).alias("stix_bundle_sha256")).alias("source"),
        F.struct(F.lit("subset").alias("name")).alias("collection"), F.array(detection).alias("detection_strategies"), F.array(mitigation).alias("mitigations"), "techniques",
    )
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/attack-{uuid.uuid4().hex}"
    document.coalesce(1).write.json(path)
    return read_attack_metadata(spark, path)


_TECHNIQUES = ", ".join(f"('{s}', '{t}')" for s, own in ctx.STATE_TECHNIQUES.items() for t in own)
_NAMES = ", ".join(f"('{t}', '{name}', '{tactic}')" for t, name, tactic in ctx.TECHNIQUES)


@query(
    with_ctes(FLOWS)
    + f"""SELECT technique_id, technique_name, tactic AS tactics, 'https://attack.mitre.org/techniques/' || replace(technique_id, '.', '/') AS url, '{VERSION}' AS attack_version, '{SOURCE}' AS metadata_source,
  'M1037 Filter Network Traffic' AS mitigations, 'DET0518 Detection of network denial of service' AS detection_strategies, CAST(0 AS INT) AS problems
  FROM (VALUES {_TECHNIQUES}) s(state, technique_id) JOIN (VALUES {_NAMES}) n(technique_id, technique_name, tactic) USING (technique_id) WHERE state IN (SELECT current_state FROM flows)"""
)
def attack_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Techniques of a metadata file with its defences and version."""
    def named(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(" ", x["id"], x["name"])), "; ").alias(column)

    return _metadata(spark, d).select(
        "technique_id", "technique_name", F.array_join("tactics", "; ").alias("tactics"), "url", "attack_version", "metadata_source",
        named("mitigations"), named("detection_strategies"), F.size("problems").alias("problems"),
    )


@query(
    with_ctes(FLOWS, states(), FORECASTS, CONTEXT, "best_of AS (SELECT session_id, window_id, bool_or(mapping_status = 'POSSIBLE') AS p FROM cand GROUP BY 1, 2)")
    + f"""SELECT c.session_id, c.window_id, current_state, predicted AS predicted_next_state, round(best, 6) AS forecast_probability, CASE WHEN p THEN 'possible_attack_context' END AS attack_mapping,
  '{VERSION}' AS attack_version, '{MODIFIED}' AS attack_data_modified, '{SOURCE}' AS metadata_source, 'local_risk_matched_playbook' AS action_source,
  CASE WHEN guided IN ('DDoS', 'DoS') THEN 'M1037 Filter Network Traffic' ELSE '' END AS action_mitigations,
  CASE WHEN guided = 'DDoS' THEN 'DET0518 Detection of network denial of service' ELSE '' END AS action_detections, TRUE AS requires_operator_validation
  FROM c3 c LEFT JOIN best_of USING (session_id, window_id)"""
)
def attack_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Every window's mapping with the file's version and the defences its playbook names."""
    keys = ["session_id", "window_id"]
    forecasts = stage(_forecasts(spark, d))
    out = with_provenance(forecasts, ctx.attack_candidates(forecasts, keys), _metadata(spark, d), keys)

    def named(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(" ", x["id"], x["name"])), "; ").alias(column)

    return out.select(
        *keys, "current_state", "predicted_next_state", F.round("forecast_probability", 6).alias("forecast_probability"), "attack_mapping", "attack_version",
        "attack_data_modified", "metadata_source", "action_source", named("action_mitigations"), named("action_detections"), "requires_operator_validation",
    )
