import json

import pytest
from pyspark.sql import functions as F

from netstate.operators import attack_context as ctx


def forecast(spark, current, probs, **features):
    names = ["flow_count", "unique_dst_port_count", "flows_per_second", "packets_per_second", "syn_count", "rst_count"]
    values = [float(features.get(n, 0)) for n in names]
    return spark.createDataFrame(
        [(1, current, *probs, *values)],
        "id int, current_state string, p_benign double, p_ddos double, p_dos double, p_portscan double, " + ", ".join(f"{n} double" for n in names),
    )


def test_scan_candidates(spark):
    table = forecast(spark, "PortScan", (0.1, 0.1, 0.1, 0.7), flow_count=20, unique_dst_port_count=18, syn_count=15)
    out = ctx.ranked_candidates(ctx.attack_candidates(table, ["id"])).collect()
    assert [(r["technique_id"], r["mapping_status"], r["mapping_confidence"]) for r in out] == [("T1046", "POSSIBLE", 0.65), ("T1595", "POSSIBLE", 0.65)]
    assert out[0]["evidence"][:3] == [
        "observed current network state is PortScan", "LSTM next-state probability for PortScan is 0.700",
        "destination-port diversity is elevated (18 unique ports)"]
    assert out[0]["severity"] == "medium"


def test_flood_sub_techniques_stay_low(spark):
    table = forecast(spark, "BENIGN", (0.2, 0.7, 0.05, 0.05), packets_per_second=1340000.0)
    out = {r["technique_id"]: (r["mapping_status"], r["mapping_confidence"]) for r in ctx.attack_candidates(table, ["id"]).collect()}
    assert out == {"T1498": ("POSSIBLE", 0.55), "T1498.001": ("INSUFFICIENT_EVIDENCE", 0.25), "T1498.002": ("INSUFFICIENT_EVIDENCE", 0.25)}
    assert "1.34e+06" in ctx.attack_candidates(table, ["id"]).first()["evidence"][1]


@pytest.mark.parametrize("state, probs, reason", [
    ("BENIGN", (0.9, 0.05, 0.03, 0.02), "no attack evidence"),
    ("INVALID_FEATURES", (0.1, 0.7, 0.1, 0.1), "invalid features cannot support ATT&CK interpretation"),
    ("DoS", (0.9, 0.05, 0.03, 0.02), "traffic-state evidence is insufficient for an ATT&CK technique assertion"),
])
def test_reasons(spark, state, probs, reason):
    table = forecast(spark, state, probs)
    row = ctx.mapping_summary(table, ctx.attack_candidates(table, ["id"]), ["id"]).first()
    assert row["reason"] == reason and row["mapping_status"] == "INSUFFICIENT_EVIDENCE"


def test_two_states_are_examined(spark):
    out = ctx.attack_candidates(forecast(spark, "DoS", (0.1, 0.1, 0.1, 0.7), syn_count=50), ["id"])
    assert {r["state"] for r in out.collect()} == {"DoS", "PortScan"}


@pytest.mark.parametrize("value", [0.0, 5.0, 18.5, 123456.0, 1234567.0, 0.00012, 0.0000123, 0.1, -2.5])
def test_general_number(spark, value):
    assert spark.range(1).select(ctx.general_number(F.lit(value))).first()[0] == f"{value:g}"


def test_stages(spark):
    steps = spark.createDataFrame(
        [(1, "BENIGN", 1, "BENIGN", 0.9), (1, "BENIGN", 2, "PortScan", 0.39), (2, "BENIGN", 1, "BENIGN", 0.95)],
        "id int, current_state string, step int, y_pred string, p_benign double",
    )
    out = {r["id"]: r for r in ctx.forecast_stages(steps, ["id"]).collect()}
    assert (out[1]["most_advanced_stage"], out[1]["earliest_alarm_step"], out[1]["risk_level"]) == ("Reconnaissance", 2, "medium")
    assert (out[2]["most_advanced_stage"], out[2]["earliest_alarm_step"], out[2]["tactic_id"]) == ("Benign", None, None)
    shown = spark.range(1).select(ctx.stage_presentation(F.lit("Impact"), F.lit("high")).alias("s")).first()["s"]
    assert shown["terminal_impact_alert"] and [x["active"] for x in shown["progress_stages"]] == [False] * 5 + [True]


def test_technique_file(spark, tmp_path):
    entry = {"technique_id": "T1046", "technique_name": "n", "tactics": ["Discovery"], "url": "https://attack.mitre.org/techniques/T1046", "stix_id": "a", "modified": "m"}
    document = {"schema": "mitre-attack-enterprise-subset/v1", "attack_version": "1", "data_modified": "d", "collection": {"id": "c"},
                "source": {"publisher": "The MITRE Corporation", "url": "u", "stix_bundle_sha256": "h"},
                "techniques": [entry, dict(entry, technique_id="X1", tactics=["Other"]), dict(entry), dict(entry, technique_id="T1498.001", url="https://attack.mitre.org/techniques/T1498/001")]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(document, indent=1))
    out = ctx.validate_technique_file(spark, str(path))
    problems = {r["technique_id"]: set(r["problems"]) for r in out.collect()}
    assert problems["T1046"] == {"duplicate id"} and problems["T1498.001"] == set()
    assert problems["X1"] == {"invalid id", "url does not match id", "invalid tactic"}
    assert ctx.unknown_techniques(out).count() == 4
    path.write_text(json.dumps({k: v for k, v in document.items() if k != "source"}))
    with pytest.raises(ValueError, match="source"):
        ctx.validate_technique_file(spark, str(path))
