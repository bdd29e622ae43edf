"""ATT&CK metadata files and the provenance they give."""

import json

import pytest

from netstate.operators import attack_context as ctx
from netstate.operators.metrics import PROBABILITIES
from netstate.sources import attack_metadata as meta

ENTRY = {"stix_id": "a", "technique_id": "T1046", "technique_name": "n", "tactics": ["Discovery"], "url": "https://x/techniques/T1046", "modified": "m"}
DOCUMENT = {
    "schema": meta.FILE_SCHEMA, "attack_version": "19.1", "data_modified": "d", "collection": {"id": "c"},
    "source": {"publisher": meta.PUBLISHER, "url": "u", "stix_bundle_sha256": "h"},
    "detection_strategies": [{"id": "DET0518", "name": "detect", "analytics": ["AN1", "AN2"], "url": "v"}],
    "mitigations": [{"id": "M1037", "name": "filter", "url": "w"}], "techniques": [ENTRY],
}


def read(spark, tmp_path, **changes):
    path = tmp_path / "metadata.json"
    path.write_text(json.dumps({k: v for k, v in {**DOCUMENT, **changes}.items() if v is not None}, indent=1))
    return meta.read_attack_metadata(spark, str(path))


def test_techniques_carry_defences_and_version(spark, tmp_path):
    row = read(spark, tmp_path).first()
    assert (row.attack_version, row.attack_data_modified, row.metadata_source, row.problems) == ("19.1", "d", "u", [])
    assert row.mitigations[0]["id"] == "M1037" and row.detection_strategies[0]["analytics"] == ["AN1", "AN2"]
    assert read(spark, tmp_path, mitigations=None).first().mitigations == []


def test_problems_of_techniques(spark, tmp_path):
    bad = [ENTRY, ENTRY, dict(ENTRY, technique_id="X1", tactics=["Other"]), {k: v for k, v in ENTRY.items() if k != "modified"} | {"technique_id": "T1498.001", "url": "https://x/T1498/001"}]
    found = [(r.technique_id, set(r.problems)) for r in read(spark, tmp_path, techniques=bad).collect()]
    assert found.count(("T1046", {"duplicate id"})) == 2
    assert ("X1", {"invalid id", "url does not match id", "invalid tactic"}) in found and ("T1498.001", {"missing field"}) in found


@pytest.mark.parametrize(
    "changes", [{"schema": "other"}, {"attack_version": None}, {"source": None}, {"source": {"publisher": "x", "url": "u", "stix_bundle_sha256": "h"}}, {"techniques": []}, {"collection": None}]
)
def test_files_without_provenance_are_refused(spark, tmp_path, changes):
    with pytest.raises(ValueError, match="no valid"):
        read(spark, tmp_path, **changes)


def test_actions_name_their_origin(spark, tmp_path):
    """The current attack guides, or a forecast one that is likely; a benign or unlikely one names nothing."""
    shares = [("BENIGN", 0.9, 0.05, 0.03, 0.02), ("DDoS", 0.1, 0.7, 0.1, 0.1), ("BENIGN", 0.2, 0.1, 0.6, 0.1), ("BENIGN", 0.3, 0.4, 0.2, 0.1), ("PortScan", 0.1, 0.6, 0.2, 0.1)]
    numbers = {c: 50.0 for c in ("flow_count", "unique_dst_port_count", "flows_per_second", "packets_per_second", "syn_count", "rst_count")}
    table = spark.createDataFrame(
        [(i, *row, *numbers.values()) for i, row in enumerate(shares)],
        "id int, current_state string, " + ", ".join(f"{p} double" for p in [*PROBABILITIES, *numbers]),
    )
    out = meta.with_provenance(table, ctx.attack_candidates(table, ["id"]), read(spark, tmp_path), ["id"])
    rows = {r.id: r for r in out.collect()}
    ids = {i: ([m["id"] for m in r.action_mitigations], [m["id"] for m in r.action_detections]) for i, r in rows.items()}
    assert ids == {0: ([], []), 1: (["M1037"], ["DET0518"]), 2: (["M1037"], []), 3: ([], []), 4: ([], [])}
    assert rows[1].action_mitigations[0]["name"] == "filter" and rows[1].attack_mapping == "possible_attack_context" and rows[0].attack_mapping is None
    assert all(r.attack_version == "19.1" and r.requires_operator_validation and r.action_source == meta.PLAYBOOK for r in rows.values())
