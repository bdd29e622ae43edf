"""Advisory ATT&CK context and kill-chain stages for state forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.constants import (
    ALARM_PROBABILITY, ATTACK_CLASSES, INVALID_STATE, STAGE_LADDER, STATE_CLASSES, STATE_TO_STAGE,
)
from netstate.functions.values import argmax_label, finite_number, literal_map
from netstate.operators.metrics import PROBABILITIES

# Fixed values of the public ATT&CK release: id, name, tactic.
TECHNIQUES = [
    ("T1046", "Network Service Discovery", "Discovery"),
    ("T1595", "Active Scanning", "Reconnaissance"),
    ("T1498", "Network Denial of Service", "Impact"),
    ("T1498.001", "Direct Network Flood", "Impact"),
    ("T1498.002", "Reflection Amplification", "Impact"),
    ("T1499", "Endpoint Denial of Service", "Impact"),
]
# Techniques per state in rule order; sub-techniques never exceed low confidence.
STATE_TECHNIQUES = {
    "PortScan": ["T1595", "T1046"],
    "DDoS": ["T1498", "T1498.001", "T1498.002"],
    "DoS": ["T1499"],
}
SUB_TECHNIQUES = ["T1498.001", "T1498.002"]
VALID_TACTICS = ["Reconnaissance", "Discovery", "Impact"]
# Fixed texts that candidates carry: what flows cannot show, per technique and in general.
LIMITATIONS = {
    "T1595": "Flow data cannot establish whether scanning occurred before compromise.",
    "T1046": "Flow data cannot establish whether scanning occurred from a compromised internal host.",
    "T1498": "Flow statistics cannot identify distributed sources or a specific network-flood sub-technique here.",
    "T1498.001": "Direct-flood context requires protocol and source validation beyond aggregate flow statistics.",
    "T1498.002": "Reflection amplification requires spoofing, reflector, and amplification-protocol evidence.",
    "T1499": "Flow statistics cannot identify an endpoint exhaustion or exploitation sub-technique.",
}
GENERAL_LIMITATIONS = [
    "Network-flow evidence alone cannot confirm adversary intent or host/process behavior.",
    "Mapping confidence is a deterministic heuristic evidence score, not a calibrated probability.",
]
# Fixed playbook texts per state: severity, operator guidance, evidence to collect.
GUIDANCE = {
    "DDoS": (
        "high",
        [
            "Validate that sources are distributed within the same rolling window.",
            "Identify the concentrated victim IP, service, and business owner.",
            "Engage the ISP, CDN, or DDoS provider for upstream filtering.",
            "Apply risk-reviewed rate limits or protocol/port filtering.",
            "Preserve the capture, flow export, service telemetry, and response timeline.",
        ],
        [
            "Concurrent source and victim concentration across rolling windows.",
            "Victim service saturation, latency, error rate, and interface utilization.",
            "Protocol details sufficient to distinguish direct flood from reflection/amplification.",
        ],
    ),
    "DoS": (
        "high",
        [
            "Inspect the affected service and host health.",
            "Check connection-table, thread, socket, and SYN-backlog exhaustion.",
            "Apply service-specific rate limits and validate recovery.",
            "Preserve flow and endpoint evidence before blocking confirmed sources.",
        ],
        ["Service health and resource exhaustion telemetry.", "Connection state and rate-limit logs."],
    ),
    "PortScan": (
        "medium",
        [
            "Verify whether the scan was authorized.",
            "Review exposed services and recent configuration changes.",
            "Monitor or block confirmed unauthorized sources using change control.",
            "Preserve flow and firewall evidence.",
        ],
        ["Scanner ownership and authorization.", "Destination service inventory and firewall logs."],
    ),
}
DEFAULT_GUIDANCE = (
    "informational",
    [
        "Continue monitoring and compare traffic with the established baseline.",
        "Preserve the capture and analysis result.",
        "Collect endpoint and service evidence if operational symptoms appear.",
    ],
    ["Additional rolling-window traffic.", "Endpoint, service, and network-device telemetry."],
)


def technique_dimension(spark: SparkSession) -> DataFrame:
    """State -> technique rows with name, tactic and limitation: six rows by construction."""
    facts = {technique: (name, tactic) for technique, name, tactic in TECHNIQUES}
    rows = [
        (state, technique, *facts[technique], LIMITATIONS[technique], technique in SUB_TECHNIQUES)
        for state, techniques in STATE_TECHNIQUES.items()
        for technique in techniques
    ]
    return spark.createDataFrame(
        rows,
        "state string, technique_id string, technique_name string, tactic string, limitation string, sub_technique boolean",
    )


def general_number(column: Column) -> Column:
    """A number with six significant digits, without trailing zeros and in scientific form when very large or small."""
    return number_text(column, F.format_string("%.5e", F.abs(column)))


def number_text(column: Column, text: Column) -> Column:
    """:func:`general_number` from the scientific text of the absolute value, which is used many times."""
    exponent = F.substring_index(text, "e", -1).cast("int")
    digits = F.regexp_replace(F.substring_index(text, "e", 1), r"\.", "")
    whole = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(6)))
    fraction = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    mantissa = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), F.lit(5)))

    def trimmed(value: Column) -> Column:
        return F.regexp_replace(value, r"\.?0*$", "")

    power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = (
        F.when((exponent >= 0) & (exponent < 6), trimmed(whole))
        .when((exponent < 0) & (exponent >= -4), trimmed(fraction))
        .otherwise(F.concat(trimmed(mantissa), power))
    )
    return F.when(column == 0, F.lit("0")).otherwise(F.concat(F.when(column < 0, F.lit("-")).otherwise(F.lit("")), plain))


EVIDENCE_FEATURES = [
    "flow_count", "unique_dst_port_count", "flows_per_second", "packets_per_second", "syn_count", "rst_count",
]


def _with_evidence_numbers(rows: DataFrame) -> DataFrame:
    """Cleaned window features `_v_*` and their texts `_n_*`, each computed once per row."""
    rows = rows.withColumns({f"_v_{n}": F.coalesce(finite_number(F.col(n)), F.lit(0.0)) for n in EVIDENCE_FEATURES})
    rows = rows.withColumns({f"_e_{n}": F.format_string("%.5e", F.abs(f"_v_{n}")) for n in EVIDENCE_FEATURES})
    return rows.withColumns({f"_n_{n}": number_text(F.col(f"_v_{n}"), F.col(f"_e_{n}")) for n in EVIDENCE_FEATURES})


def _behaviour(state: Column) -> Column:
    """Evidence texts that the window features give for a state."""
    value = {n: F.col(f"_v_{n}") for n in EVIDENCE_FEATURES}
    ports, flows, syn = value["unique_dst_port_count"], value["flow_count"], value["syn_count"]

    def told(template: str, name: str) -> Column:
        before, after = template.split("{}")
        return F.concat(F.lit(before), F.col(f"_n_{name}"), F.lit(after))

    scan = F.array(
        F.when(ports >= 10, told("destination-port diversity is elevated ({} unique ports)", "unique_dst_port_count")),
        F.when(
            (flows > 0) & (ports / F.nullif(flows, F.lit(0.0)) >= 0.5),
            F.lit("destination-port diversity spans at least half of observed flows"),
        ),
        F.when(
            syn >= F.greatest(F.lit(5.0), flows * 0.5), told("repeated SYN behavior is present ({} SYN flags)", "syn_count")
        ),
    )
    rate, packets, rst = value["flows_per_second"], value["packets_per_second"], value["rst_count"]
    flood = F.array(
        F.when(rate >= 10, told("connection rate is elevated ({} flows/s)", "flows_per_second")),
        F.when(packets >= 100, told("packet rate is elevated ({} packets/s)", "packets_per_second")),
        F.when(syn >= 20, told("high SYN volume is present ({} SYN flags)", "syn_count")),
        F.when(rst >= 10, told("high RST volume is present ({} RST flags)", "rst_count")),
    )
    return F.array_compact(F.when(state == "PortScan", scan).otherwise(flood))


def with_forecast_context(forecasts: DataFrame, probabilities: Sequence[str] = PROBABILITIES) -> DataFrame:
    """Add predicted state and probability, the states to examine, severity, guidance and the reason for silence."""
    values = [F.coalesce(F.col(p), F.lit(0.0)) for p in probabilities]
    share = dict(zip(STATE_CLASSES, values))
    current = F.col("current_state")
    forecasts = forecasts.withColumns(
        {"predicted_next_state": argmax_label(values, STATE_CLASSES), "forecast_probability": F.greatest(*values)}
    )
    predicted, best = F.col("predicted_next_state"), F.col("forecast_probability")
    attacks_now, attacks_next = current.isin(ATTACK_CLASSES), predicted.isin(ATTACK_CLASSES)
    forecasts = forecasts.withColumn(
        "_guided", F.when(attacks_now, current).when(attacks_next & (best >= 0.50), predicted)
    )
    guided = F.col("_guided")
    quiet = (current == "BENIGN") & (predicted == "BENIGN") & (1.0 - share["BENIGN"] < 0.50)
    order = list(STATE_TECHNIQUES)
    fallback = argmax_label([share[s] for s in order], order)
    examined = F.array_compact(
        F.array(F.when(attacks_now, current), F.when(attacks_next & ~(attacks_now & (predicted == current)), predicted))
    )
    examined = F.when(F.size(examined) > 0, examined).otherwise(F.array(fallback))
    silent = (current == INVALID_STATE) | quiet

    def guidance(part: int) -> Column:
        def literal(value):
            return F.lit(value) if part == 0 else F.array(*[F.lit(text) for text in value])

        chain = F.coalesce(*[F.when(guided == s, literal(GUIDANCE[s][part])) for s in GUIDANCE])
        return F.coalesce(chain, literal(DEFAULT_GUIDANCE[part]))

    return forecasts.withColumns(
        {
            "attack_present": attacks_now,
            "severity": guidance(0),
            "operator_guidance": guidance(1),
            "evidence_needed": guidance(2),
            "reason": F.when(current == INVALID_STATE, F.lit("invalid features cannot support ATT&CK interpretation")).when(
                quiet, F.lit("no attack evidence")
            ),
            "examined_states": F.when(~silent, examined).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_guided")


def attack_candidates(
    forecasts: DataFrame, keys: Sequence[str], probabilities: Sequence[str] = PROBABILITIES
) -> DataFrame:
    """One row per technique candidate of every forecast, with status, confidence and evidence.

    A candidate is POSSIBLE when window behaviour supports its state and the state is current or at least as likely
    as not. The technique table has six rows, so it is broadcast.
    """
    share = F.coalesce(*[F.when(F.col("state") == c, F.coalesce(F.col(p), F.lit(0.0))) for c, p in zip(STATE_CLASSES, probabilities)])
    rows = _with_evidence_numbers(with_forecast_context(forecasts, probabilities))
    # The outer form keeps silent forecasts with a NULL state, which the technique join drops; the plain form would push
    # a copy of the whole state expression down as a filter.
    rows = rows.withColumn("state", F.explode_outer("examined_states"))
    rows = rows.withColumns({"_behaviour": _behaviour(F.col("state")), "_share": share})
    is_current = F.col("current_state") == F.col("state")
    likely = F.col("_share") >= 0.50
    possible = (F.size("_behaviour") > 0) & (is_current | likely)
    observed = F.array_compact(
        F.array(
            F.when(is_current, F.concat(F.lit("observed current network state is "), F.col("state"))),
            F.when(
                F.col("_share") >= 0.25,
                F.format_string("LSTM next-state probability for %s is %.3f", F.col("state"), F.bround("_share", 3)),
            ),
        )
    )
    confidence = F.when(possible & is_current & likely, 0.65).when(possible, 0.55).otherwise(0.25)
    joined = rows.join(F.broadcast(technique_dimension(forecasts.sparkSession)), "state")
    capped = F.col("sub_technique")
    return joined.select(
        *keys,
        "current_state",
        "predicted_next_state",
        "state",
        "technique_id",
        "technique_name",
        "tactic",
        F.when(possible & ~capped, F.lit("POSSIBLE")).otherwise(F.lit("INSUFFICIENT_EVIDENCE")).alias("mapping_status"),
        F.when(possible & capped, F.lit(0.25)).otherwise(confidence).alias("mapping_confidence"),
        F.concat(observed, F.col("_behaviour")).alias("evidence"),
        F.array(*[F.lit(text) for text in GENERAL_LIMITATIONS], F.col("limitation")).alias("limitations"),
        "severity",
    )


def mapping_summary(forecasts: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per forecast: whether any technique is possible, the best confidence, and the reason."""
    found = candidates.groupBy(*keys).agg(
        F.bool_or(F.col("mapping_status") == "POSSIBLE").alias("_possible"),
        F.max("mapping_confidence").alias("mapping_confidence"),
    )
    joined = with_forecast_context(forecasts).join(found, list(keys), "left")
    possible = F.coalesce("_possible", F.lit(False))
    return joined.select(
        *keys,
        "current_state",
        "predicted_next_state",
        "severity",
        F.when(possible, F.lit("POSSIBLE")).otherwise(F.lit("INSUFFICIENT_EVIDENCE")).alias("mapping_status"),
        "mapping_confidence",
        F.coalesce(
            "reason",
            F.when(possible, F.lit("network-flow evidence supports possible ATT&CK context")).otherwise(
                F.lit("traffic-state evidence is insufficient for an ATT&CK technique assertion")
            ),
        ).alias("reason"),
        "operator_guidance",
        "evidence_needed",
    )


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Most confident candidates first."""
    return candidates.orderBy(F.desc("mapping_confidence"), "technique_id")


def state_to_stage(state: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(STATE_TO_STAGE), state), F.lit("Unknown"))


def stage_tactic(stage: Column) -> Column:
    return F.try_element_at(literal_map(dict(STAGE_LADDER)), stage)


def stage_rung(stage: Column) -> Column:
    """Position on the ladder, -1 for stages that are not on it."""
    return F.coalesce(
        F.try_element_at(literal_map({name: i for i, (name, _) in enumerate(STAGE_LADDER)}), stage), F.lit(-1)
    )


def risk_level(probability: Column) -> Column:
    return F.when(probability >= 0.80, F.lit("high")).when(probability >= 0.50, F.lit("medium")).otherwise(F.lit("low"))


def stage_presentation(stage: Column, risk: Column) -> Column:
    """Stage with tactic, ladder with the active rung, and the terminal alert."""
    ladder = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(tactic).alias("tactic_id"), (stage == name).alias("active"))
            for name, tactic in STAGE_LADDER
        ]
    )
    terminal = stage == "Impact"
    return F.struct(
        stage.alias("predicted_stage"),
        stage_tactic(stage).alias("tactic_id"),
        ladder.alias("progress_stages"),
        (terminal & (risk == "high")).alias("terminal_impact_alert"),
        F.when(terminal, F.lit("TA0040")).alias("terminal_tactic_id"),
    )


def forecast_stages(
    steps: DataFrame, keys: Sequence[str], current: str = "current_state", step: str = "step",
    predicted: str = "y_pred", benign: str = PROBABILITIES[0], alarm: float = ALARM_PROBABILITY,
) -> DataFrame:
    """Per forecast: highest infiltration probability, first alarm step, and the most advanced stage reached."""
    infiltration = F.round(1.0 - F.col(benign), 4)
    names = F.array(*[F.lit(name) for name, _ in STAGE_LADDER])
    grouped = steps.groupBy(*keys).agg(
        F.max(infiltration).alias("infiltration_probability"),
        F.min(F.when(infiltration >= alarm, F.col(step))).alias("earliest_alarm_step"),
        F.max(F.greatest(stage_rung(state_to_stage(F.col(predicted))), stage_rung(state_to_stage(F.col(current))))).alias(
            "_rung"
        ),
        F.max(F.when(stage_rung(state_to_stage(F.col(current))) < 0, state_to_stage(F.col(current)))).alias("_start"),
    )
    stage = F.when(F.col("_rung") >= 0, F.element_at(names, F.col("_rung") + 1)).otherwise(F.col("_start"))
    return grouped.select(
        *keys,
        "infiltration_probability",
        "earliest_alarm_step",
        stage.alias("most_advanced_stage"),
        stage_tactic(stage).alias("tactic_id"),
        risk_level(F.col("infiltration_probability")).alias("risk_level"),
    )


def validate_technique_file(spark: SparkSession, path: str) -> DataFrame:
    """Techniques of an ATT&CK subset file with the rules each one breaks; the file must name its source."""
    document = spark.read.option("multiLine", True).json(path)
    needed = {"schema", "attack_version", "data_modified", "source", "collection", "techniques"}
    missing = needed - set(document.columns)
    if missing:
        raise ValueError(f"ATT&CK file lacks {sorted(missing)}")
    head = document.select("schema", "source.publisher", "source.url", "source.stix_bundle_sha256").first()
    if head["schema"] != "mitre-attack-enterprise-subset/v1" or not (head["url"] and head["stix_bundle_sha256"]):
        raise ValueError("ATT&CK file has no valid provenance.")
    if head["publisher"] != "The MITRE Corporation":
        raise ValueError("ATT&CK file has no valid publisher.")
    techniques = document.select(F.explode("techniques").alias("t")).select("t.*")
    copies = techniques.groupBy("technique_id").agg(F.count(F.lit(1)).alias("_copies"))
    suffix = F.concat(F.lit("/"), F.translate("technique_id", ".", "/"))
    tactics = F.array(*[F.lit(t) for t in VALID_TACTICS])
    checks = {
        "invalid id": ~F.col("technique_id").rlike(r"^T\d{4}(\.\d{3})?$"),
        "url does not match id": ~F.col("url").endswith(suffix),
        "invalid tactic": (F.size("tactics") == 0) | (F.size(F.array_except("tactics", tactics)) > 0),
        "duplicate id": F.col("_copies") > 1,
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    return techniques.join(copies, "technique_id", "left").withColumn("problems", broken).drop("_copies")


def unknown_techniques(techniques: DataFrame) -> DataFrame:
    """Technique ids that the rules need and the table lacks."""
    needed = technique_dimension(techniques.sparkSession).select("technique_id")
    return needed.exceptAll(techniques.select("technique_id"))
