"""Label flows: align, score, add signatures, and summarise a capture."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.constants import INVALID_STATE, STATE_CLASSES
from netstate.functions.labels import effective_state
from netstate.functions.values import all_present, finite_number
from netstate.operators.metrics import PROBABILITIES
from netstate.operators.modeling import with_probabilities
from netstate.operators.signatures import attack_class, capture_verdict, signature_states
from netstate.operators.splits import MinMaxModel
from netstate.scale import stage


def score_flows(flows: DataFrame, model, scaler: MinMaxModel, features: Sequence[str]) -> DataFrame:
    """Model state and confidence of every flow; rows with a missing or infinite feature keep the sentinel state.

    Unscoreable rows pass through the model with zeros in the gaps and are masked afterwards, so no row is dropped and
    no join is needed.
    """
    from pyspark.ml.functions import array_to_vector

    cleaned = [finite_number(F.col(f"`{f}`")) for f in features]
    valid = all_present(cleaned)
    vector = array_to_vector(F.array(*[scaler.scaled(f, F.coalesce(c, F.lit(0.0))) for f, c in zip(features, cleaned)]))
    scored = with_probabilities(model.transform(flows.withColumns({"_valid": valid, "features": vector})))
    state = F.when(F.col("_valid"), F.col("y_pred")).otherwise(F.lit(INVALID_STATE))
    confidence = F.when(F.col("_valid"), F.round(F.greatest(*[F.col(p) for p in PROBABILITIES]), 4))
    masked = {p: F.when(F.col("_valid"), F.col(p)) for p in PROBABILITIES}
    return scored.withColumns({"current_state": state, "confidence": confidence, **masked}).drop("_valid", "y_pred", "features")


def label_flows(
    flows: DataFrame, model, scaler: MinMaxModel, features: Sequence[str], rules: Mapping[str, Mapping] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Flows with `current_state`, `confidence`, `signature_state` and `effective_state`.

    The scored flows are stored once, without the columns in `drop`, which no rule may need; every rule reads them again.
    """
    rules = dict(rules or {})
    scored = stage(score_flows(flows.drop("current_state", "signature_state", "effective_state"), model, scaler, features).drop(*drop))
    if scored.where(F.col("current_state") != INVALID_STATE).isEmpty():
        raise ValueError("Every flow has an invalid or missing feature.")
    signed = signature_states(scored, rules.get("flood"), rules.get("syn"), rules.get("sweep"))
    return signed.withColumn("effective_state", effective_state(F.col("current_state"), F.col("signature_state")))


def capture_report(labelled: DataFrame) -> DataFrame:
    """Verdicts of the model states and of the effective states, confirmed by the signature class."""
    confirmed = attack_class(labelled).first()["attack_class"]
    model = capture_verdict(labelled, "current_state", confirmed).withColumn("source", F.lit("model"))
    effective = capture_verdict(
        labelled.where(F.col("effective_state").isin(STATE_CLASSES)), "effective_state", confirmed
    ).withColumn("source", F.lit("effective"))
    return model.unionByName(effective)
