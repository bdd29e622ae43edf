"""Raw dataset labels to the four traffic states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netstate.constants import INVALID_STATE, STATE_CLASSES
from netstate.functions.values import state_or_sentinel

# Fixed label spellings of the public flow dataset.
EXACT_LABELS = {
    "benign": "BENIGN",
    "ddos": "DDoS",
    "dos hulk": "DoS",
    "dos goldeneye": "DoS",
    "dos slowloris": "DoS",
    "dos slowhttptest": "DoS",
    "heartbleed": "DoS",
    "portscan": "PortScan",
}


def _normal(label: Column, dashes: str) -> Column:
    return F.translate(F.lower(F.trim(label)), dashes, "-" * len(dashes))


def evaluation_state(label: Column) -> Column:
    """Label used to evaluate a classifier; Heartbleed counts as DoS, labels out of scope become NULL."""
    text = _normal(label, "\x96–")
    exact = F.create_map(*[F.lit(part) for pair in EXACT_LABELS.items() for part in pair])
    return F.coalesce(
        F.try_element_at(exact, text),
        F.when(text.startswith("dos "), F.lit("DoS")),
        F.when(text.contains("ddos"), F.lit("DDoS")),
    )


def training_state(label: Column) -> Column:
    """Label used to train forecasters; unlike :func:`evaluation_state` Heartbleed is out of scope."""
    text = _normal(label, "–")
    return (
        F.when(text == "benign", F.lit("BENIGN"))
        .when(text.contains("ddos"), F.lit("DDoS"))
        .when(text.startswith("dos ") | (text == "dos"), F.lit("DoS"))
        .when(text.contains("portscan") | text.contains("port scan"), F.lit("PortScan"))
    )


def training_state_or_invalid(label: Column) -> Column:
    state = training_state(label)
    return state_or_sentinel(state.isNotNull(), state, INVALID_STATE)


def effective_state(model_state: Column, signature_state: Column) -> Column:
    """The model's state, except that a signature speaks for rows the model left benign or could not score."""
    return F.when(
        (signature_state != "BENIGN") & model_state.isin("BENIGN", INVALID_STATE), signature_state
    ).otherwise(model_state)
