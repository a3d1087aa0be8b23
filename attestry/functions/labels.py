"""Label maps, softmax and label decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names, ids and the order in which ties are resolved.
NLI_LABELS = ("ENTAILMENT", "CONTRADICTION", "NEUTRAL")
CLAIM_TO_NLI = {"SUPPORTS": "ENTAILMENT", "REFUTES": "CONTRADICTION", "NOT ENOUGH INFO": "NEUTRAL"}
CLAIM_LABELS = ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")
VERDICT_TO_CLAIM = {
    "SUPPORTING_EVIDENCE": "SUPPORTS",
    "REFUTING_EVIDENCE": "REFUTES",
    "INSUFFICIENT_EVIDENCE": "NOT ENOUGH INFO",
    "CONFLICTING_EVIDENCE": "CONFLICT",
}
# Status codes with an outcome of their own.
STATUS_OUTCOMES = {401: "unauthorized", 403: "forbidden", 422: "invalid_request", 429: "rate_limited", 503: "unavailable"}


def remap(c: Column, mapping: dict[str, str]) -> Column:
    """Values by a fixed map; others and null give null."""
    first, *rest = mapping.items()
    out = F.when(c == first[0], first[1])
    return reduce(lambda o, kv: o.when(c == kv[0], kv[1]), rest, out)


def label_id(c: Column, labels: tuple[str, ...] = NLI_LABELS) -> Column:
    """Place of a label in ``labels``; null if unknown."""
    place = F.array_position(F.array(*map(F.lit, labels)), c)
    return F.when(place > 0, (place - 1).cast("int"))


def softmax(logits: list[Column], temperature: float | Column = 1.0) -> list[Column]:
    """Softmax shifted by the greatest logit (F23). Null or non-finite logits give null."""
    if not isinstance(temperature, Column) and not 0 < temperature < float("inf"):
        raise ValueError("temperature must be positive and finite")
    scaled = [x.cast("double") / temperature for x in logits]
    top = F.greatest(*scaled)
    powers = [F.exp(x - top) for x in scaled]
    whole = reduce(lambda a, b: a + b, powers)
    finite = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in scaled])
    return [F.when(finite, p / whole) for p in powers]


def probabilities_ok(probabilities: list[Column], tolerance: float = 1e-4) -> Column:
    """Finite, within [0, 1], and of sum 1 within the tolerance."""
    each = reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(p) & p.between(0.0, 1.0), F.lit(False)) for p in probabilities])
    return each & (F.abs(reduce(lambda a, b: a + b, probabilities) - 1.0) <= tolerance)


def top_label(probabilities: list[Column], labels: tuple[str, ...] = NLI_LABELS) -> Column:
    """Label of the greatest probability; the first in order on ties."""
    top = F.greatest(*probabilities)
    out = F.when(probabilities[0] == top, labels[0])
    return reduce(lambda o, x: o.when(x[0] == top, x[1]), list(zip(probabilities, labels))[1:], out)


def status_outcome(code: Column) -> Column:
    """Outcome of a request by its status code (F25); null stays null."""
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for value, name in STATUS_OUTCOMES.items():
        out = out.when(code == value, name)
    return out.when(code >= 500, "server_error").when(code >= 400, "client_error").when(code >= 300, "redirect").otherwise("success")
