"""Queries that take all claims: none is left out by its id."""

import pytest

from attestry.operators.dataset import usable_claims
from attestry.plans import registry
from attestry.sources.tables import table


def _claims(spark, folder):
    """(split:claim_id of all claims, of those with a known label)."""
    c = usable_claims(table(spark, folder, "claims")).selectExpr("split || ':' || claim_id AS qid", "label").collect()
    return {r["qid"] for r in c}, {r["qid"] for r in c if r["label"] in ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")}


@pytest.mark.parametrize("name", ["claim_decisions", "evidence_screening", "grounded_evidence", "reranked", "hybrid_retrieval"])
def test_every_claim_has_rows(spark, folder, name):
    assert {r["qid"] for r in registry.queries()[name](spark, folder).select("qid").distinct().collect()} == _claims(spark, folder)[0]


def test_verdict_confusion_counts_all_claims(spark, folder):
    assert sum(r["n"] for r in registry.queries()["verdict_confusion"](spark, folder).collect()) == len(_claims(spark, folder)[1])


def test_verdict_selective_counts_all_claims(spark, folder):
    assert registry.queries()["verdict_selective"](spark, folder).head()["total"] == len(_claims(spark, folder)[1])


def test_failure_rows_leave_out_no_claim(spark, folder):
    rows = registry.queries()["failure_rows"](spark, folder).collect()
    right = sum(r["n"] for r in registry.queries()["verdict_confusion"](spark, folder).where("gold = predicted").collect())
    assert len(rows) + right == len(_claims(spark, folder)[1])


def test_benchmark_summary_counts_all_claims(spark, folder):
    assert registry.queries()["benchmark_summary"](spark, folder).head()["total"] == len(_claims(spark, folder)[1])


def test_gold_set_hits_of_all_claims_with_evidence(spark, folder):
    gold = registry.queries()["gold_pages"](spark, folder).selectExpr("split || ':' || claim_id AS qid").distinct().collect()
    found = registry.queries()["gold_set_hits"](spark, folder).collect()
    assert {r["qid"] for r in found} == {r["qid"] for r in gold} & _claims(spark, folder)[0]
