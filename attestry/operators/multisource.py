"""Claims held against passages of several documents: integrity, scoring, families, context and corroboration as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import families, layout
from attestry.operators.verify import Scorer, externally_grounded, lexical_scorer, scored_pairs
from attestry.operators.versions import snapshot_problem
from attestry.session import shared_checkpoint

# Fields of a source's profile and the flags they raise.
PROFILE_FLAGS = {
    "publisher_name": "PUBLISHER_NAME_REPORTED", "homepage_url": "HOMEPAGE_URL_RECORDED", "editorial_policy_url": "EDITORIAL_POLICY_URL_RECORDED",
    "corrections_policy_url": "CORRECTIONS_POLICY_URL_RECORDED", "ownership_disclosure_url": "OWNERSHIP_DISCLOSURE_URL_RECORDED",
}


@dataclass(frozen=True)
class Assessment:
    """summary: one row per case. findings: one row per scored passage. relations: pairs of documents. rejected: passages that are no span of their snapshot."""

    summary: DataFrame
    findings: DataFrame
    relations: DataFrame
    rejected: DataFrame


def document_context(
    docs: DataFrame, observations: DataFrame, profiles: DataFrame, assessed: Column, reference: Column, max_age_days: Column, partitions: int | None = None
) -> DataFrame:
    """(doc_id, relation, freshness, flags, warnings) of each document (D8): fetch, dates and the newest profile of its source.

    docs: doc_id, source_id, sha256, published_at, retrieved_at. observations: doc_id, outcome, observed_at. profiles: source_id,
    observed_at, method and any of the fields of PROFILE_FLAGS. Only what was observed up to ``assessed`` counts; of profiles of one
    time that with the greatest method. A hash that is none is flagged in the warnings.
    """
    fetched = observations.where((F.col("outcome") == "FETCHED") & (F.col("observed_at") <= assessed)).select("doc_id").distinct().withColumn("_fetched", F.lit(True))
    fields = [c for c in PROFILE_FLAGS if c in profiles.columns]
    seen = profiles.where(F.col("observed_at") <= assessed).select("source_id", "observed_at", "method", *fields)
    x = layout.latest_as_of(docs.withColumn("_at", assessed), seen, ["source_id"], "_at", "observed_at", "method", partitions)
    x = x.withColumnRenamed("observation", "_p").join(fetched, "doc_id", "left")
    time = families.time_context(F.col("published_at"), F.col("retrieved_at"), assessed, reference, max_age_days)
    known, hashed = F.col("_p").isNotNull(), F.col("sha256").rlike("^[0-9a-f]{64}$")
    flags = families.ordered_warnings(
        (hashed, "IMMUTABLE_CONTENT_HASH"), (F.col("_fetched"), "MATCHED_FETCH_OBSERVATION"), (F.col("published_at").isNotNull(), "PUBLICATION_TIME_RECORDED"),
        (known, "SOURCE_PROFILE_OBSERVED"), *[(F.col(f"_p.{c}") != "", PROFILE_FLAGS[c]) for c in fields],
    )
    method = F.when(known, F.array(F.concat(F.lit("PROFILE_METHOD_"), F.coalesce("_p.method", F.lit("UNKNOWN"))))).otherwise(F.array().cast("array<string>"))
    missing = families.ordered_warnings(
        (~F.coalesce(hashed, F.lit(False)), "CONTENT_HASH_INVALID"), (F.col("_fetched").isNull(), "FETCH_OBSERVATION_NOT_FOUND"), (~known, "SOURCE_PROFILE_NOT_OBSERVED")
    )
    return x.select("doc_id", time.alias("t"), F.concat(flags, method).alias("flags"), missing.alias("m")).select(
        "doc_id", "t.relation", "t.freshness", "flags", F.concat("m", "t.warnings").alias("warnings")
    )


def assess(
    cases: DataFrame, passages: DataFrame, docs: DataFrame, context: DataFrame, scorer: Scorer = lexical_scorer, threshold: float = 0.9
) -> Assessment:
    """Cases over their passages (V15). A case holds 2 to 50 documents; the caller sees to it.

    cases: case, claim. passages: case, doc_id, ordinal, start_offset, end_offset, text, sha256. docs: case, doc_id, source_id,
    origin, content, content_sha256. context: as of ``document_context``. A passage is admissible if the claim's subject is
    grounded in it and its document was fetched. A case without a sound passage has no row in the summary.
    """
    whole = passages.join(docs.select("case", "doc_id", "content", "content_sha256"), ["case", "doc_id"])
    problem = snapshot_problem(F.col("content"), F.col("content_sha256"), F.col("start_offset"), F.col("end_offset"), F.col("text"), F.col("sha256"))
    checked = shared_checkpoint(whole.withColumn("problem", problem).drop("content", "content_sha256"), "passages")
    scored = scored_pairs(checked.where("problem is null").join(cases, "case"), scorer)
    c = context.select("doc_id", "relation", "freshness", F.array_contains("flags", "MATCHED_FETCH_OBSERVATION").alias("_fetched"))
    evidence = scored.join(c, "doc_id", "left").select(
        "case", "doc_id", "ordinal", F.col("nli_label").alias("stance"), "confidence", ((F.col("nli_label") != "NEUTRAL") & (F.col("confidence") >= threshold)).alias("nli_accepted"),
        (externally_grounded(F.col("claim"), F.col("text")) & F.coalesce("_fetched", F.lit(False))).alias("admissible"), "relation", "freshness",
    )
    relations = shared_checkpoint(families.pair_relations(docs, "case", "doc_id", "source_id", "content", origin="origin"), "relations")
    grouped = families.group_families(docs, relations, "case", "doc_id")
    found = shared_checkpoint(families.findings(evidence, grouped, ["case", "doc_id"], threshold), "findings")
    summary = families.corroboration(found, "case", "doc_id", relations)
    of_family = families.family_warnings(relations, "case").withColumnRenamed("warnings", "_w")
    always = F.array(F.lit("SUBJECT_GROUNDING_IS_HEURISTIC_NOT_ENTITY_LINKING"), F.lit("MULTISOURCE_NLI_NOT_EVALUATED_ON_EXTERNAL_GOLD_LABELS"))
    warnings = F.array_distinct(F.concat(F.coalesce("_w", F.array().cast("array<string>")), "warnings", always))
    summary = summary.join(of_family, "case", "left").withColumn("warnings", warnings).drop("_w")
    return Assessment(summary, found, relations, checked.where("problem is not null"))
