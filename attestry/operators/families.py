"""Documents of one origin: pair relations, families as connected components, votes by family, time context."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.labels import remap
from attestry.functions.text import folded_tokens, shingles, tokens
from attestry.session import shared_checkpoint


def connected_components(nodes: DataFrame, links: DataFrame, node: str, rounds: int = 50) -> DataFrame:
    """(``node``, component): the smallest node of each component (V10). ``links`` has columns a and b.

    Each node of a link hooks on to the smallest node it sees, hooks are followed to their ends by doubling, and links
    drawn anew between the ends. Only nodes smaller than all they see are ends, half of the nodes at most, and settled
    components have no links left, so the rounds are few and shrink. Link equal keys to one hub, not to each other.
    """
    left = shared_checkpoint(links.select("a", "b").where("a <> b").distinct(), "links")
    hooks: list[DataFrame] = []
    for _ in range(rounds):
        if not left.limit(1).count():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook, moved = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select("a", "to"), True
        while moved:
            hook = shared_checkpoint(hook, "hooks")
            next_ = hook.join(hook.select(F.col("a").alias("to"), F.col("to").alias("next")), "to")
            moved = bool(next_.where("next <> to").limit(1).count())
            hook = next_.select("a", F.col("next").alias("to")) if moved else hook
        hooks.append(hook)
        drawn = left.join(hook, "a").select(F.col("to").alias("x"), "b").join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = shared_checkpoint(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    # The nodes of a round's hooks are those of the round before hooked on to, so tables shrink as they are followed back.
    found = None
    for hook in reversed(hooks):
        if found is not None:
            hook = shared_checkpoint(hook.join(found.select(F.col("a").alias("to"), F.col("to").alias("last")), "to", "left").select("a", F.coalesce("last", "to").alias("to")), "found")
        found = hook
    out = nodes.select(F.col(node).alias("a")).distinct()
    out = out.withColumn("to", F.col("a")) if found is None else out.join(found, "a", "left").select("a", F.coalesce("to", "a").alias("to"))
    return out.select(F.col("a").alias(node), F.col("to").alias("component"))


def key_links(docs: DataFrame, node: str, key: Column) -> DataFrame:
    """Links (a, b) of every document with the smallest one of the same key; null keys link nothing. As many links as documents."""
    keyed = docs.select(F.col(node).alias("a"), key.alias("_k")).where("_k is not null")
    return keyed.join(keyed.groupBy("_k").agg(F.min("a").alias("b")), "_k").select("a", "b").where("a <> b")


def source_families(docs: DataFrame, node: str, publisher: str, text: str, origin: str | None = None, least_words: int = 12) -> DataFrame:
    """(node, component): same publisher, same declared origin, or the same words (``least_words`` or more) chain documents."""
    words = tokens(F.col(text))
    keys = [F.col(publisher).cast("string"), F.when(F.size(words) >= least_words, F.sha2(F.array_join(words, " "), 256))]
    if origin:
        keys.append(F.sha2(F.col(origin), 256))
    links = reduce(DataFrame.unionByName, [key_links(docs, node, k) for k in keys])
    return connected_components(docs, links, node)


# Relations of two documents, whether they join a family, and what they rest on.
RELATIONS = {
    "SAME_PUBLISHER": (True, "same_registered_source_id"),
    "DECLARED_COMMON_ORIGIN": (True, "matching_reported_origin_with_observation_urls"),
    "IDENTICAL_TEXT": (True, "identical_normalized_full_snapshot_text"),
    "POSSIBLE_TEXT_REUSE": (False, "five_word_shingle_similarity_review"),
    "UNDETERMINED": (False, "no_strong_reuse_signal"),
}


def pair_relations(
    docs: DataFrame, group: str, node: str, publisher: str, text: str, least_same: int = 12, least_near: int = 80, near: float = 0.85,
    origin: str | None = None, words: Callable[[Column], Column] = folded_tokens,
) -> DataFrame:
    """Relation of every pair of documents of one assessment ``group``, which the caller keeps small.

    (group, left_id, right_id, relation, similarity, group_together, basis). ``origin`` names the column of the declared
    origin, of one canonical form; null and empty declare none. Similarity is the Jaccard share of common five-word runs,
    worked out where no other rule holds and both texts are long enough.
    """
    # Texts are laid out by group before they are cut up, so that words and runs are not shuffled.
    docs = docs.select(*dict.fromkeys(c for c in (group, node, publisher, text, origin) if c)).repartition(group)
    x = docs.select(group, F.col(node).alias("n"), F.col(publisher).alias("p"), (F.col(origin).cast("string") if origin else F.lit(None).cast("string")).alias("o"), words(F.col(text)).alias("w"))
    x = x.withColumn("s", F.when(F.size("w") >= least_near, shingles(F.col("w"))))
    a = x.select(group, F.col("n").alias("left_id"), F.col("p").alias("pa"), F.col("o").alias("oa"), F.col("w").alias("wa"), F.col("s").alias("sa"))
    b = x.select(group, F.col("n").alias("right_id"), F.col("p").alias("pb"), F.col("o").alias("ob"), F.col("w").alias("wb"), F.col("s").alias("sb"))
    y = a.join(b, group).where("left_id < right_id")
    j = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    same = (F.col("wa") == F.col("wb")) & (F.size("wa") >= least_same)
    publisher_same = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    origin_same = F.coalesce((F.col("oa") == F.col("ob")) & (F.col("oa") != ""), F.lit(False))
    kept = F.when(publisher_same, "SAME_PUBLISHER").when(origin_same, "DECLARED_COMMON_ORIGIN").when(same, "IDENTICAL_TEXT")
    y = y.withColumn("sure", kept).withColumn("similarity", F.when(F.col("sure").isNull() & F.col("sa").isNotNull() & F.col("sb").isNotNull(), F.round(j, 6)))
    relation = F.coalesce("sure", F.when(F.col("similarity") >= near, "POSSIBLE_TEXT_REUSE").otherwise("UNDETERMINED"))
    basis = remap(F.col("relation"), {k: v[1] for k, v in RELATIONS.items()})
    short = (F.col("relation") == "UNDETERMINED") & F.col("similarity").isNull()
    return y.select(group, "left_id", "right_id", relation.alias("relation"), "similarity").withColumns(
        {
            "group_together": F.col("relation").isin(*[k for k, v in RELATIONS.items() if v[0]]),
            "basis": F.when(short, "insufficient_evidence_of_shared_or_independent_reporting").otherwise(basis),
        }
    )


def ordered_warnings(*rules: tuple[Column, str]) -> Column:
    """The names whose rule holds, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in rules]))


def family_warnings(relations: DataFrame, group: str) -> DataFrame:
    """(group, warnings) of each group with a pair."""
    seen = lambda r: F.bool_or(F.col("relation") == r)
    x = relations.groupBy(group).agg(seen("POSSIBLE_TEXT_REUSE").alias("near"), seen("DECLARED_COMMON_ORIGIN").alias("origin"))
    warnings = ordered_warnings(
        (F.lit(True), "INDEPENDENCE_NOT_PROVEN"), (F.lit(True), "NO_CLAIM_TRUTH_INFERENCE"),
        (F.col("near"), "POSSIBLE_SYNDICATION_REQUIRES_REVIEW"), (F.col("origin"), "ORIGIN_ATTRIBUTION_NOT_INDEPENDENTLY_VERIFIED"),
    )
    return x.select(group, warnings.alias("warnings"))


def group_families(docs: DataFrame, relations: DataFrame, group: str, node: str) -> DataFrame:
    """(group, node, component): the families within each group; documents chain only there."""
    key = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("n"))
    links = relations.where("group_together").select(key("left_id").alias("a"), key("right_id").alias("b"))
    found = connected_components(docs.select(key(node).alias("_k")), links, "_k")
    return found.select(F.col("_k.g").alias(group), F.col("_k.n").alias(node), F.col("component.n").alias("component"))


def findings(evidence: DataFrame, families: DataFrame, keys: list[str], threshold: float = 0.9) -> DataFrame:
    """Evidence with its ``component`` and ``decision``.

    ``evidence`` holds ``keys``, by which ``families`` is joined, stance, confidence, nli_accepted, admissible, relation and
    freshness (null where a document's dates were not assessed). Evidence of a document without a family is left out.
    """
    decision = (
        F.when(~F.col("stance").isin("ENTAILMENT", "CONTRADICTION"), "NEUTRAL")
        .when(~F.col("nli_accepted"), "NLI_NOT_ACCEPTED")
        .when(~F.col("admissible"), "ADMISSIBILITY_BLOCKED")
        .when(F.col("confidence") < threshold, "BELOW_CONFIDENCE_THRESHOLD")
        .when(F.col("freshness").isin("OLDER_THAN_WINDOW", "FUTURE_DATED"), "TEMPORAL_REVIEW_REQUIRED")
        .otherwise("ELIGIBLE")
    )
    return evidence.join(families, keys).withColumn("decision", decision)


def corroboration(found: DataFrame, case: str, node: str | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Per case of ``findings``: families on either side and mixed ones, eligible rows, outcome and warnings.

    A family has one vote per stance however many rows it has. Of ``relations`` (case, left_id, right_id, relation) those of
    possible reuse warn where both documents are decisive. Warnings come in a fixed order.
    """
    eligible = F.col("decision") == "ELIGIBLE"
    sides = found.groupBy(case, "component").agg(
        F.bool_or(eligible & (F.col("stance") == "ENTAILMENT")).alias("s"), F.bool_or(eligible & (F.col("stance") == "CONTRADICTION")).alias("r"),
        F.count_if(eligible).alias("e"), F.bool_or(F.col("relation") == "AFTER_REFERENCE").alias("after"),
        F.bool_or(F.col("relation").isNull() | F.col("freshness").isNull()).alias("bare"), F.bool_or(F.col("decision") == "TEMPORAL_REVIEW_REQUIRED").alias("review"),
    )
    votes = sides.groupBy(case).agg(
        F.count_if("s").alias("supporting"), F.count_if("r").alias("refuting"), F.count_if(F.col("s") & F.col("r")).alias("mixed"), F.sum("e").alias("decisive"),
        *[F.bool_or(c).alias(c) for c in ("after", "bare", "review")],
    )
    votes = votes.withColumn("reused", F.lit(False))
    if relations is not None:
        decisive = found.where(eligible).select(case, node).distinct()
        near = relations.where("relation = 'POSSIBLE_TEXT_REUSE'").select(case, "left_id", "right_id")
        for side in ("left_id", "right_id"):
            near = near.join(decisive.withColumnRenamed(node, side), [case, side], "left_semi")
        votes = votes.drop("reused").join(near.select(case).distinct().withColumn("reused", F.lit(True)), case, "left")
    s, r = F.col("supporting"), F.col("refuting")
    outcome = (
        F.when((s > 0) & (r > 0), "UNRESOLVED_OPPOSING_EVIDENCE")
        .when(s > 1, "MULTI_FAMILY_SUPPORT_UNVERIFIED")
        .when(r > 1, "MULTI_FAMILY_REFUTATION_UNVERIFIED")
        .when(s == 1, "SINGLE_FAMILY_SUPPORT")
        .when(r == 1, "SINGLE_FAMILY_REFUTATION")
        .otherwise("NO_DECISIVE_EVIDENCE")
    )
    warnings = ordered_warnings(
        (F.lit(True), "INDEPENDENT_REPORTING_NOT_ESTABLISHED"), (F.lit(True), "NOT_A_CLAIM_TRUTH_PROBABILITY"),
        (F.col("after"), "EVIDENCE_PUBLISHED_AFTER_REFERENCE_REVIEW_CONTEXT"), (F.col("bare"), "SOME_EVIDENCE_LACKS_AUDITED_TEMPORAL_CONTEXT"),
        (F.col("review"), "TEMPORAL_REVIEW_REQUIRED"), ((s > 0) & (r > 0), "OPPOSING_EVIDENCE_NEEDS_REVIEW"),
        (F.col("reused"), "POSSIBLE_SHARED_ORIGIN_BETWEEN_DECISIVE_FAMILIES"), (F.col("mixed") > 0, "OPPOSING_EVIDENCE_WITHIN_SAME_FAMILY"),
    )
    return votes.select(case, "supporting", "refuting", "mixed", "decisive", outcome.alias("outcome"), warnings.alias("warnings"))


def corroboration_violations(stored: DataFrame, found: DataFrame, case: str) -> DataFrame:
    """Cases whose stored counts of families differ from those worked out again."""
    columns = [case, "supporting", "refuting", "mixed", "outcome"]
    return stored.select(*columns).exceptAll(corroboration(found, case).select(*columns))


def time_context(published: Column, retrieved: Column, assessed: Column, reference: Column, max_age_days: Column) -> Column:
    """Struct (relation, freshness, warnings) of a document's dates; zone-less times are UTC.

    ``max_age_days`` null: freshness was not asked for. Warnings come in a fixed order.
    """
    day = F.to_date(published)
    relation = (
        F.when(published.isNull() | reference.isNull(), "UNKNOWN")
        .when(day < F.to_date(reference), "BEFORE_REFERENCE")
        .when(day > F.to_date(reference), "AFTER_REFERENCE")
        .otherwise("SAME_REFERENCE_DAY")
    )
    age = F.floor(F.timestamp_diff("SECOND", published, assessed) / 86400)
    freshness = (
        F.when(max_age_days.isNull(), "NOT_REQUESTED")
        .when(published.isNull(), "UNKNOWN")
        .when(published > assessed, "FUTURE_DATED")
        .when(age > max_age_days, "OLDER_THAN_WINDOW")
        .otherwise("WITHIN_WINDOW")
    )
    warnings = ordered_warnings(
        (published.isNull(), "PUBLICATION_TIME_UNKNOWN"),
        (published > retrieved, "PUBLICATION_AFTER_RETRIEVAL"),
        (published > assessed, "PUBLICATION_AFTER_ASSESSMENT"),
        (relation == "AFTER_REFERENCE", "EVIDENCE_POSTDATES_REFERENCE_REVIEW_REQUIRED"),
        (freshness == "OLDER_THAN_WINDOW", "OUTSIDE_CALLER_FRESHNESS_WINDOW"),
        (freshness == "FUTURE_DATED", "FUTURE_DATED_METADATA_REVIEW_REQUIRED"),
    )
    return F.struct(relation.alias("relation"), freshness.alias("freshness"), warnings.alias("warnings"))
