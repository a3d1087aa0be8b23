"""Building and cleaning of claim and premise pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.labels import CLAIM_LABELS, CLAIM_TO_NLI, label_id, remap
from attestry.functions.text import non_blank
from attestry.operators.relational import conflicting_keys, first_rows, first_rows_of_few, not_matched, number_rows, ordered_list, ordered_text

PAIR_COLUMNS = [
    "claim_id", "split", "claim", "claim_label", "premise", "nli_label", "nli_label_id", "source_type", "evidence_set_id",
    "evidence_page_ids", "evidence_sentence_ids", "evidence_sentence_count",
]
# Splits by priority.
SPLIT_PRIORITY = {"test": 1, "validation": 2, "train": 3}


def usable_claims(claims: DataFrame) -> DataFrame:
    """One row per (split, claim_id), claims trimmed and not blank; of several deliveries the first by text, then label."""
    kept = claims.where(non_blank(F.col("claim"))).select("claim_id", "split", "label", F.trim("claim").alias("claim"))
    return first_rows(kept, ["split", "claim_id"], [F.col("claim"), F.col("label").asc_nulls_last()])


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """One row per place (split, claim, set, position): the latest delivery, then the greatest row id."""
    place = ["split", "claim_id", "evidence_set_id", "evidence_item_position"]
    return first_rows(evidence, place, [F.col("recorded_at").desc(), F.col("evidence_row_id").desc()])


def raw_length() -> Column:
    """Length of the raw line, 0 for null: all that choosing a row takes from it."""
    return F.char_length(F.coalesce("raw_line", F.lit("")))


def slim_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences with ``raw_length`` in place of the raw line, which is as long as the text: for shuffles that come before a row is chosen."""
    return sentences.select("page_id", "sentence_id", "text", "source_member", "row_id", raw_length().alias("raw_length"))


def _raw_length(sentences: DataFrame) -> Column:
    return F.col("raw_length") if "raw_length" in sentences.columns else raw_length()


def stored_sentences(sentences: DataFrame, few: bool = False) -> DataFrame:
    """One row per (page, sentence): longest raw line, then source, then row id; blank texts are dropped afterwards (W1). ``few``: few are stored more than once."""
    order = [_raw_length(sentences).desc(), F.col("source_member"), F.col("row_id")]
    return (first_rows_of_few if few else first_rows)(sentences, ["page_id", "sentence_id"], order).where(non_blank(F.col("text")))


def canonical_sentences(sentences: DataFrame, few: bool = False) -> DataFrame:
    """One row per (page, sentence): text that is not blank first, then longer raw line, longer text, source, row id (W2). ``few``: few are stored more than once."""
    order = [
        F.when(non_blank(F.col("text")), 0).otherwise(1),
        _raw_length(sentences).desc(),
        F.char_length(F.coalesce("text", F.lit(""))).desc(),
        F.col("source_member"),
        F.col("row_id"),
    ]
    return (first_rows_of_few if few else first_rows)(sentences, ["page_id", "sentence_id"], order)


def resolve_references(evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """Evidence with the sentence it refers to, and whether there is one.

    ``sentences`` must hold one row per (page_id, sentence_id). Null references are unresolved.
    """
    s = sentences.select(
        F.col("page_id").alias("wiki_page"), "sentence_id", F.col("text").alias("evidence_text"),
        F.col("raw_line").alias("evidence_raw_line"), "source_member", F.lit(True).alias("resolved"),
    )
    return evidence.join(s, ["wiki_page", "sentence_id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def gold_sentences(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolved").where(non_blank(F.col("evidence_text"))).withColumn("evidence_text", F.trim("evidence_text"))


def gold_pairs(claims: DataFrame, gold: DataFrame) -> DataFrame:
    """One pair per evidence set of a decided claim: premise, pages and sentences in the order of the items."""
    decided = claims.where(F.col("label").isin("SUPPORTS", "REFUTES"))
    sets = gold.groupBy("claim_id", "split", "evidence_set_id").agg(
        ordered_text("evidence_text", "evidence_item_position").alias("premise"),
        ordered_list("wiki_page", "evidence_item_position").alias("evidence_page_ids"),
        ordered_list("sentence_id", "evidence_item_position").alias("evidence_sentence_ids"),
        F.count("*").cast("int").alias("evidence_sentence_count"),
    )
    out = decided.withColumnRenamed("label", "claim_label").join(sets, ["claim_id", "split"])
    out = out.withColumn("nli_label", remap(F.col("claim_label"), CLAIM_TO_NLI)).withColumn("nli_label_id", label_id(F.col("nli_label")))
    return out.withColumn("source_type", F.lit("gold_evidence_set")).select(*PAIR_COLUMNS)


def neighbour_negatives(gold: DataFrame, sentences: DataFrame, reach: int = 2) -> DataFrame:
    """The nearest sentence beside each set's evidence that is no evidence of the claim, by key or by text.

    Order: distance, page, sentence, longer text, text, row id of the sentence.
    """
    offsets = F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])
    targets = gold.select("claim_id", "split", "evidence_set_id", F.col("wiki_page").alias("page_id"), F.col("sentence_id").alias("_gold"), F.explode(offsets).alias("_d"))
    targets = targets.select("claim_id", "split", "evidence_set_id", "page_id", (F.col("_gold") + F.col("_d")).alias("sentence_id"), F.abs("_d").alias("distance")).where("sentence_id >= 0")
    keys = gold.select("claim_id", "split", F.col("wiki_page").alias("page_id"), "sentence_id")
    texts = gold.select("claim_id", "split", F.col("evidence_text").alias("premise"))
    near = targets.join(sentences.where(non_blank(F.col("text"))).select("row_id", "page_id", "sentence_id", F.trim("text").alias("premise")), ["page_id", "sentence_id"])
    near = not_matched(near, keys, ["claim_id", "split", "page_id", "sentence_id"])
    near = not_matched(near, texts, ["claim_id", "split", "premise"])
    order = [F.col("distance"), F.col("page_id"), F.col("sentence_id"), F.char_length("premise").desc(), F.col("premise"), F.col("row_id")]
    return first_rows(near, ["claim_id", "split", "evidence_set_id"], order).select("claim_id", "split", "evidence_set_id", "page_id", "sentence_id", "premise")


def negative_pairs(positive: DataFrame, negatives: DataFrame) -> DataFrame:
    """Neutral pairs of claims with neighbouring sentences."""
    base = positive.select("claim_id", "split", "claim", "claim_label", "evidence_set_id")
    out = base.join(negatives, ["claim_id", "split", "evidence_set_id"])
    return out.select(
        "claim_id", "split", "claim", "claim_label", "premise", F.lit("NEUTRAL").alias("nli_label"), label_id(F.lit("NEUTRAL")).alias("nli_label_id"),
        F.lit("same_page_hard_negative").alias("source_type"), "evidence_set_id", F.array("page_id").alias("evidence_page_ids"),
        F.array("sentence_id").alias("evidence_sentence_ids"), F.lit(1).alias("evidence_sentence_count"),
    )


def build_pairs(claims: DataFrame, evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """All pairs, numbered from 1."""
    gold = gold_sentences(resolve_references(latest_evidence(evidence), canonical_sentences(sentences)))
    positive = gold_pairs(usable_claims(claims), gold)
    both = positive.unionByName(negative_pairs(positive, neighbour_negatives(gold, sentences)))
    return number_rows(both, ["split", "claim_id", "evidence_set_id", "nli_label_id", "source_type"], "example_id")


def exact_distinct(pairs: DataFrame) -> DataFrame:
    """One row per (split, claim_id, premise, nli_label)."""
    order = [F.col("source_type"), F.col("evidence_set_id"), F.col("example_id")]
    return first_rows(pairs, ["split", "claim_id", "premise", "nli_label"], order)


def drop_ambiguous(pairs: DataFrame) -> DataFrame:
    """Without the (claim, premise) that carry different labels."""
    bad = conflicting_keys(pairs, ["claim", "premise"], "nli_label")
    return not_matched(pairs, bad, ["claim", "premise"])


def split_rank(split: Column) -> Column:
    out = F.lit(99)
    for name, rank in SPLIT_PRIORITY.items():
        out = F.when(split == name, rank).otherwise(out)
    return out


def keep_priority_split(pairs: DataFrame) -> DataFrame:
    """A (claim, premise) found in several splits stays in the first by priority (A9, J9). Pairs with null don't take part and are dropped."""
    keep = pairs.groupBy("claim", "premise").agg(F.min_by("split", split_rank(F.col("split"))).alias("_keep"))
    return pairs.join(keep, ["claim", "premise"]).where(F.col("split") == F.col("_keep")).drop("_keep").select(*pairs.columns)


def logical_distinct(pairs: DataFrame) -> DataFrame:
    """One row per (claim, premise)."""
    order = [F.col(c) for c in ("claim_id", "nli_label_id", "source_type", "evidence_set_id", "example_id")]
    return first_rows(pairs, ["claim", "premise"], order)


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """All cleaning steps, renumbered."""
    kept = logical_distinct(keep_priority_split(drop_ambiguous(exact_distinct(pairs))))
    return number_rows(kept.drop("example_id"), ["split", "claim_id", "nli_label_id", "premise"], "example_id")


def classification_set(claims: DataFrame) -> DataFrame:
    """Claims with a known label and its id."""
    kept = usable_claims(claims).where(F.col("label").isin(*CLAIM_LABELS))
    return kept.withColumn("label_id", label_id(F.col("label"), CLAIM_LABELS)).select("claim_id", "split", "claim", "label", "label_id")


def retrieval_queries(claims: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("claim_id", "split")) -> DataFrame:
    """Distinct claims that have resolved evidence (A11). The key is a parameter: with or without the split."""
    found = gold.select(*keys).distinct()
    return claims.join(found, list(keys), "left_semi").select("claim_id", "split", "claim", "label").distinct()


def sentence_qrels(gold: DataFrame) -> DataFrame:
    """Distinct relevant sentences per claim."""
    return gold.select("claim_id", "split", "wiki_page", "sentence_id", "evidence_text").distinct().withColumn("relevance", F.lit(1))


def gold_pages(gold: DataFrame) -> DataFrame:
    return gold.select("claim_id", "split", "wiki_page").distinct().withColumn("relevance", F.lit(1))


def sentence_catalog(sentences: DataFrame) -> DataFrame:
    """Distinct (page, sentence) with one text, numbered from 0."""
    one = sentences.where(non_blank(F.col("text"))).groupBy("page_id", "sentence_id").agg(F.max("text").alias("sentence_text"))
    return number_rows(one, ["page_id", "sentence_id"], "embedding_row", start=0)
