"""Queries on text training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import copies, encoding, packing, quality, sampling, split_overlap, survivors
from attestry.session import shared_checkpoint
from attestry.sources.tables import table

RECORD = ["claim", "premise"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.overlap_pairs(table(spark, folder, "nli_pairs_clean"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, folder, "nli_pairs_clean"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.wiki_survivors(table(spark, folder, "wiki_sentences")).select("group_row_id", "text_row_id")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.wiki_survivors(table(spark, folder, "wiki_sentences"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_links(table(spark, folder, "nli_pairs"), "example_id", RECORD, "example_id_a", "example_id_b")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.record_copies(table(spark, folder, "nli_pairs"), "example_id", RECORD)


def _sample_tables(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str]]:
    return {"nli_pairs_final": (table(spark, folder, "nli_pairs_final"), "nli_label"), "claims": (table(spark, folder, "claims"), "label")}


def p6_plan(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.plan_table(_sample_tables(spark, folder), table(spark, folder, "sample_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_plan(spark, folder).where("unmet").select("target_set", "category")


def p6_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled rows of nli_pairs_final."""
    plan = p6_plan(spark, folder).where("table_name = 'nli_pairs_final'")
    return sampling.draw(table(spark, folder, "nli_pairs_final"), "example_id", "nli_label", plan)


def p6_claims_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled rows of claims. Deliveries of one claim share its id, so rows get a number of their own, written once."""
    rows = table(spark, folder, "claims").select("claim_id", "split", "label").withColumn("row_key", F.monotonically_increasing_id())
    plan = p6_plan(spark, folder).where("table_name = 'claims'")
    return sampling.draw(shared_checkpoint(rows), "row_key", "label", plan)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, folder, "documents"), encoding.vocabulary())


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose decoded ids differ from their text: none are expected."""
    docs = table(spark, folder, "documents")
    decoded = encoding.decode_corpus(p7_ids(spark, folder), encoding.vocabulary()).withColumnRenamed("text", "decoded")
    both = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("a")).join(decoded.select("doc_id", F.md5("decoded").alias("b")), "doc_id", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = encoding.token_counts(table(spark, folder, "documents"), encoding.vocabulary())
    return packing.pack(sizes, table(spark, folder, "packing_budgets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(p8_packing(spark, folder), table(spark, folder, "packing_budgets"))


def p8_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by best fit alone, after evolution, and at least, over the blocks."""
    sizes = encoding.token_counts(table(spark, folder, "documents"), encoding.vocabulary())
    return packing.packing_gain(sizes, table(spark, folder, "packing_budgets"))


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    # The word list is fixed in length (210 rows).
    words = quality.common_words(table(spark, folder, "common_words").select("lang", "word").collect())
    return quality.document_quality(table(spark, folder, "documents"), words)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_stats(spark, folder).where("is_junk").select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p6_found": p6_found,
    "p6_plan": p6_plan,
    "p6_sample": p6_sample,
    "p6_claims_sample": p6_claims_sample,
    "p7_ids": p7_ids,
    "p7_roundtrip": p7_roundtrip,
    "p8_packing": p8_packing,
    "p8_report": p8_report,
    "p8_gain": p8_gain,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
}

_BARE = r"regexp_replace({}, '[\s\p{{Z}}\p{{P}}\x{{85}}]+', '', 'g')"
_FORM = "lower(regexp_replace(upper(" + _BARE + "), '[ßẞ]', 'SS', 'g'))"
_P4 = f"""
WITH r AS (SELECT example_id, {_FORM.format("claim")} AS a, {_FORM.format("premise")} AS b FROM nli_pairs
  WHERE regexp_matches(claim, '[^\\s\\p{{Z}}\\x{{85}}]') AND regexp_matches(premise, '[^\\s\\p{{Z}}\\x{{85}}]')),
k AS (SELECT example_id, least(a, b) AS x, greatest(a, b) AS y FROM r),
g AS (SELECT x, y, min(example_id) AS f, count(*) AS n FROM k GROUP BY x, y)
"""
_PAGE = r"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(page_id), '-LRB-', '(', 'gi'), '-RRB-', ')', 'gi'), '[\s\p{Z}\x{85}_]+', ' ', 'g'))"
_TRIMMED = r"coalesce(length(regexp_replace(text, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), 0)"


def _first(field: str, before: str = "") -> str:
    """The value of a field, and the row it is of, by an order that ends in the latest and the smallest row."""
    order = f"{before}{', ' if before else ''}loaded_at DESC NULLS LAST, row_id"
    return f"first({field} ORDER BY {order}) AS {field}, first(row_id ORDER BY {order}) AS {field}_row_id"


def _vote_ctes(field: str) -> str:
    form = rf"regexp_replace({field}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
    return f"""{field}_votes AS (SELECT group_row_id, {form} AS form, round(sum(CASE WHEN {field} IS NULL THEN 0 ELSE vote END), 9) AS votes, max(loaded_at) AS last_at,
    first(row_id ORDER BY loaded_at DESC NULLS LAST, row_id) AS row_of, first({field} ORDER BY loaded_at DESC NULLS LAST, row_id) AS value FROM x GROUP BY ALL),
  {field}_best AS (SELECT group_row_id, first(value ORDER BY votes DESC, last_at DESC NULLS LAST, row_of) AS value, first(row_of ORDER BY votes DESC, last_at DESC NULLS LAST, row_of) AS row_of FROM {field}_votes GROUP BY 1)"""


SQL = {
    "p3_found": f"""
WITH k AS (SELECT row_id, {_PAGE} AS page, sentence_id, loaded_at, {_TRIMMED} AS size FROM wiki_sentences WHERE page_id IS NOT NULL AND sentence_id IS NOT NULL),
g AS (SELECT page, sentence_id, min(row_id) AS group_row_id, count(*) AS n,
  first(row_id ORDER BY size DESC, loaded_at DESC NULLS LAST, row_id) AS text_row_id FROM k GROUP BY page, sentence_id)
SELECT group_row_id, text_row_id FROM g WHERE n > 1
""",
    "p3_survivors": f"""
WITH k AS (SELECT *, {_PAGE} AS page, {_TRIMMED} AS size, {_TRIMMED.replace("text", "raw_line")} AS raw_size FROM wiki_sentences WHERE page_id IS NOT NULL AND sentence_id IS NOT NULL),
g AS (SELECT page, sentence_id, min(row_id) AS group_row_id, max(loaded_at) AS newest, count(*) AS n FROM k GROUP BY page, sentence_id),
tr AS (SELECT source_member, avg(coalesce(regexp_matches(text, '[^\\s\\p{{Z}}\\x{{85}}]'), false)::INT) AS trust FROM wiki_sentences GROUP BY 1),
x AS (SELECT k.*, group_row_id, coalesce(trust, 0.5) * pow(0.5::DOUBLE, coalesce(newest::DATE - loaded_at::DATE, 90) / 90.0::DOUBLE) AS vote
  FROM k JOIN g USING (page, sentence_id) LEFT JOIN tr USING (source_member) WHERE n > 1),
{_vote_ctes("page_id")}, {_vote_ctes("source_member")}
SELECT group_row_id, {_first("text", "size DESC")}, {_first("raw_line", "raw_size DESC")}, {_first("loaded_at")}, {_first("removed_at")},
  any_value(page_id_best.value) AS page_id, any_value(page_id_best.row_of) AS page_id_row_id,
  any_value(source_member_best.value) AS source_member, any_value(source_member_best.row_of) AS source_member_row_id
FROM x JOIN page_id_best USING (group_row_id) JOIN source_member_best USING (group_row_id) GROUP BY group_row_id
""",
    "p4_found": _P4 + "SELECT f AS example_id_a, example_id AS example_id_b FROM k JOIN g USING (x, y) WHERE example_id <> f",
    "p4_records": _P4 + "SELECT f AS example_id, n AS copies FROM g",
    "p6_found": """
WITH r AS (SELECT 'nli_pairs_final' AS table_name, split, nli_label AS category FROM nli_pairs_final
  UNION ALL SELECT 'claims', split, label FROM claims)
SELECT t.target_set, t.category FROM sample_targets t
WHERE (SELECT count(*) FROM r WHERE r.table_name = t.table_name AND (t.split = 'all' OR r.split = t.split) AND r.category = t.category)
  < greatest(t.min_rows, (SELECT count(*) FROM r WHERE r.table_name = t.table_name AND (t.split = 'all' OR r.split = t.split)) * t.sample_pct * t.target_pct // 10000)
""",
}
