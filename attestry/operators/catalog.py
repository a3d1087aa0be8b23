"""Queries on the general problems of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import nested, references
from attestry.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.evidence_rows(table(spark, folder, "fever_records"))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_evidence(table(spark, folder, "fever_records"))["records"].select("record_id", "id", "label", "claim", "n_sets")


def p1_sets(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_evidence(table(spark, folder, "fever_records"))["sets"].select("record_id", "evidence_set_id", "n_items")


def p1_items(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_evidence(table(spark, folder, "fever_records"))["items"].select(
        "record_id", "evidence_set_id", "evidence_item_position", *nested.ITEM_FIELDS
    )


def p1_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of every table, inferred columns and further arrays included."""
    return nested.flat_cells(nested.flatten_evidence(table(spark, folder, "fever_records")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return references.wiki_orphans(table(spark, folder, "evidence"), table(spark, folder, "wiki_sentences")).select("evidence_row_id")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    orphans = references.wiki_orphans(table(spark, folder, "evidence"), table(spark, folder, "wiki_sentences"))
    return references.orphan_report(orphans, "evidence")


def p5_key_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = references.key_runs(table(spark, folder, "wiki_sentences"), ["page_id"], "sentence_id")
    return runs.where(F.col("page_id").isNotNull())


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p1_sets": p1_sets,
    "p1_items": p1_items,
    "p1_cells": p1_cells,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_key_runs": p5_key_runs,
}

_LIVE = """
  FROM evidence e WHERE wiki_page IS NOT NULL AND sentence_id IS NOT NULL AND recorded_at IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM wiki_sentences w WHERE w.page_id = e.wiki_page AND w.sentence_id = e.sentence_id
      AND w.loaded_at <= e.recorded_at AND (w.removed_at IS NULL OR w.removed_at > e.recorded_at))
"""
_JSON = r"""
WITH r AS (SELECT record_id, TRY_CAST(payload AS JSON) AS j FROM fever_records WHERE json_valid(payload)),
v AS (SELECT record_id, j FROM r WHERE json_type(j) = 'OBJECT'
  AND json_type(j, '$.label') = 'VARCHAR' AND j->>'$.label' IN ('SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO')
  AND json_type(j, '$.claim') = 'VARCHAR' AND regexp_matches(j->>'$.claim', '[^\s]')),
s0 AS (SELECT record_id, CASE WHEN json_type(j, '$.evidence') = 'ARRAY' THEN CAST(j->'$.evidence' AS JSON[]) ELSE CAST([] AS JSON[]) END AS sets FROM v),
s1 AS (SELECT record_id, [CASE json_type(s) WHEN 'ARRAY' THEN CAST(s AS JSON[])
    WHEN 'OBJECT' THEN CASE WHEN json_type(s, '$.items') = 'ARRAY' THEN CAST(s->'$.items' AS JSON[]) ELSE CAST([] AS JSON[]) END
    ELSE CAST([] AS JSON[]) END FOR s IN sets] AS sets FROM s0),
ok AS (SELECT record_id, sets FROM s1 WHERE len(list_filter(flatten(sets), lambda i: json_type(i) = 'ARRAY' AND json_array_length(i) <> 4)) = 0),
st AS (SELECT record_id, CAST(unnest(range(len(sets))) AS INT) AS evidence_set_id, unnest(sets) AS items FROM ok),
it AS (SELECT record_id, evidence_set_id, CAST(unnest(range(len(items))) AS INT) AS evidence_item_position, unnest(items) AS item FROM st),
iv AS (SELECT record_id, evidence_set_id, evidence_item_position,
  CASE json_type(item) WHEN 'ARRAY' THEN item->>'$[0]' ELSE item->>'$.annotation_id' END AS a,
  CASE json_type(item) WHEN 'ARRAY' THEN item->>'$[1]' ELSE item->>'$.evidence_id' END AS e,
  CASE json_type(item) WHEN 'ARRAY' THEN item->>'$[2]' ELSE item->>'$.wiki_page' END AS w,
  CASE json_type(item) WHEN 'ARRAY' THEN item->>'$[3]' ELSE item->>'$.sentence_id' END AS n FROM it)
"""

SQL = {
    "p1_found": _JSON + """
SELECT record_id, evidence_set_id, evidence_item_position, coalesce(w, '') AS wiki_page, coalesce(TRY_CAST(n AS INT), -1) AS sentence_id FROM iv
UNION ALL SELECT record_id, evidence_set_id, -1, '', -1 FROM st WHERE len(items) = 0
UNION ALL SELECT record_id, -1, -1, '', -1 FROM ok WHERE len(sets) = 0
""",
    "p1_records": _JSON + """
SELECT record_id, TRY_CAST(j->>'$.id' AS BIGINT) AS id, j->>'$.label' AS label, j->>'$.claim' AS claim, CAST(len(sets) AS INT) AS n_sets FROM ok JOIN v USING (record_id)
""",
    "p1_sets": _JSON + "SELECT record_id, evidence_set_id, CAST(len(items) AS INT) AS n_items FROM st",
    "p1_items": _JSON + """
SELECT record_id, evidence_set_id, evidence_item_position, TRY_CAST(a AS BIGINT) AS annotation_id, TRY_CAST(e AS BIGINT) AS evidence_id,
  w AS wiki_page, TRY_CAST(n AS INT) AS sentence_id FROM iv
""",
    "p5_found": "SELECT evidence_row_id" + _LIVE,
    "p5_report": """
SELECT 'evidence' AS table_name, strftime(recorded_at, '%Y-%m') AS month,
  CASE WHEN EXISTS (SELECT 1 FROM wiki_sentences w WHERE w.page_id = o.wiki_page AND w.sentence_id = o.sentence_id AND w.loaded_at <= o.recorded_at) THEN 'withdrawn'
       WHEN EXISTS (SELECT 1 FROM wiki_sentences w WHERE w.page_id = o.wiki_page AND w.sentence_id = o.sentence_id) THEN 'not_loaded'
       ELSE 'missing' END AS reason, count(*) AS orphans
FROM (SELECT e.*""" + _LIVE + ") o GROUP BY ALL",
    "p5_key_runs": """
WITH d AS (SELECT DISTINCT page_id, CAST(sentence_id AS BIGINT) AS k FROM wiki_sentences WHERE page_id IS NOT NULL AND sentence_id IS NOT NULL),
g AS (SELECT page_id, k, k - row_number() OVER (PARTITION BY page_id ORDER BY k) AS g FROM d)
SELECT page_id, min(k) AS run_start, max(k) AS run_end, count(*) AS n_keys FROM g GROUP BY page_id, g
""",
}
