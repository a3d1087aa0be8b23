"""Queries on building, auditing and cleaning evidence datasets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.labels import CLAIM_LABELS
from attestry.functions.text import non_blank
from attestry.operators import dataset as d
from attestry.operators import relational as r
from attestry.sources.tables import table


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    evidence = d.latest_evidence(table(spark, folder, "evidence"))
    return d.gold_sentences(d.resolve_references(evidence, d.canonical_sentences(table(spark, folder, "wiki_sentences"))))


def stored_sentences(spark, folder):
    return d.stored_sentences(table(spark, folder, "wiki_sentences")).select("page_id", "sentence_id", "text", "row_id")


def canonical_sentences(spark, folder):
    return d.canonical_sentences(table(spark, folder, "wiki_sentences")).select("page_id", "sentence_id", "text", "row_id")


def resolved_evidence(spark, folder):
    s = d.canonical_sentences(table(spark, folder, "wiki_sentences"))
    return d.resolve_references(table(spark, folder, "evidence"), s).select("evidence_row_id", "wiki_page", "sentence_id", "evidence_text", "source_member", "resolved")


def resolution_counts(spark, folder):
    """Rows by state of their reference, with the share resolved among references."""
    x = resolved_evidence(spark, folder)
    ref = F.col("wiki_page").isNotNull() & F.col("sentence_id").isNotNull()
    return x.agg(
        F.count("*").alias("evidence_rows"),
        F.count_if("resolved").alias("resolved_rows"),
        F.count_if(ref & ~F.col("resolved")).alias("unresolved_rows"),
        F.count_if(~ref).alias("null_references"),
        F.round(r.ratio(F.count_if("resolved"), F.count_if(ref)), 6).alias("resolution_rate"),
    )


def unresolved_references(spark, folder):
    x = resolved_evidence(spark, folder).where("not resolved").where("wiki_page is not null and sentence_id is not null")
    return x.select("wiki_page", "sentence_id").distinct()


def duplicate_sentence_keys(spark, folder):
    """Repeated keys, and how many different texts they have, null counted as empty (A3, A5)."""
    s = table(spark, folder, "wiki_sentences")
    return (
        s.groupBy("page_id", "sentence_id")
        .agg(F.count("*").alias("row_count"), F.count_distinct(F.coalesce("text", F.lit(""))).alias("text_count"))
        .where("row_count > 1")
    )


def duplicate_sentence_rows(spark, folder):
    """All rows of repeated keys."""
    s = table(spark, folder, "wiki_sentences")
    return s.join(r.duplicate_keys(s, ["page_id", "sentence_id"]), ["page_id", "sentence_id"]).select("row_id", "page_id", "sentence_id", "source_member", "row_count")


def conflicting_sentences(spark, folder):
    """Keys stored with different texts: a violation in an audited corpus (A4, P10)."""
    return duplicate_sentence_keys(spark, folder).where("text_count > 1").select("page_id", "sentence_id", "text_count")


def gold_pairs(spark, folder):
    return d.gold_pairs(d.usable_claims(table(spark, folder, "claims")), _gold(spark, folder))


def neighbour_negatives(spark, folder):
    return d.neighbour_negatives(_gold(spark, folder), table(spark, folder, "wiki_sentences"))


def built_pairs(spark, folder):
    return d.build_pairs(table(spark, folder, "claims"), table(spark, folder, "evidence"), table(spark, folder, "wiki_sentences"))


def exact_distinct(spark, folder):
    return d.exact_distinct(table(spark, folder, "nli_pairs")).select("example_id", "split", "claim_id", "nli_label", "source_type")


def excess_copies(spark, folder):
    """Groups of exact copies, surplus rows and the largest group."""
    g = table(spark, folder, "nli_pairs").groupBy("split", "claim_id", "premise", "nli_label").agg(F.count("*").alias("n"))
    return g.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"),
        F.coalesce(F.max("n"), F.lit(1)).alias("largest_group"),
    )


def ambiguous_pairs(spark, folder):
    """Premises that carry different labels (A4)."""
    return r.conflicting_keys(table(spark, folder, "nli_pairs").where("premise is not null"), ["premise"], "nli_label")


def leaking_pairs(spark, folder):
    return r.conflicting_keys(table(spark, folder, "nli_pairs_clean"), ["claim", "premise"], "split")


def unambiguous(spark, folder):
    return d.drop_ambiguous(table(spark, folder, "nli_pairs")).select("example_id", "split", "nli_label")


def priority_split(spark, folder):
    return d.keep_priority_split(table(spark, folder, "nli_pairs")).select("example_id", "split")


def split_removals(spark, folder):
    """Rows that priority removes, by split."""
    p = table(spark, folder, "nli_pairs").where("claim is not null and premise is not null")
    keep = p.groupBy("claim", "premise").agg(F.min_by("split", d.split_rank(F.col("split"))).alias("keep_split"))
    return p.join(keep, ["claim", "premise"]).where("split <> keep_split").groupBy("split").agg(F.count("*").alias("rows_removed"))


def logical_distinct(spark, folder):
    return d.logical_distinct(table(spark, folder, "nli_pairs")).select("example_id", "claim_id", "split")


def cleaned_pairs(spark, folder):
    return d.clean_pairs(table(spark, folder, "nli_pairs")).select("example_id", "claim_id", "split", "claim", "premise", "nli_label_id")


def split_label_counts(spark, folder):
    return table(spark, folder, "nli_pairs_final").groupBy("split", "nli_label", "source_type").agg(F.count("*").alias("n")).orderBy("split", "nli_label", "source_type")


def classification_set(spark, folder):
    return d.classification_set(table(spark, folder, "claims"))


def claim_key_violations(spark, folder):
    """(split, claim_id) delivered more than once."""
    return r.duplicate_keys(table(spark, folder, "claims"), ["split", "claim_id"])


def unknown_labels(spark, folder):
    """Labels beside the known ones, null written as such, with their rows, and known ones that are absent."""
    return r.set_differences(table(spark, folder, "claims"), "label", (*CLAIM_LABELS, "DISPUTED"))


def retrieval_queries(spark, folder):
    return d.retrieval_queries(d.usable_claims(table(spark, folder, "claims")), _gold(spark, folder))


def retrieval_queries_by_id(spark, folder):
    return d.retrieval_queries(d.usable_claims(table(spark, folder, "claims")), _gold(spark, folder), ("claim_id",))


def sentence_qrels(spark, folder):
    return d.sentence_qrels(_gold(spark, folder))


def gold_pages(spark, folder):
    return d.gold_pages(_gold(spark, folder))


def sentence_catalog(spark, folder):
    return d.sentence_catalog(table(spark, folder, "wiki_sentences"))


def page_sentences(spark, folder):
    """Each gold page of a claim with its sentences."""
    pages = d.gold_pages(_gold(spark, folder)).select("claim_id", "split", F.col("wiki_page").alias("page_id"))
    s = d.stored_sentences(table(spark, folder, "wiki_sentences")).select("page_id", "sentence_id", "text")
    # A page's sentences are counted before they meet its claims.
    sizes = s.groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.join(sizes, "page_id").groupBy("claim_id", "split").agg(F.sum("n").alias("candidates"), F.count("*").alias("pages"))


def distinct_counts(spark, folder):
    """Global distinct counts."""
    p = table(spark, folder, "nli_pairs")
    return p.agg(
        F.count("*").alias("n"), F.count_distinct("claim_id").alias("claims"), F.count_distinct("split").alias("splits"), F.count_distinct("premise").alias("premises")
    )


def evidence_set_sizes(spark, folder):
    """Whether all items of a set resolve, per set (M9)."""
    s = d.canonical_sentences(table(spark, folder, "wiki_sentences"))
    x = d.resolve_references(d.latest_evidence(table(spark, folder, "evidence")), s)
    return x.groupBy("split", "claim_id", "evidence_set_id").agg(F.count("*").alias("items"), F.bool_and(F.col("resolved") & non_blank(F.col("evidence_text"))).alias("complete"))


def fk_chain(spark, folder):
    """Latest line items with their order, customer, nation and region."""
    li, o, c = (table(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    n, g = (table(spark, folder, t) for t in ("nation", "region"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return (
        x.orderBy(F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber")
        .limit(20)
        .select("l_orderkey", "l_linenumber", "c_custkey", "n_name", "r_name")
    )


def filtered_aggregates(spark, folder):
    """Filtered counts and ranges by group."""
    li = table(spark, folder, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_quantity").between(10, 20)).alias("mid_quantity"),
        F.count_if((F.col("l_discount") >= 0.05) & (F.col("l_tax") < 0.04)).alias("discounted"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
    )


NAMES = [
    stored_sentences, canonical_sentences, resolved_evidence, resolution_counts, unresolved_references, duplicate_sentence_keys,
    duplicate_sentence_rows, conflicting_sentences, gold_pairs, neighbour_negatives, built_pairs, exact_distinct, excess_copies,
    ambiguous_pairs, leaking_pairs, unambiguous, priority_split, split_removals, logical_distinct, cleaned_pairs, split_label_counts,
    classification_set, claim_key_violations, unknown_labels, retrieval_queries, retrieval_queries_by_id, sentence_qrels, gold_pages,
    sentence_catalog, page_sentences, distinct_counts, evidence_set_sizes, fk_chain, filtered_aggregates,
]
QUERIES = {f.__name__: f for f in NAMES}

_STORED = """st AS (SELECT page_id, sentence_id, text, row_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, sentence_id
  ORDER BY length(coalesce(raw_line, '')) DESC, source_member, row_id) AS k FROM wiki_sentences) WHERE k = 1 AND trim(text) <> '')"""
_CANON = """cs AS (SELECT page_id, sentence_id, text, raw_line, source_member, row_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, sentence_id
  ORDER BY CASE WHEN trim(text) <> '' THEN 0 ELSE 1 END, length(coalesce(raw_line, '')) DESC, length(coalesce(text, '')) DESC, source_member, row_id) AS k
  FROM wiki_sentences) WHERE k = 1)"""
_LATEST = """le AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY split, claim_id, evidence_set_id, evidence_item_position
  ORDER BY recorded_at DESC, evidence_row_id DESC) AS k FROM evidence) WHERE k = 1)"""
_CLAIMS = """uc AS (SELECT claim_id, split, label, claim FROM (SELECT claim_id, split, label, trim(claim) AS claim, row_number() OVER (PARTITION BY split, claim_id
  ORDER BY trim(claim), label ASC NULLS LAST) AS k FROM claims WHERE trim(claim) <> '') WHERE k = 1)"""
_GOLD = f"""{_CANON}, {_LATEST}, gold AS (SELECT e.claim_id, e.split, e.evidence_set_id, e.evidence_item_position, e.wiki_page, e.sentence_id, trim(s.text) AS evidence_text
  FROM le e JOIN cs s ON e.wiki_page = s.page_id AND e.sentence_id = s.sentence_id WHERE trim(s.text) <> '')"""
_PAIRS = f"""{_GOLD}, {_CLAIMS}, gp AS (SELECT c.claim_id, c.split, c.claim, c.label AS claim_label, string_agg(g.evidence_text, ' ' ORDER BY g.evidence_item_position) AS premise,
  CASE c.label WHEN 'SUPPORTS' THEN 'ENTAILMENT' ELSE 'CONTRADICTION' END AS nli_label, CASE c.label WHEN 'SUPPORTS' THEN 0 ELSE 1 END AS nli_label_id,
  'gold_evidence_set' AS source_type, g.evidence_set_id, list(g.wiki_page ORDER BY g.evidence_item_position) AS evidence_page_ids,
  list(g.sentence_id ORDER BY g.evidence_item_position) AS evidence_sentence_ids, CAST(count(*) AS INT) AS evidence_sentence_count
  FROM uc c JOIN gold g USING (claim_id, split) WHERE c.label IN ('SUPPORTS', 'REFUTES') GROUP BY ALL)"""
_NEAR = """nn AS (SELECT * EXCLUDE (k) FROM (SELECT t.claim_id, t.split, t.evidence_set_id, t.page_id, t.sid AS sentence_id, trim(w.text) AS premise,
  row_number() OVER (PARTITION BY t.claim_id, t.split, t.evidence_set_id ORDER BY t.distance, t.page_id, t.sid, length(trim(w.text)) DESC, trim(w.text), w.row_id) AS k
  FROM (SELECT claim_id, split, evidence_set_id, wiki_page AS page_id, sentence_id + d AS sid, abs(d) AS distance FROM gold CROSS JOIN (VALUES (-2), (-1), (1), (2)) o(d)) t
  JOIN wiki_sentences w ON w.page_id = t.page_id AND w.sentence_id = t.sid
  WHERE t.sid >= 0 AND trim(w.text) <> ''
    AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.claim_id = t.claim_id AND g.split = t.split AND g.wiki_page = t.page_id AND g.sentence_id = t.sid)
    AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.claim_id = t.claim_id AND g.split = t.split AND g.evidence_text = trim(w.text))) WHERE k = 1)"""
_AMBIGUOUS = "SELECT claim, premise FROM {} GROUP BY claim, premise HAVING count(DISTINCT nli_label) > 1"
_RANK = "CASE split WHEN 'test' THEN 1 WHEN 'validation' THEN 2 WHEN 'train' THEN 3 ELSE 99 END"

SQL = {
    "stored_sentences": f"WITH {_STORED} SELECT * FROM st",
    "canonical_sentences": f"WITH {_CANON} SELECT page_id, sentence_id, text, row_id FROM cs",
    "resolved_evidence": f"""WITH {_CANON} SELECT e.evidence_row_id, e.wiki_page, e.sentence_id, s.text AS evidence_text, s.source_member, s.page_id IS NOT NULL AS resolved
      FROM evidence e LEFT JOIN cs s ON e.wiki_page = s.page_id AND e.sentence_id = s.sentence_id""",
    "resolution_counts": f"""WITH {_CANON}, x AS (SELECT e.wiki_page IS NOT NULL AND e.sentence_id IS NOT NULL AS ref, s.page_id IS NOT NULL AS ok
      FROM evidence e LEFT JOIN cs s ON e.wiki_page = s.page_id AND e.sentence_id = s.sentence_id)
      SELECT count(*) AS evidence_rows, count(*) FILTER (ok) AS resolved_rows, count(*) FILTER (ref AND NOT ok) AS unresolved_rows,
        count(*) FILTER (NOT ref) AS null_references, round(count(*) FILTER (ok) / count(*) FILTER (ref), 6) AS resolution_rate FROM x""",
    "unresolved_references": """SELECT DISTINCT wiki_page, sentence_id FROM evidence e WHERE wiki_page IS NOT NULL AND sentence_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM wiki_sentences w WHERE w.page_id = e.wiki_page AND w.sentence_id = e.sentence_id)""",
    "duplicate_sentence_keys": """SELECT page_id, sentence_id, count(*) AS row_count, count(DISTINCT coalesce(text, '')) AS text_count
      FROM wiki_sentences GROUP BY ALL HAVING count(*) > 1""",
    "duplicate_sentence_rows": """SELECT row_id, page_id, sentence_id, source_member, row_count FROM wiki_sentences
      JOIN (SELECT page_id, sentence_id, count(*) AS row_count FROM wiki_sentences GROUP BY ALL HAVING count(*) > 1) USING (page_id, sentence_id)""",
    "conflicting_sentences": """SELECT page_id, sentence_id, count(DISTINCT coalesce(text, '')) AS text_count FROM wiki_sentences
      GROUP BY page_id, sentence_id HAVING count(*) > 1 AND count(DISTINCT coalesce(text, '')) > 1""",
    "gold_pairs": f"WITH {_PAIRS} SELECT * FROM gp",
    "neighbour_negatives": f"WITH {_GOLD}, {_NEAR} SELECT * FROM nn",
    "built_pairs": f"""WITH {_PAIRS}, {_NEAR}, u AS (SELECT * FROM gp UNION ALL BY NAME
      SELECT claim_id, split, claim, claim_label, n.premise, 'NEUTRAL' AS nli_label, 2 AS nli_label_id, 'same_page_hard_negative' AS source_type, evidence_set_id,
        [n.page_id] AS evidence_page_ids, [n.sentence_id] AS evidence_sentence_ids, 1 AS evidence_sentence_count
      FROM gp p JOIN nn n USING (claim_id, split, evidence_set_id))
      SELECT row_number() OVER (ORDER BY split, claim_id, evidence_set_id, nli_label_id, source_type) AS example_id, * FROM u""",
    "exact_distinct": """SELECT example_id, split, claim_id, nli_label, source_type FROM (SELECT *, row_number() OVER (PARTITION BY split, claim_id, premise, nli_label
      ORDER BY source_type, evidence_set_id, example_id) AS k FROM nli_pairs) WHERE k = 1""",
    "excess_copies": """SELECT count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS excess_rows, coalesce(max(n), 1) AS largest_group
      FROM (SELECT count(*) AS n FROM nli_pairs GROUP BY split, claim_id, premise, nli_label)""",
    "ambiguous_pairs": "SELECT premise, count(DISTINCT nli_label) AS value_count FROM nli_pairs WHERE premise IS NOT NULL GROUP BY ALL HAVING count(DISTINCT nli_label) > 1",
    "leaking_pairs": "SELECT claim, premise, count(DISTINCT split) AS value_count FROM nli_pairs_clean GROUP BY ALL HAVING count(DISTINCT split) > 1",
    "unambiguous": f"""SELECT example_id, split, nli_label FROM nli_pairs p WHERE NOT EXISTS (SELECT 1 FROM ({_AMBIGUOUS.format("nli_pairs")}) a
      WHERE a.claim = p.claim AND a.premise = p.premise)""",
    "priority_split": f"""SELECT example_id, p.split FROM nli_pairs p JOIN (SELECT claim, premise, arg_min(split, {_RANK}) AS keep FROM nli_pairs GROUP BY ALL) k
      USING (claim, premise) WHERE p.split = keep""",
    "split_removals": f"""SELECT p.split, count(*) AS rows_removed FROM nli_pairs p JOIN (SELECT claim, premise, arg_min(split, {_RANK}) AS keep FROM nli_pairs GROUP BY ALL) k
      USING (claim, premise) WHERE p.split <> keep GROUP BY p.split""",
    "logical_distinct": """SELECT example_id, claim_id, split FROM (SELECT *, row_number() OVER (PARTITION BY claim, premise
      ORDER BY claim_id, nli_label_id, source_type, evidence_set_id, example_id) AS k FROM nli_pairs) WHERE k = 1""",
    "cleaned_pairs": f"""WITH e AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY split, claim_id, premise, nli_label ORDER BY source_type, evidence_set_id, example_id) AS k FROM nli_pairs) WHERE k = 1),
      a AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM ({_AMBIGUOUS.format("e")}) b WHERE b.claim = e.claim AND b.premise = e.premise)),
      s AS (SELECT a.* FROM a JOIN (SELECT claim, premise, arg_min(split, {_RANK}) AS keep FROM a GROUP BY ALL) k USING (claim, premise) WHERE a.split = keep),
      l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim, premise ORDER BY claim_id, nli_label_id, source_type, evidence_set_id, example_id) AS k FROM s) WHERE k = 1)
      SELECT row_number() OVER (ORDER BY split, claim_id, nli_label_id, premise) AS example_id, claim_id, split, claim, premise, nli_label_id FROM l""",
    "split_label_counts": "SELECT split, nli_label, source_type, count(*) AS n FROM nli_pairs_final GROUP BY ALL",
    "classification_set": f"""WITH {_CLAIMS} SELECT claim_id, split, claim, label, CAST(CASE label WHEN 'SUPPORTS' THEN 0 WHEN 'REFUTES' THEN 1 ELSE 2 END AS INT) AS label_id
      FROM uc WHERE label IN ('SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO')""",
    "claim_key_violations": "SELECT split, claim_id, count(*) AS row_count FROM claims GROUP BY ALL HAVING count(*) > 1",
    "unknown_labels": """SELECT label, count(*) AS n FROM claims WHERE label IS NULL OR label NOT IN ('SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO', 'DISPUTED') GROUP BY ALL
      UNION ALL SELECT l, 0 FROM (VALUES ('SUPPORTS'), ('REFUTES'), ('NOT ENOUGH INFO'), ('DISPUTED')) v(l) WHERE l NOT IN (SELECT label FROM claims WHERE label IS NOT NULL)""",
    "retrieval_queries": f"WITH {_GOLD}, {_CLAIMS} SELECT DISTINCT claim_id, split, claim, label FROM uc WHERE (claim_id, split) IN (SELECT (claim_id, split) FROM gold)",
    "retrieval_queries_by_id": f"WITH {_GOLD}, {_CLAIMS} SELECT DISTINCT claim_id, split, claim, label FROM uc WHERE claim_id IN (SELECT claim_id FROM gold)",
    "sentence_qrels": f"WITH {_GOLD} SELECT DISTINCT claim_id, split, wiki_page, sentence_id, evidence_text, 1 AS relevance FROM gold",
    "gold_pages": f"WITH {_GOLD} SELECT DISTINCT claim_id, split, wiki_page, 1 AS relevance FROM gold",
    "sentence_catalog": """SELECT row_number() OVER (ORDER BY page_id, sentence_id) - 1 AS embedding_row, page_id, sentence_id, sentence_text
      FROM (SELECT page_id, sentence_id, max(text) AS sentence_text FROM wiki_sentences WHERE trim(text) <> '' GROUP BY ALL)""",
    "page_sentences": f"""WITH {_GOLD}, {_STORED} SELECT claim_id, split, count(*) AS candidates, count(DISTINCT page_id) AS pages
      FROM (SELECT DISTINCT claim_id, split, wiki_page AS page_id FROM gold) JOIN st USING (page_id) GROUP BY ALL""",
    "distinct_counts": "SELECT count(*) AS n, count(DISTINCT claim_id) AS claims, count(DISTINCT split) AS splits, count(DISTINCT premise) AS premises FROM nli_pairs",
    "evidence_set_sizes": f"""WITH {_CANON}, {_LATEST} SELECT e.split, e.claim_id, e.evidence_set_id, count(*) AS items, bool_and(coalesce(trim(s.text) <> '', false)) AS complete
      FROM le e LEFT JOIN cs s ON e.wiki_page = s.page_id AND e.sentence_id = s.sentence_id GROUP BY ALL""",
    "fk_chain": """SELECT l_orderkey, l_linenumber, c_custkey, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 20""",
    "filtered_aggregates": """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity BETWEEN 10 AND 20) AS mid_quantity,
      count(*) FILTER (l_discount >= 0.05 AND l_tax < 0.04) AS discounted, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL""",
}
