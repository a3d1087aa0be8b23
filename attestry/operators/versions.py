"""Versions, upserts, integrity and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.relational import first_rows


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of a batch to insert: keys the target lacks, the first of each within the batch."""
    return first_rows(batch, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")


def snapshot_problem(content: Column, stored_hash: Column, start: Column, end: Column, part: Column, part_hash: Column) -> Column:
    """The first integrity problem of a passage of a snapshot, or null."""
    return (
        F.when(~F.coalesce(F.sha2(content, 256) == stored_hash, F.lit(False)), "CONTENT_HASH")
        .when(~F.coalesce((start >= 0) & (start < end) & (end <= F.char_length(content)), F.lit(False)), "BOUNDS")
        .when(~F.coalesce(F.substring(content, start + 1, end - start) == part, F.lit(False)), "TEXT")
        .when(~F.coalesce(F.sha2(part, 256) == part_hash, F.lit(False)), "PASSAGE_HASH")
    )


def same_spans(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which two sets of spans differ (D3): a full outer comparison; none if they agree."""
    cols = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*cols).alias("a")).join(b.select(*keys, F.struct(*cols).alias("b")), keys, "full")
    return x.where(~F.col("a").eqNullSafe(F.col("b")))


# The longest texts of a fetch observation.
OBSERVATION_LIMITS = {"error_code": 100, "etag": 512, "last_modified": 255}


def observation_problem(row: dict[str, Column]) -> Column:
    """The first problem of a fetch observation, or null.

    ``row`` gives the columns provider, outcome, status, observed_at, doc_id, version_id, and any of OBSERVATION_LIMITS.
    """
    provider, outcome, status = row["provider"], row["outcome"], row["status"]
    out = (
        F.when(row["observed_at"].isNull(), "TIME")
        .when(~F.coalesce((F.trim(provider) != "") & (F.char_length(provider) <= 100), F.lit(False)), "PROVIDER")
        .when(F.coalesce(F.trim(outcome), F.lit("")) == "", "OUTCOME")
        .when(~status.between(100, 599), "STATUS")
    )
    for name, most in OBSERVATION_LIMITS.items():
        if name in row:
            out = out.when(F.char_length(row[name]) > most, name.upper())
    bodiless = row["doc_id"].isNull() | row["version_id"].isNull()
    return out.when((outcome == "FETCHED") & bodiless, "FETCHED_WITHOUT_VERSION").when(row["version_id"].isNotNull() & row["doc_id"].isNull(), "VERSION_WITHOUT_DOCUMENT")


def checked_observations(observations: DataFrame, docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Column ``problem``: that of the row itself, else DOCUMENT_OWNER or VERSION_OWNER where ids don't belong together.

    docs: doc_id, source_id. versions: version_id, doc_id. Ids are unique in either.
    """
    row = {c: F.col(c) for c in ("provider", "outcome", "status", "observed_at", "doc_id", "version_id", *OBSERVATION_LIMITS) if c in observations.columns}
    x = observations.withColumn("_own", observation_problem(row))
    x = x.join(docs.select("doc_id", F.col("source_id").alias("_source")), "doc_id", "left").join(versions.select("version_id", F.col("doc_id").alias("_doc")), "version_id", "left")
    owner = F.when(F.col("doc_id").isNotNull() & ~F.coalesce(F.col("_source") == F.col("source_id"), F.lit(False)), "DOCUMENT_OWNER").when(
        F.col("version_id").isNotNull() & ~F.coalesce(F.col("_doc") == F.col("doc_id"), F.lit(False)), "VERSION_OWNER"
    )
    return x.withColumn("problem", F.coalesce("_own", owner)).select(*observations.columns, "problem")


def attach_once(requests: DataFrame, evidence: DataFrame, versions: DataFrame, attached: DataFrame, order: list[Column]) -> DataFrame:
    """Requests (evidence_id, version_id, method, ...) with ``action``.

    ATTACH for the first sound request of evidence without a version; EXISTING where that version is attached already or by an
    earlier request of the batch; else METHOD (blank or above 100 characters), UNKNOWN (evidence or version), OTHER_DOCUMENT
    (they are of different documents) or OTHER_VERSION (another one is attached). evidence: evidence_id, doc_id. versions:
    version_id, doc_id. attached: evidence_id, version_id.
    """
    x = requests.join(evidence.select("evidence_id", F.col("doc_id").alias("_e")), "evidence_id", "left").join(versions.select("version_id", F.col("doc_id").alias("_v")), "version_id", "left")
    x = x.join(attached.select("evidence_id", F.col("version_id").alias("_has")), "evidence_id", "left")
    problem = (
        F.when(~F.coalesce((F.trim("method") != "") & (F.char_length("method") <= 100), F.lit(False)), "METHOD")
        .when(F.col("_e").isNull() | F.col("_v").isNull(), "UNKNOWN")
        .when(F.col("_e") != F.col("_v"), "OTHER_DOCUMENT")
    )
    x = x.withColumn("_problem", problem)
    w = Window.partitionBy("evidence_id", F.col("_problem").isNull()).orderBy(*order)
    # Requests of one evidence row are few: it has one passage of one document.
    has = F.coalesce("_has", F.first("version_id").over(w))
    action = F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(has != F.col("version_id"), "OTHER_VERSION").when(F.col("_has").isNull() & (F.row_number().over(w) == 1), "ATTACH").otherwise("EXISTING")
    return x.withColumn("action", action).select(*requests.columns, "action")


def retained(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days`` (D10); rows without a time stay."""
    return df.where(F.col(at).isNull() | (F.col(at) >= now - F.expr(f"INTERVAL '{days}' DAY")))


def connector_hits(hits: DataFrame, connector: str, url: Column, position: str, limit: int) -> DataFrame:
    """First hit of each canonical URL per connector, at most ``limit`` in order (D11). Hits without a valid URL are dropped."""
    from attestry.operators.relational import top_rows

    x = first_rows(hits.withColumn("canonical_url", url).where("canonical_url is not null"), [connector, "canonical_url"], [F.col(position)])
    return top_rows(x, [connector], [F.col(position)], limit)
