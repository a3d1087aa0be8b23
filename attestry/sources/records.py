"""Reading of raw claim and page records, and discovery results."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.identity import article_identity, aware_timestamp, text_value
from attestry.operators.nested import evidence_rows, evidence_variant

PAGE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "text", "lines")])


def claim_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, source_file, payload) of JSON lines (S1). Files are split for reading; blank lines are left out."""
    lines = spark.read.text(path).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return lines.where(F.col("value").rlike(r"\S")).select(F.monotonically_increasing_id().alias("record_id"), "source_file", F.col("value").alias("payload"))


def accepted_and_rejected(records: DataFrame, payload: str = "payload", key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Valid claim records with typed columns, and the records that break a rule."""
    valid = evidence_variant(records, payload, key)
    good = valid.select(
        key, F.try_variant_get("v", "$.id", "bigint").alias("claim_id"), F.try_variant_get("v", "$.label", "string").alias("label"),
        F.regexp_replace(F.try_variant_get(F.col("v"), "$.claim", "string"), r"(?U)^\s+|\s+$", "").alias("claim"), F.size("sets").alias("evidence_set_count"),
    )
    return good, records.join(good.select(key), key, "left_anti")


def claim_evidence(records: DataFrame) -> DataFrame:
    """Evidence of claim records, one row per item, with set and position."""
    return evidence_rows(records)


def is_page_member(name: str) -> bool:
    """A member of JSON lines that is no artefact of an archiver."""
    path = PurePosixPath(name)
    return "__MACOSX" not in path.parts and not path.name.startswith("._") and path.name.lower().endswith(".jsonl")


def zipped_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, lines, source_member) of the JSON-lines members of zip archives, members in order (S3).

    An archive is read by one task, its members as streams; put a large corpus into many archives. Broken lines
    give a row of nulls but for the member.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if is_page_member(n)):
                        out = []
                        with z.open(member) as f:
                            for line in io.TextIOWrapper(f, encoding="utf-8", errors="replace"):
                                if not line.strip():
                                    continue
                                try:
                                    p = {str(k).strip().strip("'\""): v for k, v in json.loads(line).items()}
                                except (ValueError, AttributeError):
                                    p = {}
                                out.append([*(None if p.get(c) is None else str(p[c]) for c in ("id", "text", "lines")), member])
                                if len(out) == 5000:
                                    yield pd.DataFrame(out, columns=["id", "text", "lines", "source_member"])
                                    out = []
                        yield pd.DataFrame(out, columns=["id", "text", "lines", "source_member"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return files.mapInPandas(rows, "id string, text string, lines string, source_member string")


def page_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, text, lines, source_member) and rejected ones: content without an id (S4). Wholly blank records are skipped."""
    x = raw.select(
        F.regexp_replace(F.coalesce("id", F.lit("")), r"(?U)^\s+|\s+$", "").alias("page_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("lines", F.lit("")).alias("lines"), "source_member",
    )
    blank = ~F.col("text").rlike(r"(?U)\S") & ~F.col("lines").rlike(r"(?U)\S")
    return x.where("page_id <> ''"), x.where((F.col("page_id") == "") & ~blank)


# The signs that end a line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def page_lines(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "source_member")) -> DataFrame:
    """(page_id, sentence_id, text, raw_line, source_member) of pages' lines.

    A line is an integer, a tab and the sentence, with link data behind a further tab. Lines of another form
    belong to the sentence before; those before any sentence, and blank lines, are dropped. The lines of a page are
    put in order within the page; ``keys`` tell pages apart.
    """
    lines = pages.select(*keys, F.posexplode(F.split("lines", LINE_ENDS)).alias("pos", "line")).where(F.col("line").rlike(r"(?U)\S"))
    number = F.when(F.col("line").contains("\t"), F.regexp_extract("line", r"^\s*([+-]?\d+)\s*\t", 1).try_cast("int"))
    of_page = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("sentence_id", number).withColumn("head", F.count("sentence_id").over(of_page)).where("head > 0")
    g = x.groupBy(*keys, "head").agg(
        F.max("sentence_id").alias("sentence_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("raw_line"),
    )
    text = F.regexp_replace(F.regexp_extract("raw_line", r"^[^\t]*\t([^\t\n]*)", 1), r"(?U)^\s+|\s+$", "")
    return g.select(*keys, "sentence_id", text.alias("text"), "raw_line")


def news_hits(results: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Normalised articles of news search results, one row per article with a valid https URL and a title (S13), with the columns ``keep`` of the result."""
    v = results.select(*keep, F.try_parse_json(payload).alias("v"))
    items = F.try_variant_get(F.col("v"), "$.articles", "array<variant>")
    x = v.select(*keep, F.posexplode(items).alias("position", "a"))
    return _hits(x, "a", {"url": "$.url", "title": "$.title", "publisher": "$.source.name", "snippet": "$.description", "published": "$.publishedAt"}, keep=keep)


def review_hits(results: DataFrame, payload: str = "payload") -> DataFrame:
    """Normalised fact-check reviews, one row per review (S13); the title falls back on the claim's text."""
    v = results.select(F.try_parse_json(payload).alias("v"))
    claims = v.select(F.posexplode(F.try_variant_get(F.col("v"), "$.claims", "array<variant>")).alias("c_pos", "c"))
    x = claims.select("c_pos", F.try_variant_get("c", "$.text", "string").alias("claim_text"), F.posexplode(F.try_variant_get(F.col("c"), "$.claimReview", "array<variant>")).alias("r_pos", "a"))
    x = x.withColumn("position", F.col("c_pos").cast("long") * 2**32 + F.col("r_pos"))
    out = {"url": "$.url", "title": "$.title", "publisher": "$.publisher.name", "snippet": None, "published": "$.reviewDate"}
    return _hits(x, "a", out, F.col("claim_text"))


def _hits(x: DataFrame, item: str, paths: dict, fallback=None, keep: tuple[str, ...] = ()) -> DataFrame:
    got = {k: F.try_variant_get(F.col(item), p, "string") if p else F.lit(None).cast("string") for k, p in paths.items()}
    who = article_identity(got["url"])
    title = text_value(got["title"]) if fallback is None else F.coalesce(text_value(got["title"]), text_value(fallback, 4000))
    snippet = text_value(got["snippet"], 2000) if fallback is None else text_value(fallback, 4000)
    y = x.select(
        *keep, "position", who["url"].alias("url"), who["domain"].alias("publisher_domain"), F.coalesce(text_value(got["publisher"], 255), who["domain"]).alias("publisher_name"),
        title.alias("title"), snippet.alias("snippet"), aware_timestamp(got["published"]).alias("published_at"),
    )
    return y.where("url is not null and title is not null")
