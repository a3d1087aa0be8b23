"""Writing of tables, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sort_by: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet with zstd; readers see all of it or nothing.

    ``sort_by`` lays rows out in range order, so that lookups by these columns skip row groups.
    """
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, condition: str | None = None) -> DataFrame:
    """Parquet with a filter and projection that reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(condition) if condition else df
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def fingerprint(columns: list[str]) -> Column:
    """An aggregate over rows that does not depend on their order but on how often each occurs: the sum of 60 bits of their MD5."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")


def manifest(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """One JSON text: rows, distribution by columns, and a fingerprint that does not depend on the order of rows."""
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), fingerprint(df.columns).alias("x"))
    one = groups.agg(
        F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("x"), F.lit(0)).cast("string").alias("fingerprint"),
        F.array_sort(F.collect_list(F.struct(*by, "n"))).alias("distribution"),
    )
    return one.select(F.to_json(F.struct("*")).alias("manifest"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path, below 2 GB each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_manifest(df: DataFrame, name: str, by: list[str], path: str) -> dict:
    """Writes the manifest as a text file and returns it."""
    m = manifest(df, name, by)
    m.coalesce(1).write.mode("overwrite").text(path)
    return json.loads(m.head()[0])


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or JSON lines."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError("csv or json")


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report as a Markdown table, whole: one of more than ``most`` rows is an error, as it would come to the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with write_report")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    lines += ["| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"
