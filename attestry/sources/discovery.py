"""Saved result pages of searches as a Spark data source."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES = 2_000_000


class ResultFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ResultReader(DataSourceReader):
    """One task per file; a file above ``maxBytes`` is an error, as an answer of that size would be."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].removeprefix("file:")
        self.connector = options["connector"]
        self.most = int(options.get("maxBytes", MOST_BYTES))

    def partitions(self) -> list[ResultFile]:
        return [ResultFile(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")] or [ResultFile("")]

    def read(self, partition: ResultFile) -> Iterator[tuple[str, str, str]]:
        if not partition.path:
            return
        if os.path.getsize(partition.path) > self.most:
            raise ValueError(f"{partition.path} is above {self.most} bytes")
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield self.connector, os.path.basename(partition.path), f.read()


class DiscoveryResults(DataSource):
    """``spark.read.format("discovery").option("connector", name).load(folder)``: rows (connector, page, payload).

    The folder must be readable by every executor. Payloads are normalised by ``records.news_hits`` and ``records.review_hits``.
    """

    @classmethod
    def name(cls) -> str:
        return "discovery"

    def schema(self) -> str:
        return "connector string, page string, payload string"

    def reader(self, schema) -> ResultReader:  # noqa: ANN001
        return ResultReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DiscoveryResults)
