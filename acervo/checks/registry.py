"""Registered queries: each operator over the given tables, with its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[["Tables"], DataFrame]


@dataclass(frozen=True)
class Check:
    build: Build
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = Check(build, sql)
        return build

    return register


class Tables:
    """The given tables of one scale, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are costly to process, dealt over all cores; a large one over no fewer tasks than its scan has."""
        table = getattr(self, name)
        return table.repartition(max(self.spark.sparkContext.defaultParallelism, table.rdd.getNumPartitions()))
