"""Registration of queries, and views over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """documents, for queries that analyse their texts."""
        return spread(self.documents)

    @property
    def records(self) -> DataFrame:
        """documents and labels as a record table."""
        joined = self.documents.join(self.labels, "doc_id", "left")
        return joined.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("base"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
            (F.coalesce("quality", F.lit(1)) == 1).alias("indexable"),
            F.col("text").alias("content"),
            F.col("doc_id").alias("mtime"),
        )


RECORDS_SQL = """(SELECT d.doc_id AS id, d.source AS base, coalesce(l.toxic, 0) = 1 AS deleted, coalesce(l.quality, 1) = 1 AS indexable,
d.text AS content, d.doc_id AS mtime FROM documents d LEFT JOIN labels l USING (doc_id))"""


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with SQL for the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register
