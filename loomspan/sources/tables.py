"""Database tables over JDBC, with parameters that never reach a message."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Database:
    """Where a database is. Its representation shows no URL, user or password."""

    url: str = field(repr=False)
    options: dict[str, str] = field(default_factory=dict, repr=False)

    def reader(self, spark: SparkSession):
        return spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def read(self, spark: SparkSession, table: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        """A table; ``partition`` (column, lowest, highest, parts) reads it by ranges of a numeric column in parallel."""
        reader = self.reader(spark).option("dbtable", table)
        if partition:
            column, low, high, parts = partition
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
        return reader.load()

    def append(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").option("url", self.url).options(**self.options).option("dbtable", table).mode("append").save()

    def reachable(self, spark: SparkSession, query: str = "SELECT 1 AS up") -> bool:
        """Whether a trivial query is answered. Why not is not told: driver messages may hold the URL."""
        try:
            return self.reader(spark).option("query", query).load().count() > 0
        except Exception:
            return False
