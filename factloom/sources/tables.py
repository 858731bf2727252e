"""The driver's tables, and result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions_for(df: DataFrame, rows: int = 400_000) -> int:
    """Partitions for a shuffle of df, at least as many as the session's, so that a task's rows don't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


#: The columns of the detectors' result tables, in order.
RESULTS = {
    "move method": ("refactoring_type", "source_entity", "target_class", "source_deps", "target_deps"),
    "extract class": ("source_class", "topics", "entities", "source_deps", "extracted_deps"),
    "extract method": ("method", "variable", "block_id", "duplicated", "extracted"),
    "type check": ("label", "size_system", "avg_size_class", "avg_statements"),
}


def write_tsv(df: DataFrame, path: str, kind: str | None = None, one_file: bool = False) -> None:
    """Tab-separated text with a header. one_file is for results that are small enough to be read by a person."""
    out = df.select(*RESULTS[kind]) if kind else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
