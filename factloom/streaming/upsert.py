"""Changes (added, changed, removed) of units as a stream, applied to a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import upsert


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key: what a batch comes to."""
    w = W.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return changes.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """table after changes with a column `op` (added, changed, removed); only the last change of a key counts."""
    last = latest(changes, key, order)
    return upsert(table, key, removed=last.filter("op = 'removed'"), changed=last.filter("op <> 'removed'").select(*table.columns))


def keep_table(changes: DataFrame, path: str, key: list[str], order: list[str], columns: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps path/v<batch> up to date: each batch reads the version before it and writes the next one.

    A batch that is run again writes the same version, so a restart neither loses nor doubles a change.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = batch.select(*columns).limit(0)
        before = spark.read.schema(empty.schema).parquet(f"{path}/v{number - 1}") if number else empty
        apply_changes(before, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts in tumbling windows; events later than the watermark are left out in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
