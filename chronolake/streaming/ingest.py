"""Provenance writes as a stream, with the semantics of upsert: the last payload, the first created.

An extension: the writes of a micro-batch are folded into a table of versions, one folder per
batch. A batch that runs again writes the same folder again, so a restart loses and doubles
nothing. Only the changed keys and the table itself meet, by an equi-join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.provenance import upsert


def merge_batch(table: DataFrame | None, batch: DataFrame, keys: list[str], payload: list[str], order: list[str], created: str) -> DataFrame:
    """The table after the writes of a batch. Its rows keep the place of their last write in columns named as order."""
    new = upsert(batch, keys, [*payload, *order], order, created)
    if table is None:
        return new
    columns = [*keys, *payload, *order, created]
    old = table.select(*columns)
    met = old.alias("o").join(new.alias("n"), keys, "full")
    later = F.col(f"n.{order[0]}").isNotNull() & (F.col(f"o.{order[0]}").isNull() | (F.struct(*(F.col(f"n.{c}") for c in order)) > F.struct(*(F.col(f"o.{c}") for c in order))))
    pick = lambda c: F.when(later, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    first = F.least(F.col(f"o.{created}"), F.col(f"n.{created}")).alias(created)
    return met.select(*keys, *map(pick, [*payload, *order]), first)


def version(folder: str, batch: int) -> str:
    return f"{folder}/version={batch:012d}"


def current(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.parquet(version(folder, batch))


def ingest(events: DataFrame, folder: str, checkpoint: str, keys: list[str], payload: list[str], order: list[str], created: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts folding a stream of writes into folder; trigger as in writeStream.trigger."""

    def fold(batch: DataFrame, number: int) -> None:
        table = current(batch.sparkSession, folder, number - 1) if number else None
        merge_batch(table, batch, keys, payload, order, created).write.mode("overwrite").parquet(version(folder, number))

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rates(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Writes per window and type of a stream (ts, event_type); later ones than late are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("writes")).select(F.col("w.start").alias("start"), "event_type", "writes")
