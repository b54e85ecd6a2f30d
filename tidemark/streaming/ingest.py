"""Incremental ingestion: streams of bar files upserted by key, and revised facts appended with their own availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import keep_last, valid_bar
from ..schemas import OHLCV
from ..sources.tables import upsert_bars


def stream_bars(spark: SparkSession, incoming: str, path: str, work: str, files_per_batch: int = 20) -> None:
    """Bring all bar files that arrived into the stored table. A restart repeats at most one batch, which changes nothing.

    Of bars that repeat a key in a batch the one from the file written last stands (then by file name, then by the bar itself). Bars that
    aren't valid are left out of the table and written to ``<work>/rejected``, under their batch's number."""

    def commit(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(valid_bar(), F.lit(False))
        batch.filter(~ok).write.mode("overwrite").parquet(f"{work}/rejected/batch={number}")
        own = [c.split()[0] for c in OHLCV.split(", ")]
        rows = batch.filter(ok).withColumn("_order", F.struct("_written", "_file", *[c for c in own if c not in ("ticker", "dt")]))
        rows = keep_last(rows.select(*own, "_order"), ["ticker", "dt"], "_order").select(*own)
        if not rows.isEmpty():
            upsert_bars(rows, path, f"{work}/staging")

    rows = spark.readStream.schema(OHLCV).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    rows = rows.withColumn("raw_close", F.coalesce("raw_close", "close"))
    rows = rows.withColumn("_written", F.col("_metadata.file_modification_time")).withColumn("_file", F.col("_metadata.file_name"))
    rows.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


def stream_counts(spark: SparkSession, incoming: str, schema: str, out: str, work: str, time: str = "ts", keys: tuple[str, ...] = ("event_type",), late: str = "2 hours") -> None:
    """Hourly counts and sums per key with a watermark; a batch's changed windows replace themselves under its number."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(incoming).withColumn(time, F.col(time).cast("timestamp"))
    agg = events.withWatermark(time, late).groupBy(*keys, F.window(time, "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    agg = agg.select(*keys, F.col("window.start").alias("hour"), "n", "total")

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    agg.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


def latest_counts(spark: SparkSession, out: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    rows = spark.read.parquet(out)
    return rows.groupBy(*keys, "hour").agg(F.max(F.struct("batch", "n", "total")).alias("t")).select(*keys, "hour", "t.n", "t.total")


def append_facts(batch: DataFrame, path: str) -> None:
    """Append-only bitemporal facts: a correction is a new row that is visible from its own availability on."""
    if not batch.filter("available_at IS NULL").isEmpty():
        raise ValueError("a fact needs the instant from which it was available")
    batch.write.mode("append").parquet(path)
