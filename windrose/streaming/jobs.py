"""Structured Streaming forms of the availability rule: a verified case becomes usable at its valid time.

The functions build streaming DataFrames; the caller picks trigger and sink.  State is bounded by watermarks, and
checkpoints and outputs live in folders of the caller's choice (shared storage), so a later run with the same folders goes on
where the last one ended.  Rows behind the watermark are dropped by the engine; ``record_late_rows`` keeps them in a side table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.session import scratch_path


def verified_forecasts(forecasts: DataFrame, verification: DataFrame, max_lead_days: int, lateness: str = "1 day") -> DataFrame:
    """Forecast stream joined with the verification stream on (region, valid time).

    Forecasts wait in state for at most the longest lead plus the lateness; the time bound in the condition lets the
    engine drop them afterwards."""
    f = forecasts.withWatermark("init_time", lateness).alias("f")
    v = verification.withColumnsRenamed({"valid_time": "v_time", "region_id": "v_region"}).withWatermark("v_time", lateness).alias("v")
    bound = F.expr(f"v_time >= init_time AND v_time <= init_time + INTERVAL {max_lead_days} DAYS")
    return f.join(v, (F.col("region_id") == F.col("v_region")) & (F.col("valid_time") == F.col("v_time")) & bound).drop("v_region", "v_time")


def trailing_errors(verified: DataFrame, window_days: int = 5, slide: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Verified-error statistics per region over (T - window, T] for every slide step T.

    Windows are closed on the left; shifting the event time back by one microsecond turns [T - w, T) into (T - w, T]."""
    shifted = verified.withColumn("_t", F.col("valid_time") - F.expr("INTERVAL '0.000001' SECOND")).withWatermark("_t", lateness)
    g = shifted.groupBy("region_id", F.window("_t", f"{window_days} days", slide)).agg(
        F.avg("norm_error").alias("rec_err"), F.avg("bias_m").alias("rec_bias"), F.count(F.lit(1)).alias("rec_n"))
    return g.select("region_id", F.col("window.end").alias("init_time"), "rec_err", "rec_bias", "rec_n")


def run_available(stream: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append",
                  out: str | None = None, state: str | None = None) -> str:
    """Process all available input and write each micro-batch to its own folder of a parquet table; returns the path.

    ``out`` and ``state``: folders of table and checkpoint; a run with those of an earlier one resumes it.  Without them fresh
    folders in the scratch storage are taken.  A batch folder is overwritten when the batch is retried, so the sink is idempotent."""
    if (out is None) != (state is None):
        raise ValueError("give both folders or none: a table without its checkpoint would repeat rows")
    spark = stream.sparkSession
    out, state = out or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return out


def record_late_rows(stream: DataFrame, time: str, lateness: str, out: str, state: str) -> str:
    """Side table ``out/late`` of the rows that arrive with an event time at or before the watermark of their stream: the largest
    time of all earlier micro-batches minus ``lateness``.  The largest time of each batch is kept in ``out/seen``, so a resumed or
    retried batch decides alike.  Rows without a time are recorded as well.  The engine drops a row only when the watermark of the batch
before the last one has passed it (for windows: all of its windows), so the table holds every dropped row and may hold rows that
were just in time for a result.  Returns the path of the side table."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{out}/seen/epoch={epoch}")
        seen = spark.read.parquet(f"{out}/seen").where(F.col("epoch") < epoch).agg((F.max("newest") - F.expr(f"INTERVAL {lateness}")).alias("mark"))
        late = F.col(time).isNull() | (F.col(time) <= seen.scalar())
        batch.where(late).write.mode("overwrite").parquet(f"{out}/late/epoch={epoch}")
    q = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return f"{out}/late"


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Final value of every key from a table of updates (one row per key and epoch)."""
    w = W.partitionBy(*keys).orderBy(F.desc("epoch"))
    return updates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "epoch")
