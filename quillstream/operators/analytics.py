"""Operational analyses over the log and a read model that says when each event was processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_range(log: DataFrame) -> DataFrame:
    """Count, first and last timestamp."""
    return log.agg(F.count("*").alias("n"), F.min("event_timestamp").alias("first_at"), F.max("event_timestamp").alias("last_at"))


def per_second(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("second", "event_timestamp").alias("second")).agg(F.count("*").alias("n"))


def latency_ms(start: str = "event_timestamp", end: str = "processed_at") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / F.lit(1000.0)


def latencies(log: DataFrame, read_model: DataFrame) -> DataFrame:
    """Log joined to the read model on position, with each event's latency."""
    return log.join(read_model, log["position"] == read_model["event_position"]).withColumn("latency_ms", latency_ms())


def _summary() -> list[Column]:
    exact = [F.percentile("latency_ms", F.lit(p)).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95)]
    return [F.count("*").alias("n"), F.avg("latency_ms").alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), *exact]


def latency_summary(log: DataFrame, read_model: DataFrame) -> DataFrame:
    """Percentiles interpolate like percentile_cont. Equal latencies are counted before they are ranked."""
    return latencies(log, read_model).agg(*_summary())


def latency_by_second(log: DataFrame, read_model: DataFrame) -> DataFrame:
    return latencies(log, read_model).groupBy(F.date_trunc("second", "event_timestamp").alias("second")).agg(*_summary())


def duplicate_positions(read_model: DataFrame) -> DataFrame:
    return read_model.groupBy("event_position").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_details(log: DataFrame, read_model: DataFrame) -> DataFrame:
    """Read-model rows of duplicated positions, with the log's row where there is one."""
    twice = duplicate_positions(read_model).select("event_position")
    return read_model.join(twice, "event_position", "left_semi").join(log, F.col("event_position") == log["position"], "left")


def unprocessed(log: DataFrame, read_model: DataFrame) -> DataFrame:
    return log.join(read_model, log["position"] == read_model["event_position"], "left_anti")


def out_of_order(log: DataFrame, rows_of_a_range: int = 100_000) -> DataFrame:
    """Events whose tx is smaller than that of the event one position before.

    Instead of one window over the whole log, positions are cut into ranges: a window in each, and
    the last row of every range (a small table) stitched to the first of the next.
    """
    low, high, n = log.agg(F.min("position"), F.max("position"), F.count("*")).first()
    if low is None:
        return log.select("position", "tx", F.lit(None).cast("long").alias("prev_position"), F.lit(None).cast("long").alias("prev_tx")).where(F.lit(False))
    size = max(1, (high - low + 1) * rows_of_a_range // n)
    rows = log.select("position", "tx", ((F.col("position") - low) / size).cast("long").alias("range"))
    w = Window.partitionBy("range").orderBy("position")
    inside = rows.withColumns({"prev_tx": F.lag("tx").over(w), "prev_position": F.lag("position").over(w)})
    lasts = rows.groupBy("range").agg(F.max(F.struct("position", "tx")).alias("last"))
    lasts = lasts.select(F.col("range").alias("at"), F.lag("last").over(Window.orderBy("range")).alias("before"))  # one row a range
    joined = inside.join(lasts, F.col("range") == F.col("at"), "left")
    stitched = joined.select(
        "position", "tx",
        F.coalesce("prev_position", "before.position").alias("prev_position"), F.coalesce("prev_tx", "before.tx").alias("prev_tx"),
    )
    return stitched.where("tx < prev_tx")


def last_per_stream(log: DataFrame) -> DataFrame:
    """The newest reference of every stream, as one append's notifications are merged."""
    return log.groupBy("stream_context", "stream_purpose").agg(
        F.max(F.struct("tx", "position", "event_id")).alias("last")
    ).select("stream_context", "stream_purpose", "last.tx", "last.position", "last.event_id")


def last_value(log: DataFrame, key: Column, value: Column) -> DataFrame:
    """A fold that keeps the newest value of each key."""
    return log.groupBy(key.alias("key")).agg(F.max_by(value, F.struct("tx", "position")).alias("value"))
