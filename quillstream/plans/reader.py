"""Queries over a log DataFrame as lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.model import EventQuery, EventReference, Limit, LimitExceeded, StreamId
from quillstream.plans import predicates as P


def select_events(log: DataFrame, query: EventQuery, stream: StreamId = StreamId.any(), cursor: EventReference | None = None) -> DataFrame:
    """The stored rows that a query sees, in no order: stream, filter, bound and cursor."""
    if query.filter.is_match_none:
        return log.where(F.lit(False))
    found = log.where(P.in_stream(stream)).where(P.filter_matches(query.filter))
    return found.where(P.beyond(cursor, query.direction)) if cursor else found


def effective_limit(limit: Limit, hard_limit: int | None) -> int | None:
    """Rows to fetch: the soft limit, or one more than the hard limit so that exceeding it shows."""
    if hard_limit is None:
        return limit.value
    if limit.value is not None:
        if limit.value > hard_limit:
            raise LimitExceeded(f"the query's limit {limit.value} exceeds the hard limit {hard_limit}")
        return limit.value
    return hard_limit + 1


def query_log(
    log: DataFrame, query: EventQuery, stream: StreamId = StreamId.any(), cursor: EventReference | None = None,
    limit: Limit | None = None, hard_limit: int | None = None,
) -> DataFrame:
    """Stored rows in reading order. A limit becomes a top-k of each task, not a global sort.

    With a hard limit the rows are counted at once, and too many raise LimitExceeded.
    """
    soft = query.limit if limit is None else limit
    fetch = effective_limit(soft, hard_limit)
    rows = select_events(log, query, stream, cursor).orderBy(*P.reading_order(query.direction))
    if fetch is not None:
        rows = rows.limit(fetch)
    if hard_limit is not None and soft.value is None and rows.count() > hard_limit:
        raise LimitExceeded(f"the query meets more than the hard limit of {hard_limit} events")
    return rows


def event_by_id(log: DataFrame, event_id: str, stream: StreamId = StreamId.any()) -> DataFrame:
    return log.where((F.col("event_id") == event_id) & P.in_stream(stream))


def tag_index(log: DataFrame) -> DataFrame:
    """(tag, stream_context, stream_purpose, event_type, tx, position), to be written sorted by tag."""
    return log.select(F.explode("event_tags").alias("tag"), "stream_context", "stream_purpose", "event_type", "tx", "position")


def with_all_tags(log: DataFrame, index: DataFrame, tags: list[str]) -> DataFrame:
    """Rows of log with all tags, through the index: for selective tags of a large log."""
    hits = index.where(F.col("tag").isin(tags)).groupBy("tx", "position").agg(F.count_distinct("tag").alias("n"))
    return log.join(hits.where(F.col("n") == len(set(tags))).select("tx", "position"), ["tx", "position"], "left_semi")


def reference_text(index_column: str | None = None):
    """id:tx:position, and :index where it is not 0."""
    base = F.concat_ws(":", "event_id", F.col("tx").cast("string"), F.col("position").cast("string"))
    if not index_column:
        return base
    return F.concat(base, F.when(F.col(index_column) > 0, F.concat(F.lit(":"), F.col(index_column).cast("string"))).otherwise(F.lit("")))


def tag_value(key: str, column: str = "event_tags"):
    """Value of the smallest tag with that key; null without one."""
    own = F.array_sort(F.filter(column, lambda t: t.startswith(f"{key}:")))
    return F.substring(F.get(own, F.lit(0)), len(key) + 2, 1 << 20)
