"""Filters, cursors and streams as Columns over the log.

Scalar parts (type, stream, tx, position) reach the Parquet scan; tag containment is evaluated in
the same generated code as the rest.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.model import Direction, EventFilter, EventReference, FilterItem, StreamId, Tags


def has_tags(tags: Tags, column: str = "event_tags") -> Column:
    """All tags present."""
    return reduce(and_, [F.array_contains(column, t) for t in tags.texts()], F.lit(True))


def has_any_tag(tags: Tags, column: str = "event_tags") -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, tags.texts()))), F.lit(False)) if tags else F.lit(False)


def item_matches(item: FilterItem, type_column: str = "event_type") -> Column:
    parts = [F.col(type_column).isin(sorted(item.types))] if item.types else []
    if item.tags:
        parts.append(has_tags(item.tags))
    return reduce(and_, parts, F.lit(True)) if parts else F.lit(True)


def up_to(until: EventReference, index_column: str | None = None) -> Column:
    """(tx, position, index) <= until; stored rows stand at index 0."""
    tx, position = F.col("tx"), F.col("position")
    last = position == until.position
    if index_column:
        last = last & (F.col(index_column) <= until.index)
    return (tx < until.tx) | ((tx == until.tx) & ((position < until.position) | last))


def filter_matches(event_filter: EventFilter, type_column: str = "event_type", index_column: str | None = None) -> Column:
    """One predicate over all items, so an event that matches several is returned once."""
    if event_filter.is_match_none:
        return F.lit(False)
    found = F.lit(True) if event_filter.items is None else reduce(or_, [item_matches(i, type_column) for i in event_filter.items])
    return found & up_to(event_filter.until, index_column) if event_filter.until else found


def beyond(cursor: EventReference, direction: Direction) -> Column:
    """Strictly after the cursor in the direction of reading."""
    tx, position = F.col("tx"), F.col("position")
    if direction is Direction.BACKWARD:
        return (tx < cursor.tx) | ((tx == cursor.tx) & (position < cursor.position))
    return (tx > cursor.tx) | ((tx == cursor.tx) & (position > cursor.position))


def in_stream(stream: StreamId) -> Column:
    parts = []
    if stream.context is not None:
        parts.append(F.col("stream_context") == stream.context)
    if stream.purpose is not None:
        parts.append(F.col("stream_purpose") == stream.purpose)
    return reduce(and_, parts) if parts else F.lit(True)


def reading_order(direction: Direction, index: bool = False) -> list[Column]:
    names = ["tx", "position"] + (["index"] if index else [])
    return [F.col(n).desc() if direction is Direction.BACKWARD else F.col(n).asc() for n in names]
