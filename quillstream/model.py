"""Value objects of the event log: pure Python, no Spark.

An event log is one totally ordered sequence; streams are views of it by context and purpose.
Queries are a disjunction of items (type in a set AND tags a subset), a bound, a direction and a
limit. Ordering is by (tx, position, index).
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum
from functools import total_ordering
from typing import Any


class LedgerError(Exception):
    """Base of all errors of this library."""


class LimitExceeded(LedgerError):
    """A query asks for, or meets, more rows than the store's hard limit."""


class OptimisticLockingError(LedgerError):
    """A conditional append met a conflicting event."""

    def __init__(self, event_filter: "EventFilter", expected: "EventReference | None"):
        self.filter, self.expected = event_filter, expected
        where = f"after {expected}" if expected else "although none was expected"
        super().__init__(f"conflicting events exist {where} for filter {event_filter}")


# ---- tags ------------------------------------------------------------------------------------


@dataclass(frozen=True, order=True)
class Tag:
    """(key, value), either of which may be absent; text forms key, key:value and :value."""

    key: str | None
    value: str | None = None

    def __post_init__(self):
        for name in ("key", "value"):
            text = getattr(self, name)
            object.__setattr__(self, name, (text.strip() or None) if text is not None else None)
        if self.key is None and self.value is None:
            raise ValueError("a tag needs a key or a value")
        if self.key and ":" in self.key:
            raise ValueError(f"a tag's key holds no colon: {self.key}")

    @staticmethod
    def of(key: str | None, value: str | None = None) -> "Tag":
        return Tag(key, value)

    @staticmethod
    def parse(text: str | None) -> "Tag | None":
        """Split on the first colon; nothing on either side gives no tag."""
        key, _, value = (text or "").partition(":")
        return Tag(key, value) if key.strip() or value.strip() else None

    def __str__(self) -> str:
        return (self.key or "") + (f":{self.value}" if self.value is not None else "")


class Tags(frozenset):
    """A set of tags."""

    @staticmethod
    def of(*tags: Tag | str) -> "Tags":
        return Tags(t for t in (Tag.parse(t) if isinstance(t, str) else t for t in tags) if t is not None)

    @staticmethod
    def none() -> "Tags":
        return Tags()

    parse = of

    def contains_all(self, other: Iterable[Tag]) -> bool:
        return self.issuperset(other)

    def merge(self, other: Iterable[Tag]) -> "Tags":
        return Tags(self | frozenset(other))

    def tag(self, key: str) -> Tag | None:
        """The tag of that key; the smallest where several have it."""
        return min((t for t in self if t.key == key), key=str, default=None)

    def texts(self) -> list[str]:
        return sorted(map(str, self))


# ---- references and streams ------------------------------------------------------------------


@total_ordering
@dataclass(frozen=True)
class EventReference:
    """Where an event stands: its id and (tx, position, index); index numbers the parts of an upcast event."""

    id: str
    position: int
    tx: int
    index: int = 0

    def __post_init__(self):
        if not (self.id or "").strip():
            raise ValueError("an event id is not blank")
        if self.position <= 0:
            raise ValueError(f"a position is positive: {self.position}")
        if self.index < 0 or not 0 <= self.tx < 2**63:
            raise ValueError("index and tx are not negative, and tx fits 63 bits")

    @property
    def order(self) -> tuple[int, int, int]:
        return self.tx, self.position, self.index

    def __lt__(self, other: "EventReference") -> bool:
        return self.order < other.order

    def happened_before(self, other: "EventReference") -> bool:
        return self.order < other.order

    def happened_after(self, other: "EventReference") -> bool:
        return self.order > other.order

    def __str__(self) -> str:
        return f"{self.id}:{self.tx}:{self.position}" + (f":{self.index}" if self.index else "")

    @staticmethod
    def parse(text: str) -> "EventReference":
        parts = (text or "").split(":")
        if len(parts) not in (3, 4):
            raise ValueError(f"not a reference: {text!r}")
        try:
            tx, position, index = int(parts[1]), int(parts[2]), int(parts[3]) if len(parts) == 4 else 0
        except ValueError:
            raise ValueError(f"not a reference: {text!r}") from None
        return EventReference(parts[0], position, tx, index)


def new_event_id() -> str:
    return str(uuid.uuid4())


DEFAULT_PURPOSE = "default"


@dataclass(frozen=True)
class StreamId:
    """context#purpose; None stands for any."""

    context: str | None = None
    purpose: str | None = DEFAULT_PURPOSE

    @staticmethod
    def any() -> "StreamId":
        return StreamId(None, None)

    def any_purpose(self) -> "StreamId":
        return StreamId(self.context, None)

    def any_context(self) -> "StreamId":
        return StreamId(None, self.purpose)

    @property
    def is_specific(self) -> bool:
        return self.context is not None and self.purpose is not None

    def can_read(self, other: "StreamId") -> bool:
        return self.context in (None, other.context) and self.purpose in (None, other.purpose)

    def can_append_to(self, target: "StreamId") -> bool:
        """The target equals this stream, or is one of its purposes where this stream has any."""
        return self == target or (self.purpose is None and self.context is not None and self.context == target.context)

    def __str__(self) -> str:
        return f"{self.context or ''}#{self.purpose or ''}"


# ---- queries ---------------------------------------------------------------------------------


class Direction(Enum):
    FORWARD = "forward"
    BACKWARD = "backward"


@dataclass(frozen=True)
class Limit:
    value: int | None = None

    def __post_init__(self):
        if self.value is not None and self.value <= 0:
            raise ValueError(f"a limit is positive: {self.value}")

    @staticmethod
    def none() -> "Limit":
        return Limit(None)

    @staticmethod
    def to(value: int) -> "Limit":
        return Limit(value)

    def or_if_lower(self, other: "Limit | None") -> "Limit":
        values = [x.value for x in (self, other) if x is not None and x.value is not None]
        return Limit(min(values) if values else None)


def _types(types: Iterable[str]) -> frozenset[str]:
    return frozenset(types)


@dataclass(frozen=True)
class FilterItem:
    """type IN types (none: any) AND tags all present."""

    types: frozenset[str] = frozenset()
    tags: Tags = Tags()

    def matches(self, event_type: str, tags: Iterable[Tag]) -> bool:
        return (not self.types or event_type in self.types) and Tags(tags).contains_all(self.tags)


@dataclass(frozen=True)
class EventFilter:
    """OR over items; items None is everything, no items is nothing; until is an inclusive bound."""

    items: tuple[FilterItem, ...] | None = None
    until: EventReference | None = None

    @staticmethod
    def match_all() -> "EventFilter":
        return EventFilter(None)

    @staticmethod
    def match_none() -> "EventFilter":
        return EventFilter(())

    @staticmethod
    def for_events(types: Iterable[str] = (), tags: Tags | Iterable[str] = ()) -> "EventFilter":
        return EventFilter((FilterItem(_types(types), tags if isinstance(tags, Tags) else Tags.of(*tags)),))

    @property
    def is_match_all(self) -> bool:
        return self.items is None

    @property
    def is_match_none(self) -> bool:
        return self.items == ()

    def matches(self, event_type: str, tags: Iterable[Tag], reference: EventReference | None = None) -> bool:
        if self.until is not None and reference is not None and reference > self.until:
            return False
        return self.items is None or any(i.matches(event_type, tags) for i in self.items)

    def with_until(self, until: EventReference | None) -> "EventFilter":
        return dataclasses.replace(self, until=until)

    def until_if_earlier(self, until: EventReference | None) -> "EventFilter":
        bounds = [x for x in (self.until, until) if x is not None]
        return self.with_until(min(bounds) if bounds else None)

    def combine_with(self, other: "EventFilter") -> "EventFilter":
        """The union of both; match-all absorbs whatever it is combined with."""
        if self.until != other.until:
            raise ValueError("filters with different bounds do not combine")
        if self.items is None or other.items is None:
            return EventFilter(None, self.until)
        return EventFilter(tuple(dict.fromkeys(self.items + other.items)), self.until)


@dataclass(frozen=True)
class EventQuery:
    """A filter with direction and limit; the limit counts stored events, before upcasting."""

    filter: EventFilter = field(default_factory=EventFilter.match_none)
    direction: Direction = Direction.FORWARD
    limit: Limit = Limit()

    def __post_init__(self):
        if self.filter is None:
            object.__setattr__(self, "filter", EventFilter.match_none())
        if self.direction is None:
            object.__setattr__(self, "direction", Direction.FORWARD)
        if self.limit is None:
            object.__setattr__(self, "limit", Limit())

    @staticmethod
    def match_all() -> "EventQuery":
        return EventQuery(EventFilter.match_all())

    @staticmethod
    def match_none() -> "EventQuery":
        return EventQuery(EventFilter.match_none())

    @staticmethod
    def for_events(types: Iterable[str] = (), tags: Tags | Iterable[str] = ()) -> "EventQuery":
        return EventQuery(EventFilter.for_events(types, tags))

    def backwards(self) -> "EventQuery":
        return dataclasses.replace(self, direction=Direction.BACKWARD)

    def limited(self, limit: int | Limit | None) -> "EventQuery":
        return dataclasses.replace(self, limit=limit if isinstance(limit, Limit) else Limit(limit))

    def until(self, reference: EventReference | None) -> "EventQuery":
        return dataclasses.replace(self, filter=self.filter.with_until(reference))

    def until_if_earlier(self, reference: EventReference | None) -> "EventQuery":
        return dataclasses.replace(self, filter=self.filter.until_if_earlier(reference))

    def combine_with(self, other: "EventQuery") -> "EventQuery":
        if self.direction != other.direction or self.limit != other.limit:
            raise ValueError("queries with different directions or limits do not combine")
        return dataclasses.replace(self, filter=self.filter.combine_with(other.filter))

    def matches(self, event: "Event") -> bool:
        return self.filter.matches(event.type, event.tags, event.reference)


@dataclass(frozen=True)
class AppendCriteria:
    """Append only if no event matches filter after expected (or at all, without one); none(): no condition."""

    filter: EventFilter
    expected: EventReference | None = None

    @staticmethod
    def none() -> "AppendCriteria":
        return AppendCriteria(EventFilter.match_none())

    @staticmethod
    def of(query: EventQuery | EventFilter, expected: EventReference | None) -> "AppendCriteria":
        return AppendCriteria(query.filter if isinstance(query, EventQuery) else query, expected)

    @property
    def is_none(self) -> bool:
        return self.filter.is_match_none


# ---- events and bookmarks --------------------------------------------------------------------


@dataclass(frozen=True)
class EphemeralEvent:
    """An event that is not stored yet."""

    type: str
    data: dict[str, Any]
    tags: Tags = Tags()
    idempotency_key: str | None = None

    def __post_init__(self):
        if not self.type or self.data is None or self.tags is None:
            raise ValueError("type, data and tags are required")

    def with_tags(self, tags: Tags) -> "EphemeralEvent":
        return dataclasses.replace(self, tags=tags)

    def with_idempotency_key(self, key: str | None) -> "EphemeralEvent":
        return dataclasses.replace(self, idempotency_key=key)


@dataclass(frozen=True)
class Event:
    """A stored event as read: type after upcasting, stored_type before."""

    stream: StreamId
    type: str
    stored_type: str
    reference: EventReference
    data: Any
    tags: Tags
    timestamp: datetime | None = None

    def with_tags(self, tags: Tags) -> "Event":
        return dataclasses.replace(self, tags=tags)

    def cast(self) -> "Event":
        return self


@dataclass(frozen=True)
class Bookmark:
    reader: str
    reference: EventReference
    tags: Tags
    updated_at: datetime
