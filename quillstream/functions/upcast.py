"""Event types, their history, and reading old events as current ones.

A registry names current types (with payload schemas), interfaces (names for sets of types) and
legacy types with upcasters. Queries are widened on the driver before the scan; stored rows are
then exploded into the events they stand for, numbered by index; the original filter is applied
once more to the types that result.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions.serde import deep_merge, known_fields
from quillstream.model import EventFilter, EventQuery, EventReference, LedgerError, Limit, StreamId
from quillstream.plans import predicates as P
from quillstream.plans.reader import query_log

PARTS = "array<struct<type:string,data:string>>"


class RegistrationError(LedgerError):
    pass


@dataclass(frozen=True)
class Upcaster:
    """targets: types that may result; build: payload JSON -> [(type, payload JSON)], as Columns."""

    targets: tuple[str, ...]
    build: Callable[[Column], list[tuple[str, Column]]]

    def parts(self, data: Column) -> Column:
        made = self.build(data)
        if not made:
            return F.array().cast(PARTS)
        return F.array(*[F.struct(F.lit(t).alias("type"), d.alias("data")) for t, d in made]).cast(PARTS)


@dataclass(frozen=True)
class PythonUpcaster:
    """The same with a Python function from a payload to [(type, payload)], for what Columns cannot say."""

    targets: tuple[str, ...]
    convert: Callable[[dict], list[tuple[str, dict]]]

    def parts(self, data: Column) -> Column:
        convert = self.convert

        def run(texts: pd.Series) -> pd.Series:
            out = []
            for text in texts:
                made = convert(json.loads(text)) if text is not None else []
                out.append([{"type": t, "data": json.dumps(d, separators=(",", ":"), ensure_ascii=False)} for t, d in made])
            return pd.Series(out)

        return F.pandas_udf(run, PARTS)(data)  # null for rows of other types: a UDF sees all rows


def renamed(target: str) -> Upcaster:
    return Upcaster((target,), lambda data: [(target, data)])


def dropped() -> Upcaster:
    return Upcaster((), lambda data: [])


@dataclass
class Registry:
    current: dict[str, T.StructType | None] = field(default_factory=dict)
    interfaces: dict[str, frozenset[str]] = field(default_factory=dict)
    legacy: dict[str, Upcaster | PythonUpcaster] = field(default_factory=dict)

    def _free(self, name: str) -> None:
        if name in self.current or name in self.legacy or name in self.interfaces:
            raise RegistrationError(f"duplicate event type {name}")

    def event(self, name: str, schema: T.StructType | str | None = None) -> "Registry":
        self._free(name)
        self.current[name] = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return self

    def legacy_event(self, name: str, upcaster: Upcaster | PythonUpcaster | None) -> "Registry":
        self._free(name)
        if upcaster is None:
            raise RegistrationError(f"legacy event type {name} has no upcaster")
        self.legacy[name] = upcaster
        return self

    def interface(self, name: str, members: Iterable[str]) -> "Registry":
        self._free(name)
        self.interfaces[name] = frozenset(members)
        return self

    def check(self) -> None:
        for name, upcaster in self.legacy.items():
            if unknown := set(upcaster.targets) - set(self.current):
                raise RegistrationError(f"upcaster of {name} leads to unknown types {sorted(unknown)}")
        for name, members in self.interfaces.items():
            if unknown := members - set(self.current) - set(self.interfaces) - set(self.legacy):
                raise RegistrationError(f"interface {name} has unknown members {sorted(unknown)}")

    @property
    def is_raw(self) -> bool:
        return not self.current and not self.legacy

    def knows(self, name: str) -> bool:
        return name in self.current

    def concrete(self, types: Iterable[str]) -> frozenset[str]:
        """Interfaces replaced by their members, at any depth."""
        out, todo = set(), list(types)
        while todo:
            name = todo.pop()
            if name in self.interfaces:
                todo += self.interfaces[name]
            else:
                out.add(name)
        return frozenset(out)

    def with_legacy(self, types: frozenset[str]) -> frozenset[str]:
        """Also the legacy types that may turn into one of types."""
        return types | {name for name, u in self.legacy.items() if types & set(u.targets)}

    def residual(self, event_filter: EventFilter) -> EventFilter:
        return self._map(event_filter, self.concrete)

    def widened(self, event_filter: EventFilter) -> EventFilter:
        return self._map(event_filter, lambda types: self.with_legacy(self.concrete(types)))

    @staticmethod
    def _map(event_filter: EventFilter, change: Callable) -> EventFilter:
        if event_filter.items is None:
            return event_filter
        return dataclasses.replace(
            event_filter, items=tuple(dataclasses.replace(i, types=change(i.types)) if i.types else i for i in event_filter.items)
        )


def enrich(stored: DataFrame, registry: Registry, merge_erasable: bool = True, keep_vanished: bool = False) -> DataFrame:
    """Stored rows as current events: stored_type, index and data beside the row's own columns.

    With keep_vanished a row that stands for no event stays, with a null index.
    """
    text = deep_merge(F.col("event_data"), F.col("event_erasable_data")) if merge_erasable else F.col("event_data")
    own = F.array(F.struct(F.col("stored_type").alias("type"), F.col("payload").alias("data"))).cast(PARTS)
    parts = own
    for name, upcaster in registry.legacy.items():
        of_type = F.col("stored_type") == name
        parts = F.when(of_type, upcaster.parts(F.when(of_type, F.col("payload")))).otherwise(parts)
    rows = stored.withColumnRenamed("event_type", "stored_type").withColumn("payload", text)
    explode = F.posexplode_outer if keep_vanished else F.posexplode
    exploded = rows.select("*", explode(parts).alias("index", "part")).drop("payload")
    return exploded.withColumns({"event_type": F.col("part.type"), "data": F.col("part.data")}).drop("part")


def checked(events: DataFrame, registry: Registry) -> DataFrame:
    """events, failing on payloads with fields that their type's schema lacks."""
    data = F.col("data")
    for name, schema in registry.current.items():
        if schema is not None:
            data = F.when(F.col("event_type") == name, known_fields(F.col("data"), schema, name)).otherwise(data)
    return events.withColumn("data", data)


def query_events(
    log: DataFrame, query: EventQuery, registry: Registry, stream: StreamId = StreamId.any(), cursor: EventReference | None = None,
    limit: Limit | None = None, hard_limit: int | None = None, merge_erasable: bool = True,
) -> DataFrame:
    """Events of a query in reading order; the limit counts stored rows, so it applies before they are exploded."""
    scan = dataclasses.replace(query, filter=registry.widened(query.filter))
    # Positions are positive; the filter keeps the optimizer from moving payload work below the limit,
    # where it would turn the top-k of each task into a sort of all rows.
    rows = query_log(log, scan, stream, cursor, limit, hard_limit).where("position > 0")
    events = enrich(rows, registry, merge_erasable).where(P.filter_matches(registry.residual(query.filter), index_column="index"))
    return events.orderBy(*P.reading_order(query.direction, index=True))
