"""The ledger: streams with conditional append, queries, lookups, bookmarks and listeners.

Reads are lazy plans over the files of a snapshot. Appends are small files written by the driver
and made visible by one commit entry each; conflicts and idempotency keys of versions that came in
meanwhile are decided from the entries' summaries, without a Spark job.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from enum import Enum
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import schema as S
from quillstream.functions.serde import dump, split_payload
from quillstream.functions.upcast import Registry, checked, enrich, query_events
from quillstream.model import (
    AppendCriteria, Bookmark, Direction, EphemeralEvent, Event, EventFilter, EventQuery, EventReference, LedgerError, Limit,
    OptimisticLockingError, StreamId, Tag, Tags, new_event_id,
)
from quillstream.plans import predicates as P
from quillstream.plans.reader import event_by_id
from quillstream.sources.commit_log import Commit, CommitLog, VersionTaken, files_of, parquet_bytes

ARROW_EVENTS = pa.schema(
    [
        ("position", pa.int64()), ("tx", pa.int64()), ("event_id", pa.string()), ("idempotency_key", pa.string()),
        ("stream_context", pa.string()), ("stream_purpose", pa.string()), ("event_type", pa.string()),
        ("event_timestamp", pa.timestamp("us", tz="UTC")), ("event_data", pa.string()), ("event_erasable_data", pa.string()),
        ("event_tags", pa.list_(pa.string())),
    ]
)


class InitMode(Enum):
    """What opening a store does: nothing, check it, make it where it is missing (default), or make it anew."""

    NONE = "none"
    VALIDATE = "validate"
    ENSURE = "ensure"
    INITIALIZE = "initialize"


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def event_of(row) -> Event:
    """One enriched row as an Event; data is parsed JSON."""
    reference = EventReference(row["event_id"], row["position"], row["tx"], row["index"])
    data = json.loads(row["data"]) if row["data"] is not None else None
    tags = Tags(t for t in map(Tag.parse, row["event_tags"]) if t)
    stream = StreamId(row["stream_context"], row["stream_purpose"])
    return Event(stream, row["event_type"], row["stored_type"], reference, data, tags, row["event_timestamp"])


class EventLedger:
    """A store in a folder; prefix gives tenants folders of their own."""

    BOOKMARKS_KEPT, TAG_INDEX = "_bookmarks.json", "_tag_index.json"

    def __init__(
        self, spark: SparkSession, base: str, prefix: str = "", mode: InitMode = InitMode.ENSURE, hard_limit: int | None = None, strict_bookmarks: bool = False,
    ):
        import re

        if prefix and not (re.fullmatch(r"[a-zA-Z0-9_]+_", prefix) and len(prefix) <= 32):
            raise ValueError(f"a prefix is letters, digits and underscores, ends with one and has at most 32: {prefix!r}")
        self.spark, self.hard_limit, self.strict_bookmarks = spark, hard_limit, strict_bookmarks
        self.base = base.rstrip("/") + (f"/{prefix}" if prefix else "")
        self.files = files_of(self.base, spark)
        if mode is InitMode.INITIALIZE:
            self.drop()
        if mode in (InitMode.INITIALIZE, InitMode.ENSURE) and not self.files.exists("_format.json"):
            self.files.write("_format.json", b'{"version":1}')
        if mode is InitMode.VALIDATE:
            self.validate()
        self.log = CommitLog(self.files)
        self._streams: list[EventStream] = []
        self._pool = ThreadPoolExecutor(max_workers=1, thread_name_prefix="quillstream-listeners")
        self.metrics: Counter = Counter()
        self._own: set[int] = set()
        self._watching: threading.Event | None = None
        self._bookmarks_seen: dict[str, dict[str, Any]] = {}
        self._bookmark_files = 0
        self._bookmark_lock = threading.RLock()

    # ---- administration ----

    def drop(self) -> None:
        local = getattr(self.files, "base", None)
        if hasattr(self.files, "fs"):
            self.files.fs.delete(self.files._path(self.base), True)
        elif local:
            shutil.rmtree(local, ignore_errors=True)

    def validate(self) -> None:
        if not self.files.exists("_format.json"):
            raise S.SchemaError(f"no store at {self.base}")
        log = CommitLog(self.files)
        log.refresh()
        for name in log.live_files():
            S.validate(self.spark.read.parquet(self.files.path(name)), S.EVENTS)

    def watch(self, seconds: float = 1.0) -> None:
        """Tell append listeners of what other processes commit: a thread looks for new versions at this interval.

        Versions that this store wrote itself have been told already and are left out.
        """
        if self._watching:
            return
        self._watching = stop = threading.Event()
        log = CommitLog(self.files)
        told = log.refresh()

        def look() -> None:
            nonlocal told
            while not stop.wait(seconds):
                newest = log.refresh()
                for commit in log.commits(told, newest):
                    if commit.version not in self._own:
                        self._tell(commit)
                told = newest

        threading.Thread(target=look, name="quillstream-watch", daemon=True).start()

    def _tell(self, commit: Commit) -> None:
        for stream in list(self._streams):
            seen = [s for s in commit.summaries if stream.id.can_read(StreamId(s[2], s[3]))]
            if seen:
                reference = EventReference(seen[-1][0], seen[-1][5], commit.version)
                for listener in stream.append_listeners:
                    self._pool.submit(listener, reference)

    def close(self) -> None:
        if self._watching:
            self._watching.set()
        self._pool.shutdown(wait=True)

    # ---- reading ----

    def snapshot(self, version: int | None = None, like: EventFilter | None = None) -> DataFrame:
        """The log up to a version (default: the newest), as a DataFrame over its committed files.

        With a filter, files that the tag index shows to have no match may be left out.
        """
        newest = self.log.refresh()
        names = self.log.live_files(newest if version is None else min(version, newest))
        paths = self._paths(names, like)
        if not paths:
            return self.spark.createDataFrame([], S.EVENTS)
        return self.spark.read.schema(S.EVENTS).parquet(*paths)

    def index_tags(self) -> int:
        """Write which files have which tags, for the files of the newest snapshot, in place of an earlier index; its version.

        The index is a table (tag, file, name) sorted by tag. Files that came later are always read,
        so an old index is slower, never wrong. It serves tags that few files have; compaction, which
        sorts by time, makes them fewer.
        """
        version = self.log.refresh()
        names = self.log.live_files(version)
        folder = f"index/tags-{version}-{uuid.uuid4().hex}"
        path = F.col("_metadata.file_path")
        tags = self.snapshot(version).select(
            F.explode(F.array_distinct("event_tags")).alias("tag"),
            F.regexp_extract(path, ".*/(data/.+)$", 1).alias("file"), F.regexp_extract(path, ".*/(data/[^/]+)", 1).alias("name"),
        )
        tags.distinct().repartitionByRange("tag").sortWithinPartitions("tag").write.parquet(self.files.path(folder))
        self.files.write(self.TAG_INDEX, json.dumps({"version": version, "folder": folder, "names": names}).encode())
        return version

    def _paths(self, names: list[str], like: EventFilter | None) -> list[str]:
        """Where to read: of the files that are indexed, those that have all tags of an item of the filter."""
        everything = [self.files.path(n) for n in names]
        if like is None or not like.items or not all(item.tags for item in like.items) or not self.files.exists(self.TAG_INDEX):
            return everything
        index = json.loads(self.files.read(self.TAG_INDEX))
        covered, live = set(index["names"]), set(names)
        if not covered & live:
            return everything
        sets = [item.tags.texts() for item in like.items]
        has_all = [F.size(F.array_intersect("tags", F.array(*map(F.lit, texts)))) == len(set(texts)) for texts in sets]
        rows = self.spark.read.parquet(self.files.path(index["folder"])).where(F.col("tag").isin(sorted({t for texts in sets for t in texts})))
        found = rows.groupBy("name", "file").agg(F.collect_set("tag").alias("tags")).where(reduce(Column.__or__, has_all))
        hits = [r["file"] for r in found.select("name", "file").collect() if r["name"] in live]  # at most a row a file
        return [self.files.path(n) for n in names if n not in covered] + [self.files.path(f) for f in sorted(hits)]

    def stream(self, stream: StreamId = StreamId.any(), registry: Registry | None = None) -> "EventStream":
        made = EventStream(self, stream, registry or Registry())
        self._streams.append(made)
        return made

    # ---- writing ----

    def append(self, criteria: AppendCriteria, target: StreamId, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Commit rows as one transaction with contiguous positions; nothing where a key is known already.

        The condition holds against the target stream, up to the version that precedes this commit.
        """
        keys = [r["idempotency_key"] for r in rows if r["idempotency_key"]]
        checked_to = None
        while True:
            version = self.log.refresh()
            if any(self.log.has_key(k) for k in keys) or keys and self._imported_key(keys, version):
                return []
            if not criteria.is_none and self._conflicts(criteria, target, checked_to, version):
                raise OptimisticLockingError(criteria.filter, criteria.expected)
            checked_to = version
            now, first = utc_now(), self.log.last_position() + 1
            placed = [r | {"position": first + i, "tx": version + 1, "event_timestamp": now} for i, r in enumerate(rows)]
            name = f"data/{version + 1:020d}-{uuid.uuid4().hex}.parquet"
            self.files.write(name, parquet_bytes(placed, ARROW_EVENTS))
            summaries = tuple(
                (r["event_id"], r["event_type"], r["stream_context"], r["stream_purpose"], tuple(r["event_tags"]), r["position"]) for r in placed
            )
            try:
                self._own.add(version + 1)
                self.log.create(Commit(version + 1, (name,), first, first + len(rows) - 1, tuple(keys), summaries))
                return placed
            except VersionTaken:
                self._own.discard(version + 1)
                self.files.delete(name)
                self.metrics["append.retries"] += 1

    def _imported_key(self, keys: list[str], version: int) -> bool:
        """Whether an imported event has one of the keys: its keys stay in the files, where a pushed filter finds them."""
        if not self.log.has_bulk:
            return False
        return not self.snapshot(version).where(F.col("idempotency_key").isin(keys)).limit(1).isEmpty()

    def _conflicts(self, criteria: AppendCriteria, target: StreamId, checked_to: int | None, version: int) -> bool:
        """Whether an event after the expected reference matches; summaries answer where they reach back far enough."""
        after = criteria.expected
        since = max(0, min(checked_to if checked_to is not None else (after.tx - 1 if after else 0), version))
        commits = self.log.commits(since, version) if since >= self.log.floor else None
        if commits is None or any(c.is_bulk for c in commits):  # beyond the checkpoint, and for imports, the files are asked
            rows = self.snapshot(version, criteria.filter).where(P.in_stream(target)).where(P.filter_matches(criteria.filter))
            return not (rows.where(P.beyond(after, Direction.FORWARD)) if after else rows).limit(1).isEmpty()
        for commit in commits:
            for event_id, event_type, context, purpose, tags, position in commit.summaries:
                reference = EventReference(event_id, position, commit.version)
                if after is not None and not reference.happened_after(after):
                    continue
                if target.can_read(StreamId(context, purpose)) and criteria.filter.matches(
                    event_type, Tags(t for t in map(Tag.parse, tags) if t), reference
                ):
                    return True
        return False

    def import_events(self, events: DataFrame, keep_tx: bool = False, bookmarks: Iterable[Bookmark] = ()) -> int:
        """Bulk load of rows in the log's schema (with positions of their own) as the first commit; the number of rows.

        With keep_tx the rows keep their transaction numbers (from 1), and the next append gets the number after the
        largest. Else all get the number 1, and keep their order by position among themselves. Bookmarks are placed as given.
        """
        if self.log.refresh():
            raise LedgerError("events are imported into an empty store")
        folder = f"data/import-{uuid.uuid4().hex}"
        have = {f.name for f in events.schema}
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EVENTS]
        rows = events.select(*columns)
        (rows if keep_tx else rows.withColumn("tx", F.lit(1).cast("long"))).write.parquet(self.files.path(folder))
        written = self.spark.read.schema(S.EVENTS).parquet(self.files.path(folder))
        n, first, last, low, high = written.agg(F.count("*"), F.min("position"), F.max("position"), F.min("tx"), F.max("tx")).first()
        if n and (low is None or low < 1):
            self._delete(folder)
            raise LedgerError("imported events need transaction numbers from 1")
        self.log.create(Commit(1, (folder,), first or 1, last or 0, (), (), reaches=high or 0))
        for mark in bookmarks:
            self.place_bookmark(mark.reader, mark.reference, mark.tags)
        return n

    def _rewrite(self, kind: str, change: Callable[[DataFrame], DataFrame], least_files: int = 1) -> list[str]:
        """Put changed rows of the whole snapshot in place of its files, as a version of its own; the old names."""
        while True:
            version = self.log.refresh()
            old = self.log.live_files(version)
            if len(old) < least_files:
                return []
            folder = f"data/{kind}-{uuid.uuid4().hex}"
            change(self.snapshot(version)).write.parquet(self.files.path(folder))
            try:
                self.log.create(Commit(version + 1, (folder,), 1, 0, (), (), tuple(old)))
                return old
            except VersionTaken:
                self._delete(folder)

    def _delete(self, name: str) -> None:
        path = self.files.path(name)
        if hasattr(self.files, "fs"):
            self.files.fs.delete(self.files._path(path), True)
        elif os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        else:
            self.files.delete(name)

    def compact(self) -> None:
        """Few files, sorted by (tx, position), in place of many; readers never notice."""
        self._rewrite("compact", lambda df: df.repartitionByRange("tx", "position").sortWithinPartitions("tx", "position"), 2)

    def erase(self, matching, replacement: str | None = None) -> None:
        """Null or replace the erasable data of matching rows, and delete the files that held it."""
        erased = F.when(matching, F.lit(replacement)).otherwise(F.col("event_erasable_data"))
        for name in self._rewrite("erase", lambda df: df.withColumn("event_erasable_data", erased)):
            self._delete(name)

    # ---- bookmarks: a log of small files, newest entry of a reader wins ----

    def _refresh_bookmarks(self) -> int:
        """Read the bookmark entries that are new, each once; the number of entries."""
        with self._bookmark_lock:
            if not self._bookmark_files and self.files.exists(self.BOOKMARKS_KEPT):
                kept = json.loads(self.files.read(self.BOOKMARKS_KEPT))
                self._bookmark_files, self._bookmarks_seen = kept["version"], {e["reader"]: e for e in kept["entries"]}
            while self.files.exists(name := f"bookmarks/{self._bookmark_files + 1:020d}.json"):
                entry = json.loads(self.files.read(name))
                self._bookmarks_seen[entry["reader"]] = entry
                self._bookmark_files += 1
            return self._bookmark_files

    def _keep_bookmarks(self) -> None:
        """Write down the newest entry of each reader, so that opening the store does not read all entries there ever were."""
        with self._bookmark_lock:
            version = self._refresh_bookmarks()
            kept = {"version": version, "entries": list(self._bookmarks_seen.values())}
            self.files.write(self.BOOKMARKS_KEPT, json.dumps(kept).encode())

    def _write_bookmark(self, entry: dict[str, Any]) -> None:
        while True:
            version = self._refresh_bookmarks() + 1
            try:
                self.files.write(f"bookmarks/{version:020d}.json", json.dumps(entry | {"version": version}).encode(), exclusive=True)
            except VersionTaken:
                continue
            if version % self.log.every == 0:
                self._keep_bookmarks()
            return

    def place_bookmark(self, reader: str, reference: EventReference | None, tags: Tags = Tags()) -> None:
        """Upsert; a null reference removes. With strict_bookmarks the reference must lie within the log."""
        if reference is None:
            self.remove_bookmark(reader)
            return
        if self.strict_bookmarks:
            self.log.refresh()
            if reference.position > self.log.last_position():
                raise LedgerError(f"bookmark of {reader} points to position {reference.position}, beyond the log")
        self._write_bookmark(
            {"reader": reader, "id": reference.id, "position": reference.position, "tx": reference.tx, "index": reference.index,
             "tags": tags.texts(), "updated_at": utc_now().isoformat(), "removed": False}
        )
        for stream in list(self._streams):
            for listener in stream.bookmark_listeners:
                self._pool.submit(listener, reader, reference)

    def _bookmark_entries(self) -> dict[str, dict[str, Any]]:
        self._refresh_bookmarks()
        return {k: e for k, e in self._bookmarks_seen.items() if not e["removed"]}

    def bookmarks(self) -> list[Bookmark]:
        return [
            Bookmark(e["reader"], EventReference(e["id"], e["position"], e["tx"], e["index"]), Tags.of(*e["tags"]), datetime.fromisoformat(e["updated_at"]))
            for e in self._bookmark_entries().values()
        ]

    def bookmarks_table(self) -> DataFrame:
        """The same as a DataFrame: newest entry of each reader, removed ones left out."""
        found = [
            (e["reader"], e["position"], e["tx"], e["id"], e["index"], e["tags"], datetime.fromisoformat(e["updated_at"]))
            for e in self._bookmark_entries().values()
        ]
        schema = S.T.StructType([f for f in S.BOOKMARKS if f.name not in ("removed", "version")])
        return self.spark.createDataFrame(found, schema)

    def bookmark(self, reader: str) -> EventReference | None:
        entry = self._bookmark_entries().get(reader)
        return EventReference(entry["id"], entry["position"], entry["tx"], entry["index"]) if entry else None

    def remove_bookmark(self, reader: str) -> EventReference | None:
        before = self.bookmark(reader)
        if before is not None:
            self._write_bookmark({"reader": reader, "removed": True})
        return before


class EventStream:
    """A view of the store: what it reads, where it appends, and which types it knows."""

    def __init__(self, store: EventLedger, stream: StreamId, registry: Registry):
        registry.check()
        self.store, self.id, self.registry = store, stream, registry
        self.consistent_listeners: list[Callable[[list[Event]], None]] = []
        self.append_listeners: list[Callable[[EventReference], Any]] = []
        self.bookmark_listeners: list[Callable[[str, EventReference], None]] = []

    # ---- reading ----

    def events(
        self, query: EventQuery, cursor: EventReference | None = None, limit: Limit | int | None = None, log: DataFrame | None = None
    ) -> DataFrame:
        """Lazy DataFrame of events. The query's own limit holds only without cursor and limit arguments."""
        if limit is None:
            limit = query.limit if cursor is None else Limit.none()
        limit = limit if isinstance(limit, Limit) else Limit(limit)
        self.store.metrics["query"] += 1
        log = self.store.snapshot(like=query.filter) if log is None else log
        return checked(query_events(log, query, self.registry, self.id, cursor, limit, self.store.hard_limit), self.registry)

    def query(self, query: EventQuery, cursor: EventReference | None = None, limit: Limit | int | None = None) -> list[Event]:
        return [event_of(r) for r in self.events(query, cursor, limit).collect()]

    def event_by_id(self, event_id: str) -> list[Event]:
        rows = enrich(event_by_id(self.store.snapshot(), event_id, self.id), self.registry)
        return [event_of(r) for r in checked(rows, self.registry).orderBy("index").collect()]

    # ---- writing ----

    def append(
        self, events: EphemeralEvent | Iterable[EphemeralEvent], criteria: AppendCriteria = AppendCriteria.none(), to: StreamId | None = None
    ) -> list[Event]:
        events = [events] if isinstance(events, EphemeralEvent) else list(events)
        target = to or self.id
        if not self.id.can_append_to(target):
            raise LedgerError(f"stream {self.id} does not append to {target}")
        if not target.is_specific:
            raise LedgerError(f"stream {target} is not specific")
        for e in events:
            if not self.registry.knows(e.type):
                raise LedgerError(f"event type {e.type} is not known to stream {self.id}")
        if not events:
            return []
        if len(events) > 1 and any(e.idempotency_key for e in events):
            raise LedgerError("an idempotency key needs an append of a single event")
        if not criteria.is_none:  # legacy rows that would become a watched type conflict as well
            criteria = AppendCriteria(self.registry.widened(criteria.filter), criteria.expected)
        rows = []
        for e in events:
            data, erasable_data = split_payload(json.loads(dump(e.data)), self.registry.current.get(e.type))
            rows.append(
                {"event_id": new_event_id(), "idempotency_key": e.idempotency_key, "stream_context": target.context, "stream_purpose": target.purpose,
                 "event_type": e.type, "event_data": data, "event_erasable_data": erasable_data, "event_tags": e.tags.texts()}
            )
        began = time.perf_counter()
        try:
            placed = self.store.append(criteria, target, rows)
        except OptimisticLockingError:
            self.store.metrics["append.conflicts"] += 1
            raise
        self.store.metrics["append.seconds"] += time.perf_counter() - began
        self.store.metrics["append.events"] += len(placed)
        for r in placed:
            self.store.metrics[f"append.type.{r['event_type']}"] += 1
        made = [
            Event(target, r["event_type"], r["event_type"], EventReference(r["event_id"], r["position"], r["tx"]), e.data, e.tags, r["event_timestamp"])
            for r, e in zip(placed, events, strict=False)
        ]
        if made:
            self.store.metrics["position"] = made[-1].reference.position
            for listener in self.consistent_listeners:
                listener(made)
            for stream in list(self.store._streams):
                if stream.id.can_read(target):
                    for listener in stream.append_listeners:
                        self.store._pool.submit(listener, made[-1].reference)
        return made

    # ---- listeners and bookmarks ----

    def on_append(self, listener: Callable[[list[Event]], None]) -> None:
        """Called in the appender's thread, for appends through this very stream."""
        self.consistent_listeners.append(listener)

    def on_append_eventually(self, listener: Callable[[EventReference], Any]) -> None:
        """Called later, in another thread, for appends to any stream that this one reads; merged while it is busy."""
        self.append_listeners.append(Coalescing(listener))

    def on_bookmark(self, listener: Callable[[str, EventReference], None]) -> None:
        self.bookmark_listeners.append(listener)

    def place_bookmark(self, reader: str, reference: EventReference | None, tags: Tags = Tags()) -> None:
        self.store.place_bookmark(reader, reference, tags)

    def bookmark(self, reader: str) -> EventReference | None:
        return self.store.bookmark(reader)

    def remove_bookmark(self, reader: str) -> EventReference | None:
        return self.store.remove_bookmark(reader)


class Coalescing:
    """Skips references that are already covered: a listener that returns how far it got is not called again for less."""

    def __init__(self, listener: Callable[[EventReference], Any]):
        self.listener, self.reached = listener, None

    def __call__(self, reference: EventReference) -> None:
        if self.reached is not None and not reference.happened_after(self.reached):
            return
        got = self.listener(reference)
        self.reached = max(reference, got) if isinstance(got, EventReference) else reference
