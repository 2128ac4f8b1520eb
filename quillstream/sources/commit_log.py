"""An atomic commit log over data files.

A store is a folder: data files that nobody sees by themselves, and numbered commit entries that
name them. An entry is created exclusively, so of two writers of the same version one fails and
tries again; readers see the files named by versions up to the newest, and so never half an append.
The version is the transaction number of its events.

Local folders use O_EXCL; other file systems go through Hadoop's create without overwrite, with the
content written first and renamed into place.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import threading
import time
import uuid
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession


class VersionTaken(Exception):
    """Another writer made this version first."""


class LocalFiles:
    def __init__(self, base: str):
        self.base = base.removeprefix("file://").removeprefix("file:")

    def path(self, name: str) -> str:
        return os.path.join(self.base, name)

    def write(self, name: str, data: bytes, exclusive: bool = False) -> None:
        target = self.path(name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        try:
            if exclusive:
                os.link(part, target)  # atomic, and fails where the target exists
                os.unlink(part)
            else:
                os.replace(part, target)
        except FileExistsError:
            os.unlink(part)
            raise VersionTaken(name) from None

    def read(self, name: str) -> bytes:
        with open(self.path(name), "rb") as file:
            return file.read()

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(self.path(folder)) if not n.endswith(".tmp") and not n.startswith("."))
        except FileNotFoundError:
            return []

    def exists(self, name: str) -> bool:
        return os.path.exists(self.path(name))

    def delete(self, name: str) -> None:
        if os.path.exists(self.path(name)):
            os.unlink(self.path(name))


class HadoopFiles:
    """The same on any file system that Spark can reach. Not usable from executors."""

    def __init__(self, spark: SparkSession, base: str):
        jvm = spark._jvm
        self.base, self._path = base, jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.commons.io.IOUtils

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def write(self, name: str, data: bytes, exclusive: bool = False) -> None:
        from py4j.protocol import Py4JJavaError

        target = self._path(self.path(name))
        part = self._path(self.path(name) + f".{uuid.uuid4().hex}.tmp")
        out = self.fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        if exclusive:
            try:
                taken = self.fs.exists(target) or not self.fs.rename(part, target)
            except Py4JJavaError:
                taken = True
            if taken:
                self.fs.delete(part, False)
                raise VersionTaken(name)
        else:
            self.fs.delete(target, False)
            self.fs.rename(part, target)

    def read(self, name: str) -> bytes:
        source = self.fs.open(self._path(self.path(name)))
        try:
            return bytes(self._utils.toByteArray(source))
        finally:
            source.close()

    def names(self, folder: str) -> list[str]:
        where = self._path(self.path(folder))
        if not self.fs.exists(where):
            return []
        found = (s.getPath().getName() for s in self.fs.listStatus(where))
        return sorted(n for n in found if not n.endswith(".tmp") and not n.startswith("."))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.path(name)), False)


def files_of(base: str, spark: SparkSession | None = None):
    if "://" not in base or base.startswith("file:"):
        return LocalFiles(base)
    if spark is None:
        raise ValueError(f"{base} needs a SparkSession")
    return HadoopFiles(spark, base)


@dataclass(frozen=True)
class Commit:
    """One version. summaries: (event id, type, context, purpose, tags, position) of each event of a small append.

    A commit whose rows bring transaction numbers of their own covers the versions up to reaches,
    the largest of them; 0: its own version only.
    """

    version: int
    files: tuple[str, ...]
    first: int
    last: int
    keys: tuple[str, ...]
    summaries: tuple[tuple, ...]
    replaces: tuple[str, ...] = ()
    reaches: int = 0

    @property
    def upto(self) -> int:
        return max(self.version, self.reaches)

    @property
    def is_bulk(self) -> bool:
        """Whether it added rows that only its files tell about."""
        return bool(self.files) and not self.summaries and not self.replaces

    def to_json(self) -> bytes:
        return json.dumps(self.__dict__).encode()

    @staticmethod
    def from_json(text: bytes) -> "Commit":
        raw: dict[str, Any] = json.loads(text)
        return Commit(
            raw["version"], tuple(raw["files"]), raw["first"], raw["last"], tuple(raw["keys"]),
            tuple(tuple(s) for s in raw["summaries"]), tuple(raw.get("replaces", ())), raw.get("reaches", 0),
        )


class CommitLog:
    """Versions of one store, and what follows from them: the newest version, its files, the last position.

    Entries are immutable and never deleted. Every so many versions their sum is written down as a
    checkpoint, so that opening a store reads that and the entries after it, and memory holds no more
    entries than those. Keys of versions under a checkpoint are marked by a file each, named by the
    key's hash; the markers are written before the checkpoint that counts on them.
    """

    FOLDER, KEYS, CHECKPOINT = "_commits", "_keys", "_checkpoint.json"

    def __init__(self, files, every: int = 100):
        self.files, self.every = files, every
        self._seen: dict[int, Commit] = {}
        self._by_key: dict[str, int] = {}
        self._floor = self._version = self._last = 0
        self._live: dict[str, None] = {}
        self._bulk = False
        self._lock = threading.RLock()
        self._opened = False

    def refresh(self) -> int:
        """Read entries that are new, up to the last of an unbroken sequence; that version is the snapshot."""
        with self._lock:
            if not self._opened:
                self._opened = True
                self._start()
            while self.files.exists(self._name(self._version + 1)):
                self._take(self._read(self._version + 1))
                if len(self._seen) > 2 * self.every:
                    self._forget()
            return self._version

    def _checkpoint(self) -> dict[str, Any] | None:
        """The checkpoint; none where there is none, or it is being replaced: then the entries are read."""
        for _ in range(3):
            if not self.files.exists(self.CHECKPOINT):
                return None
            try:
                return json.loads(self.files.read(self.CHECKPOINT))
            except Exception:  # Hadoop's file systems delete before they rename
                time.sleep(0.05)
        return None

    def _start(self) -> None:
        kept = self._checkpoint()
        if kept:
            self._floor = self._version = kept["version"]
            self._last, self._bulk, self._live = kept["last"], kept["bulk"], dict.fromkeys(kept["live"])

    def _take(self, commit: Commit) -> None:
        self._seen[commit.version] = commit
        for key in commit.keys:
            self._by_key.setdefault(key, commit.version)
        for name in commit.replaces:
            self._live.pop(name, None)
        self._live.update(dict.fromkeys(commit.files))
        self._last, self._bulk = max(self._last, commit.last), self._bulk or commit.is_bulk
        self._version = commit.upto

    def _forget(self) -> None:
        """Drop entries and keys that a checkpoint answers for; one is written where other writers have not."""
        kept = self._checkpoint()
        if not kept or kept["version"] <= self._floor:
            self._write_checkpoint()
            kept = {"version": self._version}
        self._floor = min(kept["version"], self._version)
        self._seen = {v: c for v, c in self._seen.items() if c.upto > self._floor}
        self._by_key = {k: v for k, v in self._by_key.items() if v in self._seen}

    def _write_checkpoint(self) -> None:
        for commit in list(self._seen.values()):
            for key in commit.keys:
                marker = self._marker(key)
                if not self.files.exists(marker):
                    self.files.write(marker, str(commit.version).encode())
        sums = {"version": self._version, "last": self._last, "bulk": self._bulk, "live": list(self._live)}
        self.files.write(self.CHECKPOINT, json.dumps(sums).encode())

    def _marker(self, key: str) -> str:
        digest = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.KEYS}/{digest[:3]}/{digest}"

    def _name(self, version: int) -> str:
        return f"{self.FOLDER}/{version:020d}.json"

    def _read(self, version: int) -> Commit:
        return Commit.from_json(self.files.read(self._name(version)))

    def commits(self, after: int = 0, to: int | None = None) -> list[Commit]:
        """Commits that cover a version after one and begin up to another, in order. Those under the checkpoint are read again."""
        with self._lock:
            to = self._version if to is None else to
            if after >= self._floor:
                return [c for _, c in sorted(self._seen.items()) if c.upto > after and c.version <= to]
            found, version = [], 0 if self.reach(1) > 1 else after
            while version < to:
                commit = self._seen.get(version + 1) or self._read(version + 1)
                if commit.upto > after:
                    found.append(commit)
                version = max(commit.upto, after)
            return found

    def reach(self, version: int) -> int:
        """The last version that a version's commit covers. Only the first can cover more than itself."""
        if version not in self._seen and not self.files.exists(self._name(version)):
            return 0
        return (self._seen.get(version) or self._read(version)).upto

    @property
    def floor(self) -> int:
        """The checkpoint in use: later entries are in memory."""
        return self._floor

    @property
    def has_bulk(self) -> bool:
        """Whether events were imported, whose keys stay in the files."""
        return self._bulk

    def last_position(self) -> int:
        return self._last

    def has_key(self, key: str) -> bool:
        return key in self._by_key or self._floor > 0 and self.files.exists(self._marker(key))

    def live_files(self, to: int | None = None) -> list[str]:
        """Data files of a snapshot: all that were added and not replaced since."""
        with self._lock:
            if to is None or to >= self._version:
                return list(self._live)
            found: dict[str, None] = {}
            for commit in self.commits(0, to):
                for name in commit.replaces:
                    found.pop(name, None)
                found.update(dict.fromkeys(commit.files))
            return list(found)

    def create(self, commit: Commit) -> None:
        """Make a version; the writer of every so many writes a checkpoint."""
        self.files.write(self._name(commit.version), commit.to_json(), exclusive=True)
        with self._lock:
            if self.refresh() - self._floor >= self.every:
                self._forget()


def parquet_bytes(rows: list[dict[str, Any]], schema: pa.Schema) -> bytes:
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), out)
    return out.getvalue()
