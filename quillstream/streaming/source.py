"""Structured Streaming over a store: a source whose offsets are commit versions, and an idempotent sink.

The source reads up to the last of an unbroken sequence of versions, so a commit that comes in late
is never skipped; checkpoints hold versions, so a restart delivers exactly what is new.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillstream import schema as S
from quillstream.sources.commit_log import CommitLog, LocalFiles, files_of
from quillstream.model import LedgerError
from quillstream.sources.store import ARROW_EVENTS, EventLedger
from quillstream.workspace import ship_package

FORMAT = "quillstream"
#: Tasks that read the small files of a batch, rows read at a time, and bytes of a column that are read at a time.
SMALL_FILE_TASKS, ROWS, BUFFER = 64, 5_000, 1 << 18


class Files(InputPartition):
    """Files to read; where only some versions of a rewritten file are asked for, their range."""

    def __init__(self, names: list[str], after: int | None = None, to: int | None = None):
        self.names, self.after, self.to = names, after, to


def _tasks(names: list[str], after: int | None = None, to: int | None = None) -> list[Files]:
    """A task for each file in a folder, which Spark has written; files of single appends share some."""
    folders = [n for n in names if os.path.isdir(n)]
    written = [os.path.join(n, f) for n in folders for f in sorted(os.listdir(n)) if not f.startswith(("_", "."))]
    small = sorted(set(names) - set(folders))
    size = max(1, -(-len(small) // SMALL_FILE_TASKS))
    return [Files([f], after, to) for f in written] + [Files(small[i : i + size], after, to) for i in range(0, len(small), size)]


def _may_have(group: pq.RowGroupMetaData, after: int, to: int) -> bool:
    """Whether a row group can have a version of a range, by its statistics where it has them."""
    for i in range(group.num_columns):
        column = group.column(i)
        if column.path_in_schema == "tx" and column.is_stats_set and column.statistics.has_min_max:
            return column.statistics.max > after and column.statistics.min <= to
    return True


def _runs(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending ranges, those without a gap between them joined."""
    out: list[tuple[int, int]] = []
    for first, last in ranges:
        if out and first == out[-1][1] + 1:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


class LogReader(DataSourceStreamReader):
    """Offsets are versions; a batch takes at most max_commits of them."""

    def __init__(self, base: str, start: int, max_commits: int):
        self.base, self.start, self.max_commits = base, start, max_commits
        self._log: CommitLog | None = None
        self._given = start

    def _commits(self) -> CommitLog:
        if self._log is None:
            self._log = CommitLog(files_of(self.base))
        self._log.refresh()
        return self._log

    def initialOffset(self) -> dict:
        return {"version": self.start}

    def latestOffset(self) -> dict:
        log = self._commits()
        newest = log.refresh()
        if self.max_commits:
            ahead = log.commits(max(self._given, self.start), newest)[: self.max_commits]
            newest = ahead[-1].upto if ahead else max(self._given, self.start)
        self._given = newest
        return {"version": self._given}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        log = self._commits()
        begin = start["version"]
        added = [c for c in log.commits(begin, end["version"]) if not c.replaces]
        kept = [c for c in added if all(log.files.exists(n) for n in c.files)]
        parts = _tasks([log.files.path(n) for c in kept for n in c.files if c.version > begin])
        # of an import that begins earlier, the transactions that are asked for
        for c in kept:
            if c.version <= begin:
                parts += _tasks([log.files.path(n) for n in c.files], begin, c.upto)
        # erasure has put other files in place of these: their rows are read from the present snapshot, version by version
        live = [log.files.path(n) for n in log.live_files()]
        for first, last in _runs([(max(c.version, begin + 1), c.upto) for c in added if c not in kept]):
            parts += _tasks(live, first - 1, last)
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Rows a few thousand at a time, so memory does not grow with the files."""
        for name in partition.names:
            with pq.ParquetFile(name, buffer_size=BUFFER, pre_buffer=False) as file:
                for group in range(file.num_row_groups):
                    if partition.after is not None and not _may_have(file.metadata.row_group(group), partition.after, partition.to):
                        continue
                    for batch in file.iter_batches(ROWS, row_groups=[group], columns=ARROW_EVENTS.names, use_threads=False):
                        if partition.after is not None:
                            tx = batch.column("tx")
                            batch = batch.filter(pc.and_(pc.greater(tx, partition.after), pc.less_equal(tx, partition.to)))
                        if batch.num_rows:  # files that Spark wrote have times in nanoseconds
                            yield from pa.Table.from_batches([batch]).select(ARROW_EVENTS.names).cast(ARROW_EVENTS, safe=False).to_batches()

    def __getstate__(self):
        return {"base": self.base, "start": self.start, "max_commits": self.max_commits, "_log": None, "_given": self._given}


class LogSource(DataSource):
    """spark.readStream.format("quillstream").option("path", folder): rows of the log as they are committed."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return S.EVENTS

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("startversion", 0)), int(self.options.get("maxcommits", 0)))


def read_stream(store: EventLedger, start_version: int = 0, max_commits: int = 0) -> DataFrame:
    """An unbounded DataFrame of a store's log, on a folder that driver and executors share.

    A batch takes at most max_commits commits (0: all). Spark asks Python sources for one offset when a
    trigger takes what is available now, so with a limit such a run ends after one batch; run it again for the next.
    """
    if not isinstance(store.files, LocalFiles):
        # the raw data folder would also give uncommitted files, and rows again after a compaction
        raise LedgerError(f"{store.base} cannot be streamed: its commit entries are out of reach of the source")
    ship_package(store.spark)
    store.spark.dataSource.register(LogSource)
    reader = store.spark.readStream.format(FORMAT).option("path", store.base)
    return reader.option("startversion", str(start_version)).option("maxcommits", str(max_commits)).load()


def project(
    events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], available_now: bool = True, interval: str = "1 second"
):
    """Run a projection as a stream: write gets each batch with its number.

    After a failure Spark repeats the batch of the same number, so write must be idempotent in it
    (see into_table).
    """
    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def into_table(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A batch writer that replaces the batch's own folder, so a repeated batch leaves one copy."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
