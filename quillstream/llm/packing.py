"""Packing documents into windows by non-negative least squares.

Documents are tokenized once and kept as packed ids. Whole windows of long documents stand alone;
the lengths of what remains are counted over all documents in bins. Shallow combinations of bins
that fill the window (up to three) form the columns of a matrix, and non-negative least squares
finds how often each combination should be used to meet the histogram; a combination is cut to what the
histogram has of its lengths, and what that leaves is planned again (PLAN_ROUNDS). Each task rounds its share
of these counts, fills windows with its own documents accordingly, and packs the residual greedily:
residual documents, cut where needed, fill the small gaps that binning leaves and then windows of
their own. What is left at the end of a task's chunk is cut into runs of powers of two, which need
no padding.

Defined results: a null text is an empty one, so a document of the end id alone; a text of any length is packed
whole; a null doc_id is kept; repeated rows are packed each, and documents of equal length are taken in the order
in which they lie; an empty table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm._support import named, ship, stored
from quillstream.llm.tokens import crc_of, encoder, load_definition

BIN, PLAN_ROUNDS = 64, 8
#: A task packs chunks of so many ids, so that memory is bounded; only a chunk's last ids lie in short runs.
CHUNK_IDS = 8_000_000

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def combinations(bins: int) -> np.ndarray:
    """Columns: how many documents of each bin (1..bins) a combination of up to three takes; sizes add up to bins."""
    columns = []
    for a in range(1, bins + 1):
        if a == bins:
            columns.append([a])
        for b in range(1, a + 1):
            if a + b == bins:
                columns.append([a, b])
            c = bins - a - b
            if 1 <= c <= b:
                columns.append([a, b, c])
    out = np.zeros((bins, len(columns)))
    for j, sizes in enumerate(columns):
        for s in sizes:
            out[s - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 of least |a x - b|, by active sets: free the variable that would help most, step back
    to the boundary whenever a freed one would turn negative."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        if free.all() or gain.max() <= tolerance:
            break
        free[int(gain.argmax())] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def plan_rates(histogram: dict[int, int], window: int, bin_width: int = BIN) -> list[tuple[tuple[int, ...], float]]:
    """(bins of a combination, times to use it over the whole corpus) from counts of remainders by bin."""
    bins = window // bin_width
    h = np.array([histogram.get(b, 0) for b in range(1, bins + 1)], dtype=float)
    scale = max(1.0, h.max(initial=0))
    a = combinations(bins)
    x, left = np.zeros(a.shape[1]), h.copy()
    for _ in range(PLAN_ROUNDS):
        more = nnls(a, left / scale) * scale
        # least squares may ask for more of a length than there are: each combination is cut to what all its lengths allow
        used = a @ more
        allowed = np.where(used > left, left / np.maximum(used, 1e-300), 1.0)
        more *= np.where(a > 0, allowed[:, None], 1.0).min(axis=0)
        x += more
        left = np.maximum(left - a @ more, 0)
        if more.sum() < 0.5:
            break
    out = []
    for j in np.flatnonzero(x > 1e-9):
        sizes = [b + 1 for b in range(bins) for _ in range(int(a[b, j]))]
        out.append((tuple(sizes), float(x[j])))
    return out


def pack_chunk(
    lengths: list[int], rates: list[tuple[tuple[int, ...], float]], share: float, window: int, bin_width: int = BIN
) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); share: this chunk's part of all documents."""
    sequences: list[list[tuple[int, int, int]]] = []
    stacks: dict[int, list[tuple[int, int, int]]] = {}
    for d, n in enumerate(lengths):
        whole = n // window * window
        sequences += [[(d, s, window)] for s in range(0, whole, window)]
        if n > whole:
            stacks.setdefault(-(-(n - whole) // bin_width), []).append((d, whole, n - whole))
    planned: list[list[tuple[int, int, int]]] = []
    for sizes, times in rates:
        need = {s: sizes.count(s) for s in sizes}
        possible = min(len(stacks.get(s, ())) // k for s, k in need.items())
        for _ in range(min(possible, round(times * share))):
            planned.append([stacks[s].pop() for s in sizes])
    residual = [p for b in sorted(stacks) for p in stacks[b]]  # the shortest go last, whole where they fit
    at = 0
    while at < len(planned):
        gap = window - sum(p[2] for p in planned[at])
        while gap and residual:
            d, s, n = residual.pop()
            take = min(n, gap)
            planned[at].append((d, s, take))
            gap -= take
            if take < n:
                residual.append((d, s + take, n - take))
        if gap and len(planned) > at + 1:
            residual += sorted(planned.pop(), key=lambda p: p[2])
            continue
        at += 1
    if planned and sum(p[2] for p in planned[-1]) < window:
        residual += planned.pop()
    sequences += planned
    current: list[tuple[int, int, int]] = []
    gap = window
    while residual:
        d, s, n = residual.pop()
        take = min(n, gap)
        current.append((d, s, take))
        gap -= take
        if take < n:
            residual.append((d, s + take, n - take))
        if not gap:
            sequences.append(current)
            current, gap = [], window
    left = window - gap
    while left:  # powers of two, the largest first
        run = 1 << (left.bit_length() - 1)
        left -= run
        sequence, rest = [], []
        for d, s, n in current:
            take = min(n, run)
            if take:
                sequence.append((d, s, take))
            if n > take:
                rest.append((d, s + take, n - take))
            run -= take
        sequences.append(sequence)
        current = rest
    return sequences


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): packed ids with the end id, a table in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    definition = spark.sparkContext.broadcast(load_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(definition.value)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            packed = [p + end for p in enc.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // enc.dtype.itemsize for p in packed], pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                names=["doc_id", "n", "ids"],
            )

    rows = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n long, ids binary"), "encoded")


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096, bin_width: int = BIN
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most window ids."""
    spark = docs.sparkSession
    tokens = encoded(docs, tokenizer_path, end_id)
    remainder = F.pmod("n", F.lit(window))
    counted = (
        tokens.groupBy(F.ceil(remainder / bin_width).cast("int").alias("bin")).agg(F.count("*").alias("k")).collect()
    )  # window / bin_width + 1 rows at most
    total = sum(r["k"] for r in counted)
    rates = plan_rates({r["bin"]: r["k"] for r in counted if r["bin"]}, window, bin_width)
    definition = spark.sparkContext.broadcast(load_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dtype = encoder(definition.value).dtype
        sequence = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        lengths: list[int] = []
        packed: list[bytes] = []
        held = 0

        def flush(sequence: int) -> tuple[int, pa.RecordBatch]:
            rows: list[tuple] = []
            for pieces in pack_chunk(lengths, rates, len(lengths) / total, window, bin_width):
                offset = 0
                for d, s, n in pieces:
                    raw = packed[d][s * dtype.itemsize : (s + n) * dtype.itemsize]
                    rows.append((ids[d], s, n, crc_of(raw, dtype), lengths[d], sequence, offset))
                    offset += n
                sequence += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*rows, strict=True))
            return sequence, pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(doc)
                lengths.append(n)
                packed.append(raw)
                held += n
                if held >= CHUNK_IDS:
                    sequence, out = flush(sequence)
                    yield out
                    ids, lengths, packed, held = [], [], [], 0
        if ids:
            yield flush(sequence)[1]

    return tokens.mapInArrow(run, PIECE_SCHEMA)
