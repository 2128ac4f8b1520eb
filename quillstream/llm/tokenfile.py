"""Token ids of a corpus as binary segments with Elias-Fano document boundaries.

A token file is a folder that Spark commits (a lost executor never leaves half a file); each row is
one segment: document ids and a payload of bytes laid out as below. Segments follow each other in
ascending document order, so the payloads side by side are one concatenated id array.

Payload, little-endian:
  4s magic "QSEF", u2 version, u2 bytes of an id, u4 documents n, u4 documents without a doc_id (they come first),
  u8 ids u, i8 first doc_id, u8 last doc_id less the first, 8 bytes zero
  boundaries, then doc_ids less the first (of the documents that have one), each an Elias-Fano sequence of n
  numbers up to u with l = max(0, floor(log2(u / n))) low bits:
    samples: u4 position of every SAMPLE-th set bit of the upper part, ceil(n / SAMPLE) of them
    lower part: n numbers of l bits;  upper part: n + (u >> l) + 1 bits
  ids
The boundaries are the running totals of document lengths: about 2 + log2(u / n) bits a document, and so are
the doc_ids; starts and doc_ids are read by select.

Defined results: a null text is an empty one; texts of any length are encoded whole; a null doc_id sorts first
and is kept; rows that repeat a doc_id stand in the order of a hash of their texts, equal texts in any; an
empty table gives no segments; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm._support import fresh_path, named, ship
from quillstream.llm.tokens import crc_of, encoder, load_definition

MAGIC, VERSION, SAMPLE = b"QSEF", 2, 256
HEADER = struct.Struct("<4sHHIIQqQ8x")
#: A segment ends with the document that fills it.
SEGMENT_IDS = 1 << 20
SEGMENT_SCHEMA = "part int, seq int, base long, n_docs int, n_ids long, payload binary"


def _padded(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence of n numbers up to u, with select."""

    def __init__(self, n: int, u: int, low_bits: int, samples: np.ndarray, lower: bytes, upper: bytes):
        self.n, self.u, self.low_bits, self.samples, self.lower, self.upper = n, u, low_bits, samples, lower, upper

    @classmethod
    def of(cls, values: np.ndarray, u: int) -> "EliasFano":
        n = len(values)
        low_bits = cls.low_bits_of(n, u)
        values = values.astype(np.uint64)
        lower = b""
        if low_bits:
            places = np.arange(low_bits, dtype=np.uint64)
            lower = _padded(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel())
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(n + (u >> low_bits) + 1, dtype=np.uint8)
        upper[ones] = 1
        return cls(n, u, low_bits, ones[::SAMPLE].astype("<u4"), lower, _padded(upper))

    @staticmethod
    def low_bits_of(n: int, u: int) -> int:
        return max(0, int(u // n).bit_length() - 1) if n else 0

    @classmethod
    def read(cls, raw: bytes, at: int, n: int, u: int) -> "tuple[EliasFano, int]":
        """The sequence at a place in raw, and where it ends."""
        low_bits = cls.low_bits_of(n, u)
        a, b, c = cls.sizes(n, u, low_bits)
        samples = np.frombuffer(raw, "<u4", a // 4, at)
        return cls(n, u, low_bits, samples, raw[at + a : at + a + b], raw[at + a + b : at + a + b + c]), at + a + b + c

    def tobytes(self) -> bytes:
        return self.samples.tobytes() + self.lower + self.upper

    @staticmethod
    def sizes(n: int, u: int, low_bits: int) -> tuple[int, int, int]:
        """Bytes of samples, lower part and upper part."""
        return 4 * -(-n // SAMPLE), -(-n * low_bits // 8), -(-(n + (u >> low_bits) + 1) // 8)

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.lower[at >> 3 : (at + self.low_bits + 7) >> 3], "little")
        return (word >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample, then by counting set bits; SAMPLE gaps at most."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:
            size = 256
            chunk = np.unpackbits(np.frombuffer(self.upper[at // 8 : at // 8 + size], np.uint8), bitorder="little")
            ones = np.flatnonzero(chunk[at % 8 + 1 :])
            if len(ones) >= left:
                at += int(ones[left - 1]) + 1
                left = 0
            else:
                left -= len(ones)
                at += len(chunk) - at % 8 - 1
        return ((at - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8), bitorder="little")[: self.n * self.low_bits]
        weights = (1 << np.arange(self.low_bits)).astype(np.int64)
        return high + bits.reshape(self.n, self.low_bits).astype(np.int64) @ weights


class Segment:
    """A payload read back: boundaries by select, ids without a copy."""

    def __init__(self, payload: bytes):
        magic, version, width, n, self.nulls, u, self.first, reach = HEADER.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.read(payload, HEADER.size, n, u)
        self.numbers, at = EliasFano.read(payload, at, n - self.nulls, reach)
        self.dtype = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(payload, self.dtype, u, at)

    def __len__(self) -> int:
        return self.ends.n

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.numbers.select(i - self.nulls)


def encode_segment(lengths: np.ndarray, packed: list[bytes], width: int, doc_ids: list[int | None]) -> bytes:
    """doc_ids ascend, nulls first."""
    ends = np.cumsum(lengths)
    u = int(ends[-1]) if len(ends) else 0
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    reach = known[-1] - first if known else 0
    numbers = EliasFano.of(np.array([d - first for d in known], dtype=np.uint64), reach)
    head = HEADER.pack(MAGIC, VERSION, width, len(doc_ids), len(doc_ids) - len(known), u, first, reach)
    return b"".join([head, EliasFano.of(ends, u).tobytes(), numbers.tobytes(), *packed])


def write_token_file(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text, append end_id, and write segments in ascending order of id_col to path.

    One shuffle, by ranges of the id; each task then streams its range.
    """
    spark = docs.sparkSession
    ship(spark)
    definition = spark.sparkContext.broadcast(load_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(definition.value)
        width = enc.dtype.itemsize
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        packed: list[bytes] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cells = [[part], [seq], [base], [len(ids)], [held], [encode_segment(np.array(lengths), packed, width, ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["part", "seq", "base", "n_docs", "n_ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

        for batch in batches:
            for doc, ids_of in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc)
                packed.append(ids_of + end)
                lengths.append(len(packed[-1]) // width)
                held += lengths[-1]
                if held >= SEGMENT_IDS:
                    yield flush()
                    seq, base = seq + 1, base + held
                    ids, packed, lengths, held = [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # deals out the rows of a repeated id
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def read_token_file(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the file alone."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a write task
    before, base_of = 0, {}
    for row in totals:
        base_of[row["part"]] = before
        before += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row["payload"])
                raw = memoryview(segment.ids).cast("B")
                w = segment.dtype.itemsize
                bounds = np.array([segment.start(i) for i in range(len(segment) + 1)])
                crc = [crc_of(raw[s * w : e * w], segment.dtype) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment.doc_id(i) for i in range(len(segment))], pa.int64()),
                        pa.array(bounds[:-1] + base_of[row["part"]] + row["base"]),
                        pa.array(np.diff(bounds)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("part", "base", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write docs as a token file in the shared folder and read it back."""
    path = fresh_path(docs.sparkSession, "token-file")
    write_token_file(docs, path, tokenizer_path, end_id)
    return read_token_file(docs.sparkSession, path)
