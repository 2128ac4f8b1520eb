"""Exact top-k by inner product in three phases with a uniform threshold.

The dimensions are cut into slices; each slice is a list of local scores, and a total is the sum of its local
scores. Vectors are dealt to the nearest of at most PIVOTS sampled pivots and packed into blocks of their
neighbours; a block holds each slice by itself, with its centre and the largest distance from it, which
bounds its local scores: b_j = q_j . centre_j + |q_j| radius_j.
  1. Every task gives each query's k best local scores of each slice, with the totals of those entries, from
     the one of its blocks that promises the query most. The k-th best of these totals is a cutoff that the
     true k-th best cannot fall below.
  2. The cutoff is broadcast. What a block may still have above it is  slack = sum(b_j) - cutoff: below zero, the
     block is left alone; else an entry whose local scores miss their bounds by more than the slack, summed over
     the slices so far, cannot reach the cutoff. Slices are scored one after the other, each only for the
     entries that are left.
  3. The remaining local scores of the collected entries are added, exactly, and the best k stay.

Queries are taken in groups of at most GROUP_QUERIES, so what is broadcast has a fixed bound; each group meets
the bounds of all blocks. An accumulator, where given, counts the local scores that were formed.

Defined results: a vector that is null or holds a null or non-finite component takes no part; a shorter vector
counts as padded with zeros; a repeated id is asked once (its smallest vector) and each of its rows is a
candidate of other queries; ties go to the smaller id, and equal rows of an id are as many candidates; a null id
takes no part; fewer candidates than k are all returned; a score beyond 64 bits is reported as the nearest
long; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm._support import fresh_path, ship, stored

BLOCK_ROWS, PIVOTS = 4096, 1024
GROUP_BLOCKS, QUERY_BLOCK_ROWS = 8, 1024
GROUP_QUERIES = GROUP_BLOCKS * QUERY_BLOCK_ROWS
LONG = 2**63


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector."""
    v = F.col(vec_col)

    def floored(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, floored).alias("v")
    )


def laid_out(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    """A column of arrays as rows of a matrix, short ones padded with zeros."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(lists.offsets.to_numpy())
    m = np.zeros((batch.num_rows, dims))
    m[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat
    return m


def near_pivots(rows: DataFrame, dims: int, n: int) -> DataFrame:
    """rows with pivot, the number of the nearest of about sqrt(n) sampled vectors, and tile, which deals out a frequent one."""
    spark = rows.sparkSession
    wanted = min(PIVOTS, max(1, int(n**0.5)))
    share = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, n)))
    chosen = rows.where(share).select("v").distinct().limit(2 * wanted).toArrow()  # at most 2 * PIVOTS vectors
    pivots = laid_out(chosen.combine_chunks().to_batches()[0], 0, dims) if chosen.num_rows else np.zeros((1, dims))
    pivots = pivots[np.lexsort(pivots.T)]
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        half = (p * p).sum(1) / 2
        for batch in batches:
            if batch.num_rows:
                pivot = (laid_out(batch, 1, dims) @ p.T - half).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=["id", "v", "pivot"])

    placed = stored(rows.mapInArrow(run, "id long, v array<double>, pivot int"), "near-pivots")
    tiles = placed.groupBy("pivot").agg(F.ceil(F.count("*") / (4 * BLOCK_ROWS)).cast("int").alias("tiles"))  # at most 2 * PIVOTS rows
    return placed.join(F.broadcast(tiles), "pivot").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))


BLOCK_SCHEMA = "part int, seq int, ids binary, slices array<binary>, centres array<binary>, radii array<double>"


def packed(rows: DataFrame, dims: int, most: int, cuts: list[int]) -> DataFrame:
    """Blocks of up to most rows, made where the rows lie, of one pivot each where rows have pivots."""
    by_pivot = "pivot" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, data, held, last = TaskContext.get().partitionId(), 0, [], [], 0, None

        def flush() -> pa.RecordBatch:
            m = np.concatenate(data)
            parts = [m[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            centres = [p.mean(0) for p in parts]
            radii = [float(np.sqrt(((p - c) ** 2).sum(1).max())) for p, c in zip(parts, centres, strict=True)]
            cells = [[part], [seq], [np.concatenate(ids).tobytes()], [[p.tobytes() for p in parts]], [[c.tobytes() for c in centres]], [radii]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.float64())]
            names = ["part", "seq", "ids", "slices", "centres", "radii"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            pivot = batch.column(2).to_numpy(zero_copy_only=False) if by_pivot else np.zeros(batch.num_rows)
            m, own = laid_out(batch, 1, dims), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and pivot[a] != last:
                    yield flush()
                    seq, ids, data, held = seq + 1, [], [], 0
                last = pivot[a]
                while a < b:
                    to = min(b, a + most - held)
                    ids.append(own[a:to])
                    data.append(m[a:to])
                    held += to - a
                    a = to
                    if held == most:
                        yield flush()
                        seq, ids, data, held = seq + 1, [], [], 0
        if held:
            yield flush()

    return rows.select("id", "v", *(["pivot"] if by_pivot else [])).mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """One block of candidates: ids, and each slice by itself."""

    def __init__(self, row: dict, exact: bool):
        self.ids = np.frombuffer(row["ids"], np.int64)
        parts = [np.frombuffer(x, np.float64).reshape(len(self.ids), -1) for x in row["slices"]]
        self.parts = parts if exact else [np.frompyfunc(int, 1, 1)(p) for p in parts]  # beyond 2 ** 53: whole Python numbers
        self.centres = [np.frombuffer(x, np.float64) for x in row["centres"]]
        self.radii = row["radii"]

    def bounds(self, queries: "Queries") -> np.ndarray:
        """(slices, queries): no local score of the block is above; room for rounding included."""
        made = []
        for q, norm, c, r in zip(queries.floats, queries.norms, self.centres, self.radii, strict=True):
            made.append(q @ c + norm * r + 1e-9 * (norm * (np.sqrt(c @ c) + r) + 1))
        return np.array(made)


class Queries:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cuts: list[int], exact: bool):
        self.ids = ids
        self.floats = [vectors[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.norms = [np.sqrt((q * q).sum(1)) for q in self.floats]
        self.parts = self.floats if exact else [np.frompyfunc(int, 1, 1)(q) for q in self.floats]


def _best(q: np.ndarray, ids: np.ndarray, total: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best entries, ties to the smaller id."""
    order = np.lexsort((ids, -total, q))
    q, ids, total = q[order], ids[order], total[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    keep = rank < k
    return q[keep], ids[keep], total[keep]


def top_k(
    vectors: DataFrame, asks: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, slices: int = 2,
    counter=None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id meets asks, its k best other rows.

    counter: an accumulator of the local scores formed in all phases.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(whole(vectors, id_col, vec_col, scale), "whole-vectors")
    shape = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    dims, largest = max(1, shape[0] or 0), shape[1] or 0.0
    exact = dims * largest * largest < 2**53
    slices = min(slices, dims)
    cuts = [dims * j // slices for j in range(slices + 1)]
    placed = near_pivots(rows, dims, shape[2]).repartition("pivot", "tile").sortWithinPartitions("pivot", "tile")
    blocks = stored(packed(placed, dims, BLOCK_ROWS, cuts), "vector-blocks")
    asked = rows.where(asks(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    n = asked.count()
    asked = asked.repartition(max(1, -(-n // QUERY_BLOCK_ROWS)), "id")
    query_blocks = stored(packed(asked, dims, QUERY_BLOCK_ROWS, [0, dims]).select("part", "seq", "ids", "slices"), "query-blocks")
    keys = sorted((r["part"], r["seq"]) for r in query_blocks.select("part", "seq").collect())  # a row for 1,024 queries

    def count(formed: int) -> None:
        if counter is not None:
            counter.add(formed)

    def pass_over(group: list[tuple[int, int]]) -> DataFrame:
        names = [f"{p}:{s}" for p, s in group]
        packs = query_blocks.where(F.concat_ws(":", "part", "seq").isin(names)).select("ids", "slices").collect()  # GROUP_QUERIES at most
        q_ids = np.concatenate([np.frombuffer(bytes(r["ids"]), np.int64) for r in packs])
        q_all = np.concatenate([np.frombuffer(bytes(r["slices"][0]), np.float64).reshape(-1, dims) for r in packs])
        shared = spark.sparkContext.broadcast((q_ids, q_all))

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield Block({name: batch.column(name)[row].as_py() for name in batch.schema.names}, exact)

        def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Queries(*shared.value, cuts, exact)
            best, promise = {}, np.full(len(queries.ids), -np.inf)
            kept: dict[int, Block] = {}
            for number, block in enumerate(of_batches(batches)):
                bound = block.bounds(queries).sum(0) if len(block.ids) > k else np.full(len(promise), -np.inf)
                bound = np.where(bound == -np.inf, -1e300, bound)  # a small block is better than none
                own = np.flatnonzero(bound > promise)
                promise[own] = bound[own]
                for q in own.tolist():
                    best[q] = number
                kept[number] = block
                if len(kept) > 64:  # blocks that no query prefers any more are let go
                    wanted = set(best.values())
                    kept = {i: b for i, b in kept.items() if i in wanted}
            of_block: dict[int, list[int]] = {}
            for q, number in best.items():
                of_block.setdefault(number, []).append(q)
            for number, own in of_block.items():
                block, at = kept[number], np.array(own)
                local = [q[at] @ c.T for q, c in zip(queries.parts, block.parts, strict=True)]
                count(len(local) * local[0].size)
                total = reduce(np.add, local)
                same = queries.ids[at][:, None] == block.ids[None, :]
                line = np.arange(len(at))[:, None]
                for p in local:
                    p = np.where(same, -np.inf, p)
                    top = np.argpartition(-p, min(k, p.shape[1] - 1), axis=1)[:, :k]
                    real = p[line, top] > -np.inf
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.broadcast_to(queries.ids[at][:, None], top.shape)[real]),
                            pa.array(np.broadcast_to(block.ids[None, :], p.shape)[line, top][real]),
                            pa.array(total[line, top][real].astype(float)),
                            pa.array(np.broadcast_to(top + (number << 32), top.shape)[real]),
                        ],
                        names=["q", "id", "total", "entry"],
                    )

        # entry and part name a row of a block: equal rows of one id count each, one row in two lists counts once
        lists = blocks.mapInArrow(local_lists, "q long, id long, total double, entry long")
        lists = stored(lists.withColumn("part", F.spark_partition_id()), "local-lists")
        nth = Window.partitionBy("q").orderBy(F.desc("total"))
        seen = lists.dropDuplicates(["q", "part", "entry"]).withColumn("nth", F.row_number().over(nth))
        cutoff = {r["q"]: r["total"] for r in seen.where(F.col("nth") == k).select("q", "total").collect()}  # a row a query
        bounds = spark.sparkContext.broadcast(cutoff)

        def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Queries(*shared.value, cuts, exact)
            floor = np.array([bounds.value.get(i, -np.inf) for i in queries.ids.tolist()])
            if not exact:  # totals above were rounded: leave room
                floor = floor - np.abs(floor) * 1e-9
            kept: list[tuple[np.ndarray, ...]] = []
            held = 0
            for block in of_batches(batches):
                bound = block.bounds(queries)
                with np.errstate(invalid="ignore"):
                    slack = bound.sum(0) - floor + 1e-9 * (np.abs(bound).sum(0) + np.abs(floor) + 1)  # room for rounding
                active = np.flatnonzero(slack >= 0)
                for at in range(0, len(active), 512):
                    who = active[at : at + 512]
                    left = np.arange(len(block.ids))
                    alive = queries.ids[who][:, None] != block.ids[None, :]
                    total = np.zeros(alive.shape) if exact else np.zeros(alive.shape, dtype=object)
                    room = slack[who].copy()[:, None] * np.ones(alive.shape)
                    for j, (q, c) in enumerate(zip(queries.parts, block.parts, strict=True)):
                        local = q[who] @ c[left].T
                        count(local.size)
                        total = total + local
                        room = room - (bound[j][who][:, None] - local).astype(float)  # what may still be missed
                        alive &= room >= 0
                        some = alive.any(axis=0)
                        if not some.any():
                            alive = alive[:, :0]
                            break
                        if not some.all():
                            left, alive, total, room = left[some], alive[:, some], total[:, some], room[:, some]
                    if not alive.size:
                        continue
                    line, col = np.nonzero(alive & (total >= floor[who][:, None]).astype(bool))
                    if len(line):
                        kept.append(_best(who[line], block.ids[left[col]], total[line, col], k))
                        held += len(kept[-1][0])
                if held > 8 * k * max(1, len(queries.ids)):
                    kept = [_best(*(np.concatenate(x) for x in zip(*kept, strict=True)), k)]
                    held = len(kept[0][0])
            if kept:
                line, ids, total = _best(*(np.concatenate(x) for x in zip(*kept, strict=True)), k)
                score = [min(LONG - 1, max(-LONG, int(t))) for t in total]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries.ids[line]), pa.array(ids), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"]
                )

        return blocks.mapInArrow(sufficient, "query_id long, vec_id long, score long")

    passes = []
    for g in range(0, len(keys), GROUP_BLOCKS):
        path = fresh_path(spark, "collected")
        pass_over(keys[g : g + GROUP_BLOCKS]).write.parquet(path)
        passes.append(path)
    if not passes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(*passes)
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
