"""SimHash near-duplicates by the general pigeonhole principle.

Word shingles give a 64-bit fingerprint; bits that go together are put into one partition; each
fingerprint gets its own per-partition radii from a dynamic program over estimated candidate
counts (the radii plus one sum to distance + 1, so no pair within distance can escape); probes
meet the index on (partition, value), are verified by Hamming distance, and connected components
of the verified links are labelled.

The number of partitions follows from the number of fingerprints (partitions_for). The driver holds and broadcasts of
each partition the radii costs of at most 2 ** CELL_BITS cells of values, one bit for each of at most 2 ** 22 values,
and the values that need several tiles. Counts of single values stay in a table.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link
to each other; a text of any length is taken whole; a null id keeps its row, never names a component unless
nothing else is in it; repeated rows each get a row, and texts that tie in their fingerprint are one node; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm._support import named, ship, stored

BITS = 64
#: Index rows of one (partition, value) that a task may hold; a more frequent value is dealt out in tiles.
TILE_ROWS = 8192
#: Bits of a partition by whose values costs are told apart; values of a wider partition that agree in these share their cell's.
CELL_BITS = 16
#: Candidate pairs compared at a time.
PAIRS_AT_ONCE = 1 << 20
#: What a probe row costs against a comparison, for the dynamic program.
PROBE_COST = 8.0


# ---- fingerprints ----------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned fingerprint: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return digest(b" ".join(words), 42)
    total = n - shingle + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, 1 << 15):
        end = min(total, at + (1 << 15))
        hashes = np.array(
            [digest(b" ".join(words[i : i + shingle]), 42) for i in range(at, end)], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc, fp): one row per row of docs; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["doc", "fp"]
            )

    rows = docs.select(named(docs, id_col).cast("long").alias("doc"), named(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, fp long")


# ---- the plan: partitions and radii ----------------------------------------------------------


def _values(prints: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Each partition's bits of every fingerprint, gathered into a small integer."""
    out = []
    for bits in groups:
        v = np.zeros(len(prints), dtype=np.int64)
        for k, b in enumerate(bits):
            v |= ((prints >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        out.append(v)
    return out


def bit_counts(uniq: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over all distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((BITS, BITS))
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(prints.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float64)
            acc += bits.T @ bits
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int64)), pa.array(acc.ravel()[at].astype(np.int64))], names=["at", "n"]
        )

    counts = np.zeros(BITS * BITS)
    for row in uniq.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]  # at most 4096 rows
    return counts.reshape(BITS, BITS)


def group_bits(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Deal correlated bits into the same partition: start from the most skewed bit, add the bit
    that goes most with those chosen, until the partition has its width."""
    n = max(total, 1)
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(scale, scale))
    left = list(range(BITS))
    groups = []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        chosen = [max(left, key=lambda b: (abs(p[b] - 0.5), -b))]
        left.remove(chosen[0])
        while len(chosen) < width:
            best = max(left, key=lambda b: (corr[b, chosen].mean(), -b))
            chosen.append(best)
            left.remove(best)
        groups.append(sorted(chosen))
    return groups


def value_counts(uniq: DataFrame, groups: list[list[int]]) -> DataFrame:
    """(part, value, n): how many distinct fingerprints have each value of each partition, a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            part, value, n = [], [], []
            for g, v in enumerate(_values(prints, groups)):
                u, c = np.unique(v, return_counts=True)
                part.append(np.full(len(u), g, dtype=np.int32))
                value.append(u)
                n.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (part, value, n)], names=["part", "value", "n"]
            )

    rows = uniq.select("fp").mapInArrow(run, "part int, value long, n long")
    return stored(rows.groupBy("part", "value").agg(F.sum("n").alias("n")), "value-counts")


class Partition:
    """What the driver holds of one partition's values: counts by cell, which values occur, which need several tiles.

    A cell is the values that agree in all but the lowest `fine` bits; up to CELL_BITS bits, a cell is one value.
    """

    def __init__(self, width: int):
        self.width, self.fine = width, max(0, width - CELL_BITS)
        self.counts = np.zeros(1 << (width - self.fine))
        self.own = np.zeros(1 << (width - self.fine))  # fingerprints that share the value of one in the cell, on the mean
        self.occurs = np.zeros(-(-(1 << width) // 8), dtype=np.uint8)
        self.wide, self.dealt = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def tiles(self, values: np.ndarray) -> np.ndarray:
        """In how many tiles each value is dealt; none if no fingerprint has it."""
        out = (self.occurs[values >> 3] >> (values & 7).astype(np.uint8) & 1).astype(np.int64)
        if len(self.wide):
            at = np.minimum(np.searchsorted(self.wide, values), len(self.wide) - 1)
            hit = self.wide[at] == values
            out[hit] = self.dealt[at[hit]]
        return out


def partitions_of(counted: DataFrame, widths: list[int]) -> list[Partition]:
    """The partitions' summaries, aggregated before they come to the driver.

    counted: (part, value, n). Rows sent: a cell each, a bitmap of 32,768 values each, a value of over TILE_ROWS fingerprints each.
    """
    found = [Partition(w) for w in widths]
    fine = F.element_at(F.array(*[F.lit(p.fine) for p in found]), F.col("part") + 1)
    cell = F.floor(F.col("value") / F.pow(F.lit(2), fine)).cast("int")
    cells = counted.groupBy("part", cell.alias("cell")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square")).toArrow()
    part, cell, n, square = (c.to_numpy() for c in cells.columns)
    for g, p in enumerate(found):
        at = cell[part == g]
        p.counts[at] = n[part == g]
        p.own[at] = square[part == g] / n[part == g]
    bits = F.bitmap_construct_agg(F.col("value").bitwiseAND(32767)).alias("bits")
    for row in counted.groupBy("part", F.shiftright("value", 15).alias("at")).agg(bits).collect():
        own = found[row["part"]].occurs
        begin = row["at"] << 12
        own[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)[: len(own) - begin]
    wide = counted.where(F.col("n") > TILE_ROWS).toArrow().sort_by("value")
    part, value, n = (c.to_numpy() for c in wide.columns)
    for g, p in enumerate(found):
        p.wide, p.dealt = value[part == g], (-(-n[part == g] // TILE_ROWS)).astype(np.int32)
    return found


def within_radius(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """Row r: how many fingerprints lie within r flipped bits of each value; with counts of cells, of a value of the cell on the mean."""
    fine = width - (len(counts).bit_length() - 1)
    exact = [counts / 2.0**fine] + [np.zeros_like(counts, dtype=np.float64) for _ in range(most)]
    at = np.arange(len(counts))
    for b in range(-fine, width - fine):  # the lowest bits do not leave the cell
        for r in range(most, 0, -1):
            exact[r] = exact[r] + (exact[r - 1][at ^ (1 << b)] if b >= 0 else exact[r - 1])
    return np.cumsum(exact, axis=0)


def radii(values: list[np.ndarray], costs: list[np.ndarray], distance: int) -> np.ndarray:
    """For each fingerprint the radii (-1: not probed) of least estimated cost whose sum of
    (radius + 1) is distance + 1. values: in each partition its value, or its cell; costs[g][r, value]: cost of radius r in partition g."""
    n, need = len(values[0]), distance + 1
    best = np.full((need + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((len(values), need + 1, n), dtype=np.int8)
    for g, v in enumerate(values):
        most = costs[g].shape[0]
        of = [np.zeros(n)] + [costs[g][r][v] for r in range(most)]
        new = np.full_like(best, np.inf)
        for s in range(need + 1):
            for used in range(min(s, most) + 1):
                c = best[s - used] + of[used]
                better = c < new[s]
                new[s][better] = c[better]
                choice[g, s][better] = used
        best = new
    out = np.zeros((len(values), n), dtype=np.int8)
    s = np.full(n, need)
    rows = np.arange(n)
    for g in range(len(values) - 1, -1, -1):
        used = choice[g][s, rows]
        out[g] = used - 1
        s = s - used
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    masks, layer = [0], {0}
    for _ in range(radius):
        layer = {m | (1 << b) for m in layer for b in range(width) if not m >> b & 1}
        masks += sorted(layer)
    return np.array(masks, dtype=np.int64)


# ---- links -----------------------------------------------------------------------------------


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the links (a, b): (smallest member, member)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def partitions_for(total: int, distance: int) -> int:
    """The number of partitions of least expected cost for so many evenly spread fingerprints: the more there are, the wider the keys."""
    found = {}
    for parts in (3, 4, 5, 6):
        widths = [BITS // parts + (g < BITS % parts) for g in range(parts)]
        most = max(min(distance, 2), -(-(distance + 1) // parts) - 1)
        costs = [np.array([[len(_masks(w, r)) * (PROBE_COST + total / 2**w)] for r in range(most + 1)], dtype=np.float32) for w in widths]
        if (most + 1) * parts >= distance + 1:
            chosen = radii([np.zeros(1, dtype=np.int64)] * parts, costs, distance)[:, 0]
            found[parts] = sum(float(costs[g][r, 0]) for g, r in enumerate(chosen) if r >= 0)
    return min(found, key=lambda parts: (found[parts], parts)) if found else 4


def links(uniq: DataFrame, distance: int, partitions: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within distance.

    partitions: by default as many as their number makes cheapest.

    Every partition's index row and probe rows meet on (partition, value). A value held by more
    than TILE_ROWS fingerprints is dealt to several tiles, and its probes go to each tile.
    """
    spark = uniq.sparkSession
    total = uniq.count()
    partitions = partitions or partitions_for(total, distance)
    groups = group_bits(bit_counts(uniq), total, partitions)
    widths = [len(g) for g in groups]
    if max(widths) > 22:
        raise ValueError("at least 3 partitions are needed: a bit for each value is held on the driver")
    held = partitions_of(value_counts(uniq, groups), widths)
    most = min(distance, 2)
    if (most + 1) * partitions < distance + 1:
        most = -(-(distance + 1) // partitions) - 1
    masks = [[_masks(w, r) for r in range(most + 1)] for w in widths]
    costs = [
        (within_radius(p.counts, p.width, most) + (p.own - p.counts / 2.0**p.fine) + PROBE_COST * np.array([[len(m)] for m in masks[g]])).astype(np.float32)
        for g, p in enumerate(held)
    ]
    for p in held:
        p.counts = p.own = None  # only the costs are asked from here on
    plan = spark.sparkContext.broadcast((groups, costs, held, masks))  # (most + 1) * parts * 2 ** CELL_BITS numbers and the bitmaps

    def keys(g: int, value: np.ndarray, tile: np.ndarray) -> np.ndarray:
        return (np.int64(g) << np.int64(56)) | (value << np.int64(32)) | tile

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, costs, held, masks = plan.value
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            prints = signed.view(np.uint64)
            values = _values(prints, groups)
            chosen = radii([v >> p.fine for v, p in zip(values, held, strict=True)], costs, distance)
            mix = ((prints * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            key, fp, probe = [], [], []
            for g, v in enumerate(values):
                key.append(keys(g, v, mix % held[g].tiles(v)))
                fp.append(signed)
                probe.append(np.zeros(len(v), dtype=bool))
                for r in range(len(masks[g])):
                    own = np.flatnonzero(chosen[g] == r)
                    if not len(own):
                        continue
                    met = (v[own][:, None] ^ masks[g][r][None, :]).ravel()
                    who = np.repeat(signed[own], len(masks[g][r]))
                    k = held[g].tiles(met)
                    met, who, k = met[k > 0], who[k > 0], k[k > 0]
                    tile = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    key.append(keys(g, np.repeat(met, k), tile))
                    fp.append(np.repeat(who, k))
                    probe.append(np.ones(len(tile), dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (key, fp, probe)], names=["key", "fp", "probe"]
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_key, carry_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            probe = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if not len(key):
                continue
            fresh = carry_key == key[0]
            index_key = np.concatenate([carry_key[fresh], key[~probe]])
            index_fp = np.concatenate([carry_fp[fresh], fp[~probe]])
            ask_key, ask_fp = key[probe], fp[probe]
            low = np.searchsorted(index_key, ask_key, "left")
            n = np.searchsorted(index_key, ask_key, "right") - low
            yield from compare(index_fp, ask_fp, low, n)
            last = index_key == key[-1]
            carry_key, carry_fp = index_key[last], index_fp[last]

    def compare(index_fp, ask_fp, low, n) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
            k = n[at:to]
            a = np.repeat(ask_fp[at:to], k)
            b = index_fp[np.repeat(low[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= distance) & (a != b)
            if near.any():
                x, y = spanning_edges(a[near], b[near])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            at = to

    met = uniq.select("fp").mapInArrow(spread, "key long, fp long, probe boolean")
    dealt = met.repartition("key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of node's component; nodes without edges are absent.

    Alternating large-star and small-star steps; every round is a table in the shared folder.
    """
    e = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    while True:
        # done when every node has one edge upwards and none of its ends has one
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("n"), F.lit(0).alias("up")))
        each = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        if not each.agg(F.max((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("low") == 0))).first()[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct(),
            "stars",
        )
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, partitions: int | None = None
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    fingerprint: 16 lowercase hex digits; component_id: the smallest id reachable over links of
    distance or fewer differing bits.
    """
    ship(docs.sparkSession)
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    uniq = stored(prints.groupBy("fp").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    roots = components(links(uniq, distance, partitions))
    placed = stored(
        uniq.join(roots, uniq["fp"] == roots["node"], "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")),
        "placed",
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    of = placed.join(least, "root").select("fp", "component")
    return prints.join(of, "fp").select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
