"""Near-duplicates by similarity of shingle sets: SimHash groups first, then an exact set join for the rest.

Two documents are linked when the Jaccard similarity of their sets of word shingles is at least 0.8.
Sixty-four bits cannot tell 0.8 from 0.7, so SimHash alone would both miss and invent links here. It does
the bulk, and whole sets decide every link:
  1. equal sets are one document (its smallest id);
  2. the general pigeonhole of simhash.links groups documents with nearly equal fingerprints, and
     decided() links those of a group whose sets are similar;
  3. a prefix filter finds all other pairs: with shingles in one global order, rare ones first, two sets at
     0.8 share one of their first n // 5 + 1 shingles, and from there on enough are left in both. Documents
     that steps 1 and 2 have joined are not paired again. No pair at 0.8 or above can escape;
  4. sifted() takes apart the groups of candidates: shingles counted in BUCKETS buckets differ by no more
     than the sets do, so pairs whose counts differ by more than sets at 0.8 can are none;
  5. decided() compares the whole sets of each group that is left and links what is similar.
Any fixed order gives the same links; that of the shingles frequent in a sixteenth of the documents, at most
FREQUENT of them, only keeps common passages from making candidates.

A key or group with many members is dealt in tiles, and pairs are compared inside a task; what leaves it is
a spanning forest of links, at most one row a member.

Defined results: a null text is an empty one; all texts without words are equal; a text with fewer words
than a shingle is one shingle; texts of any length are taken whole; a null id keeps its row and links to
nothing; rows that repeat an id stay or go together, and the id is linked as each of its texts is; ties
(equal sets) keep the smallest id; an empty table gives no rows; all columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm._support import key_filter, may_be_in, named, ship, stored, tidy_if_grown
from quillstream.llm.simhash import BITS, TILE_ROWS, components, links, spanning_edges

#: Differing bits of 64 within which SimHash groups documents before their sets are compared.
CLOSE_BITS = 4
#: One document in so many gives the shingles whose frequency orders the rest; at most FREQUENT of them are kept.
SAMPLED, FREQUENT, LEAST_SEEN = 16, 1 << 20, 2
#: Documents and shingles of one tile of a group whose whole sets are compared.
GROUP_ROWS, GROUP_SHINGLES = 2048, 1 << 21
#: Buckets, of a byte each, in which a set's shingles are counted.
BUCKETS = 512
#: Rows of the prefix filter that a task compares at once, and candidate pairs.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 20
#: Shingles whose occurrences are laid out at once when a group's sets are compared.
COLUMNS_AT_ONCE = 4096

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text, from the XXH64 of its words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = len(words)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    total, of = max(1, n - shingle + 1), min(n, shingle)
    h = np.full(total, of, dtype=np.uint64)
    for k in range(of):
        h = mixed(h * _ODD[k % 5] + w[k : k + total])
    return np.unique(h)


def signature(grams: np.ndarray) -> int:
    """64-bit SimHash of a shingle set; of an empty set, zero."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(grams), 1 << 14):
        bits = np.unpackbits(grams[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(grams), bitorder="little").view("<i8")[0])


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that share so many shingles have a similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def prefix_length(n: int) -> int:
    return n // 5 + 1 if n else 0


# ---- the parts of the join -------------------------------------------------------------------


def prints(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc, low, high, size, fp, counts, grams): identity, size, fingerprint and bucket counts of every text's set; grams of the sampled sets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1):
                grams = shingle_set(text.as_py(), shingle)
                whole = xxhash.xxh3_128_intdigest(grams.tobytes())
                low, high = (whole >> k & 0xFFFFFFFFFFFFFFFF for k in (0, 64))
                sampled = low % SAMPLED == 0
                counted = np.minimum(np.bincount((grams >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255)
                made = (low - (1 << 63), high - (1 << 63), len(grams), signature(grams), counted.astype(np.uint8).tobytes())
                for k, x in enumerate((*made, grams.view(np.int64) if sampled else None)):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.int64()))],
                names=["doc", "low", "high", "size", "fp", "counts", "grams"],
            )

    return rows.mapInArrow(run, "doc long, low long, high long, size long, fp long, counts binary, grams array<long>")


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, rank, documents) of the shingles met most in the sampled sets; the more frequent, the higher the rank."""
    seen = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    seen = stored(seen, "frequent-shingles")
    least, room = LEAST_SEEN, FREQUENT
    for row in seen.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():  # a row per frequency
        room -= row["k"]
        if room < 0:
            least = row["n"] + 1
            break
    table = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "g").toArrow()  # at most 16 MB
    g = table.column("g").to_numpy().astype(np.int64).view(np.uint64)
    n = table.column("n").to_numpy().astype(np.int64)
    rank = np.arange(len(g), 0, -1)
    order = np.argsort(g)
    return g[order], rank[order], n[order] * SAMPLED


def in_order(grams: np.ndarray, ranked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, tiles): the prefix of a set in the global order, and in how many tiles each is dealt."""
    g, rank, n = ranked
    length = prefix_length(len(grams))
    if not len(g) or not length:
        return grams[:length], np.ones(length, dtype=np.int64)
    at = np.minimum(np.searchsorted(g, grams), len(g) - 1)
    common = g[at] == grams
    rare = grams[~common][:length]
    if len(rare) == length:
        return rare, np.ones(length, dtype=np.int64)
    at = at[common]
    at = at[np.argsort(rank[at])][: length - len(rare)]
    tiles = np.concatenate([np.ones(len(rare), dtype=np.int64), 1 + n[at] // TILE_ROWS])
    return np.concatenate([rare, g[at]]), tiles


INDEX, ASK = 1, 2


def keyed(texts: DataFrame, shingle: int, ranked) -> DataFrame:
    """(key, doc, off, what) for each shingle of each prefix; texts: (doc, top, text).

    off: top less doc; what: size, position in the order and role, in one number to keep the rows short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranked.value
        for batch in batches:
            doc, top = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            key, own, what = [], [], []
            for row, text in enumerate(batch.column(2)):
                grams = shingle_set(text.as_py(), shingle)
                prefix, tiles = in_order(grams, order)
                if not len(prefix):
                    continue
                place = (len(grams) << 31) + (np.arange(len(prefix)) << 2)
                if tiles.max() == 1:
                    key.append(prefix)
                    what.append(place + (INDEX | ASK))
                else:  # held in one tile, asked in all of the key's tiles
                    at = np.repeat(np.arange(len(prefix)), tiles)
                    tile = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                    mine = tile == (doc[row] * 7919 % tiles)[at]
                    key.append(prefix[at] + tile.astype(np.uint64) * _ODD[1])
                    what.append(place[at] + ASK + mine * INDEX)
                own.append(np.full(len(key[-1]), row))
            if not key:
                continue
            own = np.concatenate(own)
            columns = [np.concatenate(key).view(np.int64), doc[own], (top - doc)[own], np.concatenate(what)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "doc", "off", "what"])

    return texts.mapInArrow(run, "key long, doc long, off long, what long")


def whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive rows, sorted by the first column, cut where that column changes."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        count += batch.num_rows
        if count < least:
            continue
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in rows]
        held, count = [[c[cut:] for c in rows]], count - cut
    if count:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def candidates(dealt: DataFrame) -> DataFrame:
    """(a, b): forests over the pairs that may be similar and that are not under one top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, off, what in whole_keys(batches, ROWS_AT_ONCE):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            number = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(key)]])))
            top = doc + off
            # keys whose documents are all under one top have nothing to ask
            apart = np.minimum.reduceat(top, new) != np.maximum.reduceat(top, new)
            keep = apart[number]
            if not keep.any():
                continue
            number, doc, top, what = number[keep], doc[keep], top[keep], what[keep]
            size, role = what >> 31, what & 3
            left = size - ((what >> 2) & ((1 << 29) - 1))  # shingles from this one on
            order = np.lexsort((size, number))
            number, doc, top, size, left, role = (x[order] for x in (number, doc, top, size, left, role))
            index, ask = np.flatnonzero(role & INDEX), np.flatnonzero(role & ASK)
            # an asking set meets those of its key from four fifths of its size up to its size
            place = (number << 32) + size
            low = np.searchsorted(place[index], (number[ask] << 32) + -(-4 * size[ask] // 5), "left")
            n = np.searchsorted(place[index], place[ask], "right") - low
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
                k = n[at:to]
                a = ask[np.repeat(np.arange(at, to), k)]
                b = index[np.repeat(low[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                may = (top[a] != top[b]) & similar(np.minimum(left[a], left[b]), size[a], size[b])
                if may.any():
                    x, y = spanning_edges(doc[a[may]], doc[b[may]])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                at = to

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many shingles the sets at rows share with those at columns, pair by pair."""
    whose = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(number)[number] > 1
    whose, number = whose[often], number[often]
    number = np.unique(number, return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    whose, number = whose[order], number[order]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)  # counts below 2 ** 24 are exact
    total = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, total, COLUMNS_AT_ONCE):
        i, j = np.searchsorted(number, [at, at + COLUMNS_AT_ONCE])
        laid = np.zeros((len(sets), min(COLUMNS_AT_ONCE, total - at)), dtype=np.float32)
        laid[whose[i:j], number[i:j] - at] = 1
        out += laid[rows] @ laid[columns].T
    return out.astype(np.int64)


def tiled(groups: DataFrame, shingles: bool) -> DataFrame:
    """groups (doc, grp, top, size) that are under several tops, and an array m of the tile pairs i <= j in which each document meets others.

    A group beyond GROUP_ROWS documents (with shingles, also beyond GROUP_SHINGLES of them) is dealt in tiles.
    side: which of the two tiles a document belongs to.
    """
    weight = groups.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("m"), (F.min("top") != F.max("top")).alias("open"))
    tiles = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("m") / GROUP_SHINGLES) if shingles else F.lit(1), F.lit(1)).cast("long")
    wide = groups.join(weight.where("open").select("grp", tiles.alias("tiles")), "grp").withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")))
    meetings = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda u: F.struct(F.least(u, "tile").alias("i"), F.greatest(u, "tile").alias("j"), (F.col("tile") > u).cast("long").alias("side")),
    )
    return wide.select("doc", "grp", "top", "size", meetings.alias("m"))


def met(tiles: DataFrame, payload: str) -> DataFrame:
    """(key, grp, i, j, side, top, doc, size, payload): rows of tiles, one for each tile pair, each pair's rows together."""
    dealt = tiles.select("grp", "top", "doc", "size", payload, F.explode("m").alias("m"))
    dealt = dealt.select(F.xxhash64("grp", "m.i", "m.j").alias("key"), "grp", "m.i", "m.j", "m.side", "top", "doc", "size", payload)
    return dealt.repartition("key").sortWithinPartitions("key", "grp", "i", "j")


class Meeting:
    """The documents of one tile pair, the smaller sets first."""

    def __init__(self, held: list[tuple]):
        held.sort(key=lambda h: h[4])
        (_, i, j), self.payload = held[0][0], [h[5] for h in held]
        side, self.top, self.doc, self.size = (np.array([h[k] for h in held]) for k in (1, 2, 3, 4))
        self.first = np.arange(len(held)) if i == j else np.flatnonzero(side == 0)
        self.second = self.first if i == j else np.flatnonzero(side == 1)

    @property
    def open(self) -> bool:
        return bool(len(self.first) and len(self.second) and (self.top != self.top[0]).any())


def meetings(batches: Iterator[pa.RecordBatch], read) -> Iterator[Meeting]:
    """The meetings of a task, one at a time; read turns a payload into what is kept of it."""
    held: list[tuple] = []
    for batch in batches:
        ids = [batch.column(i).to_pylist() for i in range(8)]
        for row, (_, grp, i, j, side, top, doc, size) in enumerate(zip(*ids, strict=True)):
            if held and held[0][0] != (grp, i, j):
                yield Meeting(held)
                held = []
            held.append(((grp, i, j), side, top, doc, size, read(batch.column(8)[row])))
    if held:
        yield Meeting(held)


def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    x, y = spanning_edges(a, b)
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def sifted(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b): forests over the pairs of each group, under different tops, whose bucket counts let them be similar.

    groups: (doc, grp, top, size); counts: (doc, counts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in meetings(batches, lambda cell: np.frombuffer(cell.as_py(), np.uint8)):
            if not m.open:
                continue
            laid = np.array(m.payload, dtype=np.int16)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for x in m.first:
                # the second's sizes ascend: only those that can be similar to x
                to = m.second[np.searchsorted(m.size[m.second], -(-4 * m.size[x] // 5), "left") : np.searchsorted(m.size[m.second], 5 * m.size[x] // 4, "right")]
                to = to[m.top[to] != m.top[x]]
                if not len(to):
                    continue
                apart = np.abs(laid[to] - laid[x]).sum(axis=1, dtype=np.int64)
                to = to[9 * apart <= m.size[to] + m.size[x]]
                found.append((np.full(len(to), m.doc[x]), m.doc[to]))
            if any(len(f[0]) for f in found):
                yield linked(*(np.concatenate(c) for c in zip(*found, strict=True)))

    own = stored(tiled(groups, False).join(counts, "doc"), "sift")
    return met(own, "counts").mapInArrow(run, "a long, b long").distinct()


def decided(texts: DataFrame, groups: DataFrame, shingle: int) -> DataFrame:
    """(a, b): forests, over tops, of the similar pairs in each group that are under different tops.

    texts: (doc, text); groups: (doc, grp, top, size). Every two tiles of a group meet.
    """
    wide = stored(tiled(groups, True), "groups")
    members = stored(key_filter(wide, "doc"), "group-filter")
    picked = may_be_in(texts, F.col("doc"), members).where("__may").select("doc", "text").join(wide, "doc")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(5)]
            columns = [*batch.columns[:5], pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "grp", "top", "size", "m", "grams"])

    made = picked.select("doc", "grp", "top", "size", "m", "text").mapInArrow(
        sets, "doc long, grp long, top long, size long, m array<struct<i:long,j:long,side:long>>, grams array<long>"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in meetings(batches, lambda cell: cell.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)):
            if m.open:
                size = np.array([len(g) for g in m.payload])  # of the text itself, where an id has several
                near = similar(shared_counts(m.payload, m.first, m.second), size[m.first][:, None], size[m.second][None, :])
                x, y = np.nonzero(near & (m.top[m.first][:, None] != m.top[m.second][None, :]))
                if len(x):
                    yield linked(m.top[m.first[x]], m.top[m.second[y]])

    return met(made, "grams").mapInArrow(compare, "a long, b long").distinct()


# ---- the stage -------------------------------------------------------------------------------


def rooted(df: DataFrame, node: str, top: str, of: DataFrame) -> DataFrame:
    """df with a column top: the root of its column node, or node itself where it has none."""
    of = of.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return df.join(of, F.col(node) == F.col("__node"), "left").withColumn(top, F.coalesce("__root", node)).drop("__node", "__root")


def with_group(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of docs in a component, with its root as grp."""
    both = of.select(F.col("node").alias("doc"), F.col("root").alias("grp")).union(of.select("root", "root").distinct())
    return docs.join(both, "doc")


def near_groups(rows: DataFrame, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(prints, tops): of rows (doc, text) the identity of every set, and (doc, top) of one document per distinct set."""
    spark = rows.sparkSession
    ship(spark)
    found = stored(prints(rows, shingle), "set-prints")
    first = stored(found.groupBy("low", "high", "size").agg(F.min("doc").alias("doc"), F.min("fp").alias("fp"), F.min("counts").alias("counts")), "distinct-sets")
    # SimHash: groups of nearly equal fingerprints, decided by whole sets
    uniq = stored(first.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "set-fingerprints")
    near = components(links(uniq, CLOSE_BITS))
    grouped = rooted(first.select("doc", "size", "fp"), "fp", "grp", near).select("doc", "grp", F.col("doc").alias("top"), "size")
    tidy_if_grown(spark)
    roots = stored(components(decided(rows, grouped, shingle)), "close-roots")
    tidy_if_grown(spark)
    # prefix filter: every other pair that can be similar
    sampled = found.where("grams IS NOT NULL").dropDuplicates(["low", "high", "size"])
    ranked = spark.sparkContext.broadcast(frequent(sampled))
    texts = may_be_in(rows, F.col("doc"), stored(key_filter(first, "doc"), "first-filter")).where("__may").select("doc", "text")
    under = may_be_in(texts, F.col("doc"), stored(key_filter(roots, "node"), "rooted-filter"))
    alone = under.where("NOT __may").select("doc", F.col("doc").alias("top"), "text")
    placed = rooted(under.where("__may").select("doc", "text"), "doc", "top", roots).select("doc", "top", "text")
    paired = components(stored(candidates(keyed(alone.union(placed), shingle, ranked)), "candidates"))
    grouped = stored(rooted(with_group(first.select("doc", "size"), paired), "doc", "top", roots), "candidate-groups")
    tidy_if_grown(spark)
    left = components(stored(sifted(grouped, first.select("doc", "counts")), "sifted"))
    grouped = with_group(grouped.drop("grp"), left)
    tidy_if_grown(spark)
    more = stored(components(decided(rows, grouped, shingle)), "higher-roots")
    tidy_if_grown(spark)
    tops = rooted(rooted(first.select("doc"), "doc", "mid", roots), "mid", "top", more).select("doc", "top")
    return found, stored(tops, "tops")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs without near-duplicates: of each component of similar texts the smallest id stays."""
    number = named(docs, id_col).cast("long")
    rows = docs.where(number.isNotNull()).select(number.alias("doc"), named(docs, text_col).alias("text"))
    found, tops = near_groups(rows, shingle)
    kept = tops.where("top = doc").select("doc")
    gone = stored(found.select("doc").distinct().join(kept, "doc", "left_anti"), "dropped")
    # rows that the filter does not know stay where they lie; only the others are looked up
    own = docs.select(F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("own"), number.alias("__doc"))
    looked = may_be_in(own, F.col("__doc"), stored(key_filter(gone, "doc"), "dropped-filter"))
    back = looked.where("__may").join(gone.withColumnRenamed("doc", "__gone"), F.col("__doc") == F.col("__gone"), "left_anti")
    return looked.where(~F.col("__may")).select("own.*").union(back.select("own.*"))
