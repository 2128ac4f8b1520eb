import numpy as np
import pytest
import xxhash

from quillstream.llm import _support, simhash
from quillstream.llm._support import table


def brute(rows, shingle=4, distance=4):
    prints = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        count = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            for b in range(64):
                count[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if 2 * count[b] > len(grams)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), f"{p:016x}", str(least.get(root(i)))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_equals_all_pairs(spark, sf, odd_docs):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(odd_docs.select(odd_docs.doc_id + 9000, "text"))
    rows = [(r.doc_id, r.text[:4000] if r.text else r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_odd_and_empty(spark, odd_docs, no_docs):
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("parts,distance", [(3, 4), (4, 3), (5, 4), (4, 12)])
def test_links_lose_no_component(spark, monkeypatch, parts, distance):
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:20].tolist():  # dense balls around some of them
        for _ in range(40):
            for bit in rng.integers(0, 64, rng.integers(0, distance + 2)).tolist():
                b ^= 1 << bit
            prints.add(b)
    signed = np.array(sorted(prints), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x), int(x)) for x in signed], "fp long, first long").repartition(3)
    monkeypatch.setattr(simhash, "TILE_ROWS", 7)
    u = signed.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= distance
    label = np.arange(len(u))
    while True:
        new = np.where(near, label[None, :], len(u)).min(1)
        if (new == label).all():
            break
        label = new
    want = {int(signed[i]): int(signed[np.flatnonzero(label == label[i])].min()) for i in range(len(u))}
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, distance, parts)).collect()}
    assert {f: roots.get(f, f) for f in want} == want


def test_radii_fill_the_budget():
    rng = np.random.default_rng(0)
    values = [rng.integers(0, 16, 50) for _ in range(4)]
    costs = [rng.random((3, 16)).cumsum(0) for _ in range(4)]
    r = simhash.radii(values, costs, 4)
    assert ((r.astype(int) + 1).sum(0) == 5).all()


def test_key_filter_misses_no_key(spark, monkeypatch):
    """Also when it is overfull; unknown and null keys are mostly let go."""
    from pyspark.sql import functions as F

    keys = spark.range(0, 30000, 3).union(spark.createDataFrame([(None,), (-7,)], "id long"))
    rows = spark.range(-10, 30000).union(spark.createDataFrame([(None,)], "id long"))
    for bits in (_support.may_be_in.__globals__["FILTER_BITS"], 1 << 15):
        monkeypatch.setitem(_support.may_be_in.__globals__, "FILTER_BITS", bits)
        out = _support.may_be_in(rows, F.col("id"), _support.key_filter(keys, "id"))
        may = {r.id for r in out.where("__may").collect()}
        real = {-7, *range(0, 30000, 3)}
        assert out.columns == ["id", "__may"] and real <= may and None not in may
        assert len(may) < len(real) + (100 if bits > 1 << 20 else 10000)


def test_more_fingerprints_take_wider_keys():
    chosen = [simhash.partitions_for(n, 4) for n in (1000, 300_000, 10**8, 10**10)]
    assert chosen == sorted(chosen, reverse=True) and chosen[-1] == 3 and chosen[1] >= 4


def test_the_driver_holds_little_of_the_widest_partitions(spark, monkeypatch):
    """22 bits a partition, as from a million fingerprints on, take a few MB of the driver and of the broadcast."""
    import tracemalloc

    from pyspark import cloudpickle

    sent = []
    real = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(len(cloudpickle.dumps(x))) or real(x))
    rng = np.random.default_rng(5)
    prints = rng.integers(-(1 << 62), 1 << 62, 4000)
    df = spark.createDataFrame([(int(x), int(x)) for x in {*prints.tolist(), *(prints[:50] ^ 5).tolist()}], "fp long, first long")
    tracemalloc.start()
    try:
        found = simhash.links(df, 4, 3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent and max(sent) < 8e6 and most < 64e6
    assert {(r.a, r.b) for r in found.collect()} == {(min(x, x ^ 5), max(x, x ^ 5)) for x in prints[:50].tolist()}


@pytest.mark.parametrize("parts,distance", [(3, 4), (4, 12)])
def test_links_by_cells_lose_no_component(spark, monkeypatch, parts, distance):
    monkeypatch.setattr(simhash, "CELL_BITS", 5)
    test_links_lose_no_component(spark, monkeypatch, parts, distance)


def test_cells_summarise_the_counts_of_values(spark, monkeypatch):
    """Cells, occurring values and tiles against plain counts; costs of cells are the means over their values."""
    monkeypatch.setattr(simhash, "CELL_BITS", 6)
    monkeypatch.setattr(simhash, "TILE_ROWS", 3)
    rng = np.random.default_rng(2)
    widths = [9, 6, 17]
    counts = [np.zeros(1 << w, dtype=np.int64) for w in widths]
    for c in counts:
        np.add.at(c, rng.integers(0, len(c), 300) ** 2 // len(c), 1)
    rows = [(g, int(v), int(c[v])) for g, c in enumerate(counts) for v in np.flatnonzero(c)]
    found = simhash.partitions_of(spark.createDataFrame(rows, "part int, value long, n long"), widths)
    for p, c in zip(found, counts, strict=True):
        of = c.reshape(len(p.counts), -1)
        assert len(p.counts) == 64 and (p.counts == of.sum(1)).all()
        assert np.allclose(p.own, (of * of).sum(1) / np.maximum(of.sum(1), 1))
        assert (p.tiles(np.arange(len(c))) == -(-c // 3)).all()
        exact = simhash.within_radius(c.astype(float), p.width, 2).reshape(3, len(p.counts), -1).mean(2)
        assert np.allclose(simhash.within_radius(p.counts, p.width, 2), exact)
