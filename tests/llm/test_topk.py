import numpy as np
import pytest

from quillstream.llm import topk
from quillstream.llm._support import table


def brute(rows, k, every=50, scale=256):
    usable = [(i, [int(np.floor(scale * x)) for x in map(float, v)]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        mine = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_equals_brute_force(spark, sf, slices):
    v = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    assert got(topk.top_k(v, lambda i: i % 10 == 0, slices=slices)) == brute(rows, 5, 10)


def test_odd_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(topk, "QUERY_BLOCK_ROWS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3) / 256]) for i in range(60)]
    rows += [(100, None), (101, [None, 1.0, 1.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf")] * 3), (None, [1.0] * 3)]
    rows += [(104, []), (105, [0.5]), (50, rows[50][1]), (7, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    assert got(topk.top_k(df, lambda i: i % 10 == 0)) == brute(rows, 5, 10)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert got(topk.top_k(df, lambda i: i % 50 == 0)) == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_beyond_doubles(spark):
    rows = [(i, [float(2**30 + i), float(2**29 - 7 * i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(topk.top_k(df, lambda i: i % 5 == 0, scale=1)) == brute(rows, 5, 5, 1)


def test_clustered_vectors_are_mostly_not_scored(spark):
    """Well apart clusters: the same rows as brute force from under a tenth of all local scores."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(0, 0.05, 16)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    formed = spark.sparkContext.accumulator(0)
    out = got(topk.top_k(df, lambda i: i % 50 == 0, counter=formed))
    v = np.floor(256 * np.array([r[1] for r in rows]))
    want = []
    for q in range(0, 4000, 50):
        score = v @ v[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(4000), -score))[:5]
        want += [(q, r + 1, int(i), int(score[i])) for r, i in enumerate(order)]
    assert out == sorted(want)
    assert 0 < formed.value < 0.1 * 80 * 4000 * 2


def test_a_frequent_vector_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(x) for x in rng.normal(0, 1, 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert got(topk.top_k(df, lambda i: i % 50 == 0)) == brute(rows, 5)
