import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillstream.llm import packing, tokenfile
from quillstream.llm._support import fresh_path, table
from quillstream.llm.queries import tokenizer_file
from quillstream.llm.tokens import PackedEncoder, load_definition


def expected(rows, end):
    tok = Tokenizer.from_file(tokenizer_file())
    return [(d, tok.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def both(spark, sf, odd_docs):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.union(odd_docs.select(odd_docs.doc_id + 10_000, "text"))


def test_word_memo_equals_whole_texts():
    enc = PackedEncoder(load_definition(tokenizer_file()))
    assert enc.by_word
    assert enc.by_part
    texts = ["Word, word. WORD;:! word#$% |w| a|b ÀÉ, éÀ. İx. ǅz, e\u0301, Σς. don't, 's, ab1, ,, . ªº, ß. ﬁ ½ µ, ÿ!", "It's  a\ttest\r\nΣΑΣ ς é ́x", "\x0b\x0ca\x1cb\x85c  d　e", "<|endoftext|>x <|endoftext|>", "", "a" * 300]
    plain = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        got = [np.frombuffer(p, enc.dtype).tolist() for p in enc.encode(texts)]
        assert got == [e.ids for e in plain]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(5)
    for n, top in [(1, 0), (1, 9), (700, 3), (1000, 5000), (5, 1 << 20)]:
        values = np.cumsum(rng.integers(0, top + 1, n))
        ef = tokenfile.EliasFano.of(values, int(values[-1]))
        assert ef.all().tolist() == values.tolist()
        assert [ef.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        ef.select(5)


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 700))
    ef = tokenfile.EliasFano.of(values, int(values[-1]))
    bits = 8 * (len(ef.lower) + len(ef.upper) + ef.samples.nbytes) / len(values)
    assert bits < 2 + np.log2(700) + 1.2


def test_token_file(spark, both):
    got = tokenfile.token_file(both, tokenizer_file(), 1).toPandas()
    rows = sorted(((r.doc_id, r.text) for r in both.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    before, want = 0, []
    for d, ids in expected(rows, 1):
        want.append((d, before, len(ids), crc(ids)))
        before += len(ids)
    have = [(None if d != d else int(d), s, n, c) for d, s, n, c in got.itertuples(index=False)]
    assert sorted(have, key=lambda r: r[1]) == want


def test_segment_gives_single_documents(spark, sf):
    path = fresh_path(spark, "one")
    docs = table(spark, sf, "documents").limit(20)
    tokenfile.write_token_file(docs, path, tokenizer_file(), 1)
    want = dict(expected([(r.doc_id, r.text) for r in docs.collect()], 1))
    for row in spark.read.parquet(path).collect():
        segment = tokenfile.Segment(bytes(row.payload))
        for i, d in enumerate(segment.doc_id(k) for k in range(len(segment))):
            assert segment.document(i).tolist() == want[d]


def test_empty_tables(spark, no_docs):
    assert tokenfile.token_file(no_docs, tokenizer_file(), 1).count() == 0
    assert packing.pack(no_docs, tokenizer_file(), 2).count() == 0


def check_pieces(pieces, docs, end, window):
    want = {}
    for d, ids in expected(docs, end):
        want.setdefault((d, len(ids)), []).append(ids)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((None if p.doc_id != p.doc_id else p.doc_id, p.doc_tokens), []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for key, ps in by_doc.items():
        copies, ids = len(want[key]), want[key][0]
        covered = np.zeros(len(ids), int)
        for p in ps:
            covered[p.start : p.start + p.length] += 1
            assert p.length > 0
            if copies == 1:
                assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
        assert (covered == copies).all()
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        if at & (at - 1):
            padding += window - at
    return padding


@pytest.mark.parametrize("window", [4096, 256])
def test_packing(both, window):
    pieces = list(packing.pack(both, tokenizer_file(), 2, window=window).toPandas().itertuples())
    rows = [(r.doc_id, r.text) for r in both.collect()]
    assert check_pieces(pieces, rows, 2, window) == 0


def test_nnls_meets_the_conditions_of_an_optimum():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 30)), rng.random(20)
    x = packing.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_combinations_fill_the_window():
    a = packing.combinations(64)
    assert (a.T @ np.arange(1, 65) == 64).all() and a.sum(0).max() == 3
    assert a.shape[1] == 1 + 32 + 341


def test_the_plan_asks_for_no_more_than_there_is():
    rng = np.random.default_rng(8)
    for histogram in ({b: int(n) for b, n in enumerate(rng.integers(0, 400, 64), 1)}, {1: 5000, 2: 10, 60: 3}, {32: 7}, {5: 1}, {}):
        used = np.zeros(65)
        for sizes, times in packing.plan_rates(histogram, 4096):
            assert sum(sizes) == 64 and times > 0
            for s in sizes:
                used[s] += times
        assert all(used[b] <= histogram.get(b, 0) * (1 + 1e-9) + 1e-6 for b in range(1, 65))
    full = {b: 100 for b in range(1, 65)}
    planned = sum(len(sizes) * times for sizes, times in packing.plan_rates(full, 4096))
    assert planned > 0.9 * 6400


def test_doc_ids_of_any_kind_come_back_by_select():
    ids = [None, None, -(2**63), -5, -5, 0, 7, 2**62, 2**63 - 1]
    lengths = np.arange(1, len(ids) + 1)
    packed = [np.full(n, n, dtype="<u2").tobytes() for n in lengths]
    segment = tokenfile.Segment(tokenfile.encode_segment(lengths, packed, 2, ids))
    assert [segment.doc_id(i) for i in range(len(ids))] == ids
    assert [segment.document(i).tolist() for i in range(len(ids))] == [[n] * n for n in lengths.tolist()]
