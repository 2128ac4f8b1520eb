import random

import corpus_pipeline
from quillstream.llm import neardup, packing, pii, puclass, simhash
from quillstream.llm._support import table


def similar(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_representatives_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in neardup.representatives(docs).collect()}
    least = {d: d for d in texts}  # smallest id linked at 0.8 or more, over any number of steps
    near = [(d, e) for d in texts for e in texts if e < d and similar(texts[d], texts[e]) >= 0.8]
    for _ in texts:
        for d, e in near:
            least[d] = least[e] = min(least[d], least[e])
    assert kept == {d for d in texts if least[d] == d}


def test_links_near_the_bound_are_decided_exactly(spark):
    """Chains of texts around 0.8: what the fingerprints cannot tell apart, the shingle sets do."""
    words = [f"w{i}" for i in range(124)]  # 120 shingles
    texts, at = {}, 0
    for changed in range(4, 40):
        low = words[: len(words) - changed] + [f"c{changed}-{i}" for i in range(changed)]
        texts[at], texts[at + 1] = (" ".join(f"{changed}:{w}" for w in t) for t in (words, low))
        at += 2
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in neardup.representatives(df).collect()}
    want = {d for d in texts if d % 2 == 0 or similar(texts[d], texts[d - 1]) < 0.8}
    assert kept == want and any(d % 2 for d in want) and len(want) < len(texts)


def test_planted_copies_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", 9)
    monkeypatch.setattr(neardup, "GROUP_ROWS", 7)
    monkeypatch.setattr(simhash, "TILE_ROWS", 9)
    base = [f"w{i} of {i * 7 % 31} and then" for i in range(80)]
    rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(40)]  # one changed word each
    rows += [(100 + i, f"quite other text number {i} " + " ".join(f"z{i * j}" for j in range(1, 60))) for i in range(20)]
    rows += [(None, "no id"), (None, "no id"), (7, rows[7][1]), (200, ""), (201, None), (300, rows[45][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, doc int")
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in neardup.representatives(df).collect())
    assert kept == [(False, 0)] + [(False, 100 + i) for i in range(20)] + [(False, 200), (True, 0), (True, 0)]


def test_each_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = simhash.stored(stage(spark, docs, sf), "t")
        if name != "pack":
            assert out.columns == docs.columns
            kept[name] = out
        before = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in puclass.classify(docs, table(spark, sf, "labels")).collect()}
            assert {r.doc_id for r in out.collect()} == {d for d, p in scores.items() if p}
        elif name == "pii":
            after = {r.doc_id: r for r in out.collect()}
            assert set(after) == set(before)
            spans = {r.own.doc_id: r.spans for r in pii.extract(docs).collect()}
            for d, r in after.items():
                text = before[d].text
                for s in sorted(spans[d], reverse=True):
                    text = text[: s.start] + f"<{pii.KINDS[s.k].upper()}>" + text[s.end :]
                assert r.text == text
        elif name == "mix":
            assert 0.4 * len(before) < out.count() < len(before)
            assert all(r == before[r.doc_id] for r in out.collect())
        elif name == "pack":
            assert {r.doc_id for r in out.collect()} == set(before)
        docs = out if name != "pack" else docs


def test_run_on_empty_documents(spark, no_docs, monkeypatch):
    real = corpus_pipeline.table
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: no_docs if n == "documents" else real(s, d, n))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 0


def test_odd_documents_go_through(spark, odd_docs, monkeypatch):
    real = corpus_pipeline.table
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: odd_docs if n == "documents" else real(s, d, n))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [c.split()[0] for c in packing.PIECE_SCHEMA.split(", ")] and out.count() >= 0


def test_groups_around_the_bound_are_decided_exactly(spark):
    """Variants of a few texts, each with up to six changed words: trees break, and whole groups meet again."""
    rng = random.Random(3)
    texts, at = {}, 0
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(150)]
        for _ in range(45):
            text = list(base)
            for i in rng.sample(range(150), rng.randint(1, 6)):
                text[i] = f"c{at}-{i}"
            texts[at] = " ".join(text)
            at += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in neardup.representatives(df).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in texts.items())}
    least = {d: d for d in texts}
    near = [(d, e) for d in texts for e in texts if e < d and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])]
    for _ in range(len(texts)):
        before = dict(least)
        for d, e in near:
            least[d] = least[e] = min(least[d], least[e])
        if before == least:
            break
    assert kept == {d for d in texts if least[d] == d} and 4 < len(kept) < 150


def test_every_link_between_random_sets_is_found(spark, monkeypatch):
    """Sets of 1 to 60 shingles around the bound, a passage that all share, small tiles: the same components as all pairs."""
    monkeypatch.setattr(neardup, "TILE_ROWS", 20)
    monkeypatch.setattr(neardup, "GROUP_ROWS", 6)
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    monkeypatch.setattr(neardup, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(neardup, "COLUMNS_AT_ONCE", 7)
    rng = random.Random(11)
    common = [f"all{i}" for i in range(12)]
    texts = {}
    for group in range(25):
        base = [f"g{group}w{i}" for i in range(rng.randint(1, 60))] + common * rng.randint(0, 1)
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 1)] = [f"c{rng.randrange(10**6)}"] * rng.randint(0, 2)
            texts[len(texts)] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in neardup.representatives(docs).collect()}
    sets = {}
    for d, t in texts.items():
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in texts}
    near = [(d, e) for d in texts for e in texts if e < d and (sets[d] == sets[e] or 9 * len(sets[d] & sets[e]) >= 4 * (len(sets[d]) + len(sets[e])))]
    for _ in texts:
        for d, e in near:
            least[d] = least[e] = min(least[d], least[e])
    assert kept == {d for d in texts if least[d] == d} and 25 < len(kept) < 190


def test_recall_on_the_driver_documents(spark):
    """No link at 0.8 or more is lost on sf0.01, held against an inverted index over all shingles."""
    rows = [(r.doc_id, r.text or "") for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        own = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        sets[own] = min(d, sets.get(own, d))
    posting, least = {}, {d: d for d in sets.values()}
    for own, d in sets.items():
        for g in own:
            posting.setdefault(g, []).append((d, own))
    near = {(d, e) for p in posting.values() if len(p) > 1 for d, a in p for e, b in p if e < d and 9 * len(a & b) >= 4 * (len(a) + len(b))}
    for _ in near:
        for d, e in near:
            least[d] = least[e] = min(least[d], least[e])
    kept = {r.doc_id for r in neardup.representatives(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    assert near and kept == {d for d, low in least.items() if d == low}


def test_clashing_and_dotted_columns_pass_every_stage(spark, sf):
    """Columns that are named as internal ones are, and one with a dot, come out as they went in."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(7.0) for c in ("quality_score", "score", "a.b", "own", "doc", "top", "__doc", "__may", "row", "spans", "base", "topic", "tokens", "cell", "__topic")}
    docs = table(spark, sf, "documents").withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = simhash.stored(stage(spark, docs, sf), "t")
        assert docs.columns[-len(extra) :] == list(extra), name
        assert docs.where(" OR ".join(f"`{c}` <> 7 OR `{c}` IS NULL" for c in extra)).count() == 0, name
        assert docs.count() > 20, name


def test_dedup_gives_back_a_grown_heap_between_its_plans(spark, monkeypatch):
    """the driver collects between the plans of the stage as soon as its heap has grown, and only then."""
    from quillstream.llm import _support

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def collected():
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.createDataFrame([(i, f"one two three four five {i % 3}") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(_support, "GROWN", 2.0)
    before = collected()
    _support.tidy_if_grown(spark)
    assert collected() == before
    monkeypatch.setattr(_support, "GROWN", 0.0)
    assert {r.doc_id for r in neardup.representatives(docs).collect()} == {0, 1, 2} and collected() >= before + 4
