import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillstream.llm import chat, quality
from quillstream.llm._support import table


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def features(text):
    n, chars, symbols, dup, repeat, _ = base(text)
    lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    upper = len(re.findall("[A-Z]", text or ""))
    return [np.log1p(n), np.log1p(chars / max(1, n)), np.sqrt(symbols / max(1, chars)),
            (dup / max(1, lines) + repeat / max(1, n)) / 2, np.sqrt(upper / max(1, chars))]


def mcd_distances(x):
    """The same estimate with numpy, one group."""
    w, least = np.array(quality.BIN_WIDTH), np.array(quality.LEAST_SPREAD)
    bins = np.sort(np.floor(x / w), axis=0)
    at = lambda q: bins[int(np.ceil(len(x) * q)) - 1]
    spread = np.maximum((at(0.75) - at(0.25)) * w / 1.349, least)

    def measure(core, factor):
        m = core.mean(0)
        c = np.cov(core.T, bias=True) * factor + np.diag(least**2 / 4)
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), np.linalg.det(c)

    def step(d2):
        b = np.floor(np.log2(1 + d2) * 64)
        edge = np.sort(b)[int(np.ceil(len(x) * quality.COVERAGE)) - 1]
        return measure(x[b <= edge], quality.CONSISTENCY)

    tries = []
    for q in quality.STARTS:
        d2 = (((x - (at(q) + 0.5) * w) / spread) ** 2).sum(1)
        d2, _ = step(d2)
        d2, det = step(d2)
        tries.append((det, d2))
    d2 = min(tries, key=lambda t: t[0])[1]
    for _ in range(quality.CONCENTRATIONS):
        d2, _ = step(d2)
    return measure(x[d2 <= quality.REWEIGHT], quality.REWEIGHT_CONSISTENCY)[0]


def test_quality_against_python(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("lang = 'en'").withColumn("source", quality.F.lit("one"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    ids = [d for d in texts if base(texts[d])[0] > 0]
    want = dict(zip(ids, mcd_distances(np.array([features(texts[d]) for d in ids])), strict=True))
    for d, text in texts.items():
        r, b = got[d], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == b
        if d in want:
            assert r.distance == pytest.approx(want[d], rel=1e-6, abs=1e-9)
            assert r.kept == (not b[5] and want[d] <= quality.CUTOFF)


def test_quality_keeps_clean_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.judge(table(spark, sf, "documents")).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    rest = rows[~rows.base_failed]
    assert rest[rest.quality == 1].kept.mean() > 0.98 and rest[rest.quality == 0].kept.mean() < 0.1


def test_quality_odd_and_empty(spark, odd_docs, no_docs):
    got = quality.judge(odd_docs).collect()
    texts = [r.text for r in odd_docs.collect()]
    assert sorted(tuple(r)[1:7] for r in got) == sorted(base(t) for t in texts)
    assert quality.judge(no_docs).count() == 0


def test_tables_of_any_size_are_judged(spark, sf):
    docs = table(spark, sf, "documents").where("n_chars > 400")
    for n in (1, 2, 20):
        rows = quality.judge(docs.limit(n)).collect()
        assert len(rows) == n and all(r.distance is not None for r in rows)
    assert quality.judge(docs.limit(1)).first().distance == pytest.approx(0)


def test_two_fifths_of_junk_are_rejected(spark):
    """Documents that pass the base rules, 40 in 100 of them of low quality: the estimate follows the others."""
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").orderBy("doc_id").collect()
    passing = [r for r in rows if not base(r.text)[5]]
    bad = [r for r in passing if r.quality == 0]
    good = [r for r in passing if r.quality == 1][: len(bad) * 3 // 2]
    mixed = spark.createDataFrame([(r.doc_id, r.text, "en", "one") for r in bad + good], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(mixed).collect()}
    assert len(kept) >= quality.SHRINK and 5 * len(bad) >= 2 * len(kept)
    assert sum(kept[r.doc_id] for r in bad) < 0.1 * len(bad) and sum(kept[r.doc_id] for r in good) > 0.95 * len(good)


def test_small_groups_are_judged_by_wider_ones(spark):
    """A lone small source is judged with its whole language, a rare language (or none) with all documents."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    junk = " ".join(f"#$%{i} ABC|{i}" for i in range(60))
    rows = [(-1, junk, "en", "lone"), (-2, junk, "xx", None), (-3, junk, None, None)]
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", quality.F.lit(1)).select(docs.columns))
    got = quality.judge(docs).collect()
    assert all(r.distance is not None for r in got if r.n_words > 0) and len(got) == 203
    assert not any(r.base_failed or r.kept for r in got if r.doc_id < 0)


# ---- chat ------------------------------------------------------------------------------------


def test_tree_paths_ranked(spark):
    rows = [("t", 1, None, "user", "a", 1.0), ("t", 2, 1, "assistant", "b", 5.0), ("t", 3, 1, "assistant", "c", 2.0),
            ("t", 4, 3, "user", "d", 2.0), ("t", 5, 4, "assistant", "e", None), ("u", 1, 99, None, None, 0.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.rank): [t.text for t in r.turns] for r in chat.branches(nodes).collect()}
    assert got == {("t", 1): ["a", "b"], ("t", 2): ["a", "c", "d", "e"], ("u", 1): [""]}
    assert {(r.tree, r.leaf) for r in chat.branches(nodes, best=1).collect()} == {("t", 2), ("u", 1)}


def test_long_chain(spark):
    rows = [("t", i, i - 1 if i else None, "user" if i % 2 else "assistant", f"m{i}", 0.0) for i in range(700)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    (one,) = chat.branches(nodes).collect()
    assert [t.text for t in one.turns] == [f"m{i}" for i in range(700)]
    (made,) = chat.chat(nodes).collect()
    assert "".join(made.text[s.start : s.end] for s in made.loss) == "".join(f"m{i}" for i in range(0, 700, 2))


def expected(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        size = sum(len(t[2]) + sum(t[2].count(x) for x in "<[|") + len(t[3]) + sum(t[3].count(x) for x in "<[") + 8 for t in turns)
        out.append((c, len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learned), sha(learned), size))
    return sorted(out, key=str)


def test_round_trip_of_odd_texts(spark):
    odd = ["</s>", "<\\/s>", "<|user|>x", "[INST]<<SYS>>", "[\\INST]", "\\", "<", "[", "<\\", "|>", "", None, "é\n", "</s>[INST] ok [/INST]", "x" * 50_000]
    rows = [(1, i, ["user", "assistant", None, "a|>b", "<|x[", "\\|"][i % 6], t) for i, t in enumerate(odd)]
    rows += [(1, 3, "assistant", "again"), (1, 3, "assistant", "again"), (None, None, "assistant", "lost"), (2, None, "user", "q"), (2, 0, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in chat.digest(chat.chat(chat.as_chains(df))).collect()), key=str)
    assert got == expected(rows)
    for r in chat.chat(chat.as_chains(df)).collect():
        assert r.text.count("</s>") == r.text.count("<|")
        assert "[INST]" not in r.text and "<|user|>x" not in r.text


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.chat(chat.as_chains(df))).count() == 0
    assert [r.conv_id for r in chat.digest(chat.chat(chat.as_chains(chat.with_probe(spark, df)))).collect()] == [-1]


def test_branching_trees_of_the_whole_table(spark, sf):
    """Every conversation of the table with a second, differently scored reply beside each turn of its assistant."""
    rows = chat.as_chains(table(spark, "/root/testdata/sf0.01", "conversations")).collect()
    nodes, own = [], {}
    for r in rows:
        score = (r.node * 37 + len(r.text)) % 11 / 10
        own.setdefault(r.tree, []).append((r.tree, r.node, r.parent, r.role, r.text, score))
    for tree, chain in own.items():
        nodes += chain
        for _, node, parent, role, text, score in chain:
            if role == "assistant":
                nodes.append((tree, 1000 + node, parent, role, "other " + text, 1.05 - score))
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double").repartition(4)
    children, at = {}, {}
    for n in nodes:
        at[n[0], n[1]] = n
        children.setdefault((n[0], n[2]), []).append(n[1])
    want = {}
    for tree in own:
        leaves = [n[1] for n in nodes if n[0] == tree and (tree, n[1]) not in children]
        paths = []
        for leaf in leaves:
            path, node = [], leaf
            while node is not None:
                path.append(at[tree, node])
                node = at[tree, node][2]
            path.reverse()
            paths.append((-sum(p[5] for p in path) / len(path), leaf, [(p[3], p[4]) for p in path]))
        want[tree] = [(leaf, turns) for _, leaf, turns in sorted(paths, key=lambda p: (round(p[0], 9), p[1]))]
    assert sum(len(w) for w in want.values()) > 1.5 * len(want)
    got = {}
    for r in chat.chat(df).select("tree", "rank", "leaf", chat.parse_turns(chat.F.col("text")).alias("turns")).collect():
        got.setdefault(r.tree, {})[r.rank] = (r.leaf, [(t.role, t.text) for t in r.turns])
    assert {t: [g[k] for k in sorted(g)] for t, g in got.items()} == want
    best = {r.tree: r.leaf for r in chat.chat(df, best=1).collect()}
    assert best == {t: w[0][0] for t, w in want.items()}


def test_a_long_conversation_is_read_back_in_linear_time(spark):
    import time

    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <b>[x] " * 3) for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.groupBy("conv_id").agg(chat.F.array_sort(chat.F.collect_list(chat.F.struct("turn", "role", "text"))).alias("turns"))
    made = turns.select(chat.F.lit("1").alias("tree"), chat.format_turns(chat.F.col("turns")).alias("made")).select("tree", "made.*")
    began = time.perf_counter()
    assert [tuple(r) for r in chat.digest(made).collect()] == expected(rows)
    assert time.perf_counter() - began < 15


def test_sql_equals_the_operator_on_null_turns(spark):
    import duckdb

    rows = [(1, None, "user", "late?"), (1, 0, "assistant", "a"), (2, 1, None, None), (2, None, "assistant", "x<["), (None, 3, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(chat.SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in chat.digest(chat.chat(chat.as_chains(chat.with_probe(spark, df)))).collect()), key=str) == want
