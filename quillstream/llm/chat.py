"""Chat formatting over reply trees, with DataFrame functions only.

Messages are nodes of trees. Root-to-leaf paths are enumerated by iterative self-joins that double
their reach: after k rounds every leaf has met its ancestors up to 2 ** k steps away, so a chain of
n replies takes log2(n) rounds. Branches are ranked by score, and each chosen path becomes one
conversation with a loss mask over its assistant texts.

Template: each turn is  <|role|>text</s> . In texts a backslash follows every "<" and every "["
(and every "|" in roles), so that no control string such as </s>, [INST] or <|user|> can occur
inside one; removing those backslashes gives the text back exactly.

Defined results: a null text or role is empty; a null conversation id is a conversation of its own;
rows that repeat a turn follow each other in order of role and text; a null turn comes first; branches that
tie in score rank by leaf; texts and conversations of any length are formatted whole, in time about linear in
their length; an empty table gives no conversations; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm._support import bind, cut_at, prefix_sums, stored

END, OPEN, CLOSE = "</s>", "<|", "|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each leaf to its root, up steps away.

    nodes: (tree, node, parent); a parent that is null or missing marks a root. Nodes on a cycle
    have no leaf below them and are left out.
    """
    ids = nodes.select("tree", "node")
    parents = nodes.where("parent IS NOT NULL").select("tree", "node", "parent")
    jump = stored(
        parents.join(ids.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
        .select("tree", "node", F.col("parent").alias("to")),
        "jump",
    )
    leaves = ids.join(parents.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    met = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    step = 1
    while not jump.isEmpty():
        further = met.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        again = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("then"))
        new = stored(met.unionByName(further), "paths")
        jump = stored(jump.join(again, ["tree", "to"]).select("tree", "node", F.col("then").alias("to")), "jump")
        met, step = new, step * 2
        if step > 1 << 40:
            raise ValueError("the replies have a cycle")
    return met


def branches(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, turns): root-to-leaf paths as arrays of (at, role, text).

    nodes: (tree, node, parent, role, text, score). A branch's score is the mean of its nodes';
    branches are ranked within their tree, ties by leaf; best limits how many are kept.
    """
    path = ancestors(nodes.select("tree", "node", "parent"))
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scores = path.join(said.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    turns = path.join(said.drop("score"), ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns")
    )
    return turns.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])


def format_turns(turns: Column) -> Column:
    """struct(text, loss): the conversation and the code point spans of its assistant texts."""

    def heads(t: Column) -> Column:
        return F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit("|"), F.lit("|\\")), F.lit(CLOSE))

    def laid(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long"))

        def spans(starts: Column) -> Column:
            own = F.transform(
                parts,
                lambda p, i: F.struct(
                    (F.get(starts, i) + F.length(p["head"])).alias("start"),
                    (F.get(starts, i) + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                    p["mask"].alias("mask"),
                ),
            )
            return F.transform(F.filter(own, lambda s: s["mask"]), lambda s: F.struct(s["start"], s["end"]))

        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
        return F.struct(text.alias("text"), bind(prefix_sums(lengths), spans).alias("loss"))

    parts = F.transform(
        turns,
        lambda t: F.struct(heads(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("mask")),
    )
    return bind(parts, laid)


def parse_turns(text: Column) -> Column:
    """array of (role, text): the turns of a formatted conversation."""

    def one(piece: Column) -> Column:
        return bind(
            F.instr(piece, CLOSE),
            lambda at: F.struct(
                unescaped(F.replace(F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), F.lit("|\\"), F.lit("|"))).alias("role"),
                unescaped(F.substring(piece, at + len(CLOSE), F.length(piece))).alias("text"),
            ),
        )

    pieces = F.split(text, END, -1)
    return bind(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), one))


def as_chains(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as trees without branches: each row replies to the one before it."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    node = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return node.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, text, loss): one formatted conversation per chosen branch."""
    made = branches(nodes, best).select("tree", "leaf", "rank", format_turns(F.col("turns")).alias("made"))
    return made.select("tree", "leaf", "rank", "made.text", "made.loss")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, and nothing else than that."""
    turns = parse_turns(F.col("text"))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    learned = F.array_join(F.transform(cut_at(F.col("text"), F.col("loss")), unescaped), "")
    read = formatted.select("tree", "text", F.size(turns).cast("long").alias("n_turns"), joined.alias("joined"), learned.alias("learned"))
    return read.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"),
        "n_turns",
        F.sha2("joined", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations and one of number -1 whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(
        F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("r")
    )
    probe = probe.select(F.lit(-1).cast("long").alias("conv_id"), F.col("r.turn").cast("long").alias("turn"), "r.role", F.lit(text).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS joined,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
    sum(length(role) + length(text) + 8
        + length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), '|', ''))
        + length(text) - length(replace(replace(text, '<', ''), '[', ''))) AS formatted
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(joined) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
FROM g
"""
