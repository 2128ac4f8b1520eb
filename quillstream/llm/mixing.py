"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token weights of the cells (source, language, topic) are raked to target shares of each margin in
turn until all margins agree, with a warning where they do not within SWEEPS; a cell's calibrated
probability is proportional to its raked weight over its tokens, on the largest scale at which none
exceeds one, so that the kept tokens meet all targets in expectation (or on a scale that keeps a share
of all tokens, at which rare cells are kept whole); a document is kept when a uniform number drawn from
its id lies below its cell's probability.

Targets are given proportions of values (TARGETS, or the caller's). A value without one is to have its own
share of tokens, tempered by a power (POWERS); the given proportions divide the rest. So new sources and
stray languages need no entry and take nothing from the others.

The tables have no topic. It is found in the text: words are hashed into TERMS buckets, a document is the
square roots of its buckets' shares less the mean of its language, and TOPIC_ROUNDS rounds of k-means over
all documents give TOPICS centres. Centres start where one bucket stands out, in the buckets that vary most.

Documents are summed into cells before any shuffle, so one hot source is a few partial sums. All sweeps and
the scale are one expression over one row that holds the cells. Beyond CELLS_AT_ONCE cells, the same sweeps
run as joins over the table of cells instead.

Defined results: null source, language or topic is a value of its own; a null or blank text has no
tokens, lies where all shares are zero, and is kept with its cell's probability, or with probability 0 where
its whole cell has no tokens; texts of any length are counted whole; equal distances take the first centre; a
null doc_id draws like an empty id; rows that repeat an id are kept or dropped together if their cells agree;
an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import warnings
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm._support import PLAN_CHARS, bind, named, setting, stored, tidy_if_grown

MARGINS = ("source", "lang", "topic")
#: Proportions of values that the query and the pipeline ask for.
TARGETS = {"lang": {"en": 0.58, "fr": 0.16, "de": 0.15, "es": 0.11}}
#: Values without a target: their share of tokens to this power, normalised over the margin.
POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.95}
#: Share of all tokens that the query and the pipeline keep. Without it the scarcest cell, however small, sets what all others keep.
KEPT = 0.65
SWEEPS, TOLERANCE, SEED = 200, 1e-4, "mix-1"
#: Cells that are fitted in one row; more are fitted as a table.
CELLS_AT_ONCE = 20_000
#: Halvings of the interval in which the scale lies.
HALVINGS = 60
TERMS, TOPICS, TOPIC_ROUNDS = 16, 6, 5
SPACE = r"[\x20\x09-\x0D]+"
#: One letter for each bucket.
LETTERS = "ABCDEFGHIJKLMNOP"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def token_count(text: Column) -> Column:
    """Words of the whole text, the measure of weight."""
    return F.size(_words(text)).cast("long")


def bucket_letters(text: Column) -> Column:
    """One letter per word of the whole text: the bucket of its hash."""
    return F.array_join(F.transform(_words(text), lambda w: F.substring(F.lit(LETTERS), F.pmod(F.xxhash64(w), F.lit(TERMS)).cast("int") + 1, F.lit(1))), "")


# ---- topics ----------------------------------------------------------------------------------


def measures(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, tokens and t0.. (square roots of the buckets' shares), one row per row of docs."""
    made = docs.select(*keep, bucket_letters(named(docs, "text")).alias("__letters"))
    n = F.length("__letters")
    of = [F.sqrt((n - F.length(F.replace("__letters", F.lit(x)))) / F.greatest(n, F.lit(1))).cast("float").alias(f"__t{k}") for k, x in enumerate(LETTERS)]
    return made.select("*", n.cast("long").alias("__tokens"), *of).drop("__letters")


class Topics:
    """Means of the languages (a table) and the centres of the topics."""

    def __init__(self, means: DataFrame, centres: list[list[float]]):
        self.means, self.centres = means, centres

    def of(self, measured: DataFrame) -> DataFrame:
        """measured with a column topic in place of the buckets."""
        at = placed_at(measured.join(self.means, F.col("__lang").eqNullSafe(F.col("__of_lang")), "left"))
        return at.withColumn("__topic", nearest(self.centres)).drop("__of_lang", *[f"__p{k}" for k in range(TERMS)])


def placed_at(rows: DataFrame) -> DataFrame:
    """rows with their places __p0.. in place of buckets and means; columns of their own, so that plans of many distances stay short."""
    gone = [f"__{x}{k}" for x in "tm" for k in range(TERMS)]
    places = [(F.col(f"__t{k}").cast("double") - F.coalesce(F.col(f"__m{k}"), F.lit(0.0))).alias(f"__p{k}") for k in range(TERMS)]
    return rows.select("*", *places).drop(*gone)


def nearest(centres: list[list[float]]) -> Column:
    """Name of the nearest centre, each distance named once."""
    distances = [reduce(lambda a, b: a + b, [F.col(f"__p{k}") * (-2 * c[k]) for k in range(TERMS)], F.lit(sum(x * x for x in c))) for c in centres]
    found = [F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distances)]
    return F.concat(F.lit("topic"), (F.least(*found) if len(found) > 1 else found[0])["i"])


def topics(measured: DataFrame) -> Topics:
    """Topics of a stored table of measures with a column __lang; every round is one aggregation over all its rows."""
    lengths = [F.avg(f"__t{k}").alias(f"__m{k}") for k in range(TERMS)]
    means = stored(measured.where("__tokens > 0").groupBy(F.col("__lang").alias("__of_lang")).agg(*lengths), "language-means")
    placed = placed_at(measured.where("__tokens > 0").join(means, F.col("__lang").eqNullSafe(F.col("__of_lang"))))
    spread = placed.agg(*[F.stddev_pop(f"__p{k}").alias(f"s{k}") for k in range(TERMS)]).first()
    if spread[0] is None:
        return Topics(means, [[0.0] * TERMS])
    widest = sorted(range(TERMS), key=lambda k: (-spread[k], k))[:TOPICS]
    centres = [[spread[k] if k == w else 0.0 for k in range(TERMS)] for w in widest]
    for _ in range(TOPIC_ROUNDS):
        tidy_if_grown(placed.sparkSession)
        own = placed.withColumn("topic", nearest(centres)).groupBy("topic").agg(*[F.avg(f"__p{k}").alias(f"c{k}") for k in range(TERMS)])
        with setting(placed.sparkSession, spark_sql_maxPlanStringLength=PLAN_CHARS):
            moved = {r["topic"]: [float(r[f"c{k}"]) for k in range(TERMS)] for r in own.collect()}  # at most TOPICS rows
        centres = [moved.get(f"topic{i}", c) for i, c in enumerate(centres)]
    return Topics(means, centres)


# ---- fitting in one row ----------------------------------------------------------------------


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _key(of: Column) -> Column:
    """A text for a margin's value; null is apart from all others."""
    return F.coalesce(F.concat(F.lit("="), of), F.lit(""))


def numbered(cells: DataFrame) -> DataFrame:
    """(i, source, lang, topic, cell, tokens): the cells in one order, margins as texts."""
    one = F.struct(*[_key(F.col(m)).alias(m) for m in MARGINS], _cell().alias("cell"), F.col("tokens").cast("double").alias("tokens"))
    return cells.agg(F.array_sort(F.collect_list(one)).alias("c")).select(F.posexplode("c").alias("i", "c")).select("i", "c.*")


def margin_values(cells: DataFrame, m: str, power: float, given: dict[str, float]) -> DataFrame:
    """One row: margin and its values, each the numbers of its cells and its target, in the order of their first cell."""
    everything = Window.partitionBy(F.lit(1))  # over at most CELLS_AT_ONCE values
    asked = F.create_map(*[F.lit(x) for v, share in given.items() for x in ("=" + v, float(share))])[F.col(m)] if given else F.lit(None).cast("double")
    values = cells.groupBy(m).agg(F.sum("tokens").alias("n"), F.sort_array(F.collect_list("i")).alias("at"))
    values = values.withColumn("raw", F.pow(F.col("n") / F.sum("n").over(everything), F.lit(power))).withColumn("asked", asked)
    values = values.withColumn("raw", F.col("raw") / F.sum("raw").over(everything))
    own = F.sum(F.when(F.col("asked").isNull(), F.col("raw"))).over(everything)
    values = values.withColumn("each", (1 - F.coalesce(own, F.lit(0.0))) / F.sum("asked").over(everything))
    one = F.struct(F.get("at", F.lit(0)).alias("first"), "at", F.coalesce(F.col("asked") * F.col("each"), F.col("raw")).alias("to"))
    return values.agg(F.array_sort(F.collect_list(one)).alias("values")).select(F.lit(m).alias("margin"), "values")


def fitted(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict[str, float]], kept: float | None) -> DataFrame:
    """One row: gap, the largest distance of a factor from one in the last sweep, and an array of (cell, weight, probability).

    cells: margins and tokens (> 0).
    """
    own = stored(numbered(cells), "numbered-cells")
    parts = [margin_values(own, m, powers[m], targets.get(m, {})).withColumn("cells", F.lit(None).cast("array<struct<i:int,cell:string,tokens:double>>")) for m in MARGINS]
    every = own.agg(F.array_sort(F.collect_list(F.struct("i", "cell", "tokens"))).alias("cells"))
    parts.append(every.select(F.lit("").alias("margin"), F.lit(None).cast(parts[0].schema["values"].dataType).alias("values"), "cells"))
    pick = lambda c, m: F.first(F.when(F.col("margin") == m, F.col(c)), ignorenulls=True)
    row = reduce(DataFrame.unionByName, parts).agg(pick("cells", "").alias("cells"), *[pick("values", m).alias(f"v_{m}") for m in MARGINS])
    out = [F.col("cells"), _sum(F.transform("cells", lambda c: c["tokens"])).alias("total")]
    for m in MARGINS:
        placed = F.flatten(F.transform(f"v_{m}", lambda s, v: F.transform(s["at"], lambda i: F.struct(i.alias("i"), v.alias("v")))))
        out += [
            F.transform(f"v_{m}", lambda s: s["at"]).alias(f"in_{m}"),
            F.transform(f"v_{m}", lambda s: s["to"]).alias(f"to_{m}"),
            F.transform(F.array_sort(placed), lambda p: p["v"]).alias(f"at_{m}"),
        ]
    row = stored(row.select(*out), "cells-in-a-row")
    raked_row = stored(raked(row), "raked-row")
    tidy_if_grown(cells.sparkSession)
    return scaled_fit(raked_row, kept)


def raked(row: DataFrame) -> DataFrame:
    """(cells, total, w, gap): weights after all sweeps."""

    def fit_margin(m: str, state: Column) -> Column:
        """state (w, gap) after one margin is met."""
        factors = bind(_margin_sums(state["w"], F.col(f"in_{m}")), lambda have: F.zip_with(f"to_{m}", have, lambda t, h: F.when(h > 0, t / h).otherwise(1.0)))

        def scaled(f: Column) -> Column:
            away = F.aggregate(f, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x - 1)))
            w = F.zip_with(state["w"], F.col(f"at_{m}"), lambda x, k: x * F.get(f, k))
            return F.struct(w.alias("w"), F.greatest(state["gap"], away).alias("gap"))

        return bind(factors, scaled)

    def sweep(state: Column) -> Column:
        now = bind(F.struct(state["w"].alias("w"), F.lit(0.0).alias("gap")), partial(fit_margin, MARGINS[0]))
        for m in MARGINS[1:]:
            now = bind(now, partial(fit_margin, m))
        return now

    shares = F.transform("cells", lambda c: c["tokens"] / F.col("total"))
    begin = F.struct(shares.alias("w"), F.lit(float("inf")).alias("gap"))
    step = lambda s, _: F.when(s["gap"] <= TOLERANCE, s).otherwise(sweep(s))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(SWEEPS)), begin, step)
    return row.select("cells", "total", state.alias("s")).select("cells", "total", "s.w", "s.gap")


def scaled_fit(row: DataFrame, kept: float | None) -> DataFrame:
    """(gap, fit): probabilities on the largest scale, or on the one that keeps a share of all tokens."""
    row = row.withColumn("rate", F.zip_with("w", "cells", lambda w, c: w / c["tokens"]))
    if kept is None:
        scale = 1 / F.array_max("rate")
    else:

        def keeps(c: Column) -> Column:
            return _sum(F.zip_with("rate", "cells", lambda r, x: x["tokens"] * F.least(F.lit(1.0), r * c)))

        def halved(b: Column) -> Column:
            return bind(
                F.sqrt(b["low"] * b["high"]),
                lambda mid: F.when(keeps(mid) < F.lit(kept) * F.col("total"), F.struct(mid.alias("low"), b["high"].alias("high")))
                .otherwise(F.struct(b["low"].alias("low"), mid.alias("high"))),
            )

        positive = F.filter("rate", lambda r: r > 0)
        bounds = F.struct((F.lit(kept) / F.array_max("rate") / 2).alias("low"), (1 / F.array_min(positive)).alias("high"))
        scale = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), bounds, lambda b, _: halved(b))["high"]
    out = F.zip_with(
        "w", "cells",
        lambda w, c: F.struct(c["cell"].alias("cell"), w.alias("weight"), F.least(F.lit(1.0), w / c["tokens"] * F.col("scale")).alias("probability")),
    )
    return row.withColumn("scale", scale).select("gap", out.alias("fit"))


def _margin_sums(w: Column, members: Column) -> Column:
    return F.transform(members, lambda at: F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(w, i)))


def _warn(gap: float) -> None:
    if gap > TOLERANCE:
        warnings.warn(f"raking has not met all margins after {SWEEPS} sweeps: a factor was still {gap:.2g} from one", stacklevel=3)


# ---- fitting as a table ----------------------------------------------------------------------


def wanted(cells: DataFrame, margin: str, power: float, given: dict[str, float]) -> DataFrame:
    """(margin, target): given shares, and a power of their own shares for the other values; normalised."""
    total = cells.agg(F.sum("tokens")).first()[0]
    asked = F.create_map(*[F.lit(x) for v, s in given.items() for x in (v, float(s))])[F.col(margin)] if given else F.lit(None).cast("double")
    share = cells.groupBy(margin).agg((F.sum("tokens") / total).alias("n")).withColumn("asked", asked).withColumn("raw", F.pow("n", F.lit(power)))
    everything, own, given_total = share.agg(F.sum("raw"), F.sum(F.when(F.col("asked").isNull(), F.col("raw"))), F.sum("asked")).first()
    each = (1 - (own or 0.0) / everything) / given_total if given_total else 0.0
    return share.select(margin, F.coalesce(F.col("asked") * each, F.col("raw") / everything).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with a column weight whose sums over each margin's values are its target shares of one.

    cells: margins and tokens (> 0); targets[margin]: (margin, target) over the values that occur.
    Each sweep fits the margins in turn and is a table in the shared folder.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for _ in range(sweeps):
        worst = []
        for k, (margin, target) in enumerate(targets.items()):
            have = now.groupBy(F.col(margin).alias("of")).agg(F.sum("weight").alias("have"))
            factor = have.join(target, F.col("of").eqNullSafe(F.col(margin))).select("of", F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(1.0).alias(f"by{k}"))
            now = now.join(factor, F.col(margin).eqNullSafe(F.col("of"))).withColumn("weight", F.col("weight") * F.col(f"by{k}")).drop("of")
            worst.append(F.max(F.abs(F.col(f"by{k}") - 1)).alias(f"by{k}"))
        now = stored(now, "raked")
        gap = now.agg(*worst).first()
        now = now.drop(*[f"by{k}" for k in range(len(targets))])
        if max(gap) <= tolerance:
            break
    else:
        _warn(max(gap))
    return now


def probabilities(raked: DataFrame, kept: float | None) -> DataFrame:
    """raked with a column probability: min(1, c * weight / tokens).

    Without kept, c is the largest at which the bound of one is idle. With it, c is such that this
    share of all tokens stays; the sum is monotone in c, and two rounds over 64 values of c place it.
    """
    rate = F.col("weight") / F.col("tokens")
    total, least, most = raked.agg(F.sum("tokens"), F.min(rate), F.max(rate)).first()
    if kept is None:
        return raked.withColumn("probability", F.least(F.lit(1.0), rate / most))
    low, high = kept / most / 2, 1 / max(least, 1e-300)
    for _ in range(2):
        grid = [low * (high / low) ** (i / 63) for i in range(64)]
        sums = raked.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), rate * c)).alias(f"c{i}") for i, c in enumerate(grid)]).first()
        at = next((i for i in range(64) if sums[i] >= kept * total), 63)
        low, high = grid[max(0, at - 1)], grid[at]
    return raked.withColumn("probability", F.least(F.lit(1.0), rate * high))


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id, the same wherever the row lies."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def _cell(of: str = "") -> Column:
    return F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("="), F.col(of + m)), F.lit("")).alias(m) for m in MARGINS]))


def calibrated(
    measured: DataFrame, powers: dict[str, float] = POWERS, kept: float | None = None, targets: dict[str, dict[str, float]] = TARGETS
) -> DataFrame:
    """(cell, weight, probability) from rows (source, lang, topic, tokens)."""
    cells = stored(measured.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    tidy_if_grown(measured.sparkSession)
    n = cells.count()
    if not n:
        return cells.select(_cell().alias("cell"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    if n <= CELLS_AT_ONCE:
        fit = stored(fitted(cells, powers, targets, kept), "raked")
        _warn(fit.select("gap").first()[0])
        tidy_if_grown(measured.sparkSession)
        return fit.select(F.explode("fit").alias("f")).select("f.*")
    to = {m: wanted(cells, m, powers[m], targets.get(m, {})) for m in MARGINS}
    return probabilities(rake(cells, to), kept).select(_cell().alias("cell"), "weight", "probability")


def _measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    return measures(docs, [*keep, named(docs, "source").alias("__source"), named(docs, "lang").alias("__lang")])


def _cells_of(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"))


def mix(
    docs: DataFrame, powers: dict[str, float] = POWERS, kept: float | None = None, targets: dict[str, dict[str, float]] = TARGETS
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, selected), one row per row of docs."""
    measured = stored(_measured(docs, [named(docs, "doc_id").alias("doc_id")]), "measured")
    placed = stored(topics(measured).of(measured), "placed")
    found = calibrated(_cells_of(placed), powers, kept, targets)
    rows = placed.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"))
    joined = rows.withColumn("cell", _cell()).join(found, "cell", "left")
    chance = F.coalesce("probability", F.lit(0.0))
    return joined.select(
        "doc_id", *MARGINS, "tokens", F.round(chance, 6).alias("probability"), (draw(F.col("doc_id")) < chance).alias("selected")
    )


def sample(
    docs: DataFrame, powers: dict[str, float] = POWERS, kept: float | None = None, targets: dict[str, dict[str, float]] = TARGETS
) -> DataFrame:
    """The documents kept, with their own columns. Texts are read twice and never shuffled."""
    measured = stored(_measured(docs, []), "measured")
    of = topics(measured)
    found = calibrated(_cells_of(of.of(measured)), powers, kept, targets)
    own = F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("own")
    rows = of.of(_measured(docs, [own])).select("own", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"))
    chosen = rows.withColumn("cell", _cell()).join(found, "cell").where(draw(F.col("own.doc_id")) < F.col("probability"))
    return chosen.select("own.*")
