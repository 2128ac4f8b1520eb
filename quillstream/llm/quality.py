"""Quality rules: base rules and robust multivariate outliers, with DataFrame functions only.

Each document has a vector of transformed statistics. For every language and source, every language, and all
documents the minimum covariance determinant estimate of centre and scatter is sought by concentration steps:
the share COVERAGE of documents with the smallest distances gives the next mean and covariance. Steps begin
from several STARTS, centres at the medians or the quartiles of all statistics; after two steps the start whose
scatter has the smallest determinant goes on, until no group's share changes (CONCENTRATIONS times at most).
The estimate is then reweighted over the documents within the usual bound, with its consistency factor.
Documents whose squared Mahalanobis distance exceeds CUTOFF are rejected. At a coverage of about half, junk may
make up nearly half of a group.

A document is judged by the estimate of its language and source, shrunk towards that of its language, and that
towards the estimate of all documents: an estimate from n documents has weight n / (n + SHRINK). So small
groups lean on wider ones without a size at which the rule changes.

Medians and the smallest distances are found from counts in fixed, fine bins, summed before any
shuffle: exact for the bins, the same however rows are dealt, and without a group ever meeting in
one task.

Defined results: a null or blank text has no words and fails the base rules; a text of any length is measured
whole; null language or source is a value of its own; documents that tie at the edge of a share are all within
it; a null doc_id keeps its row; repeated rows each count; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm._support import bind, named, stored

SPACE = r"[\x20\x09-\x0D]"
FEATURES = ("f0", "f1", "f2", "f3", "f4")
#: Width of the bins in which medians and quartiles are found, and least spread of each feature.
BIN_WIDTH = (0.02, 0.005, 0.005, 0.005, 0.005)
LEAST_SPREAD = (0.30, 0.05, 0.06, 0.15, 0.10)
COVERAGE, CONCENTRATIONS, SHRINK = 0.52, 20, 50
#: Quantiles of all statistics at which the starts have their centres.
STARTS = (0.5, 0.25, 0.75)
#: Fixed values for five features: consistency factor at that coverage, bound of the reweighting
#: (0.975 quantile of chi square) and its consistency factor, bound of the verdict (0.99999 quantile).
CONSISTENCY, REWEIGHT, REWEIGHT_CONSISTENCY, CUTOFF = 1.863, 12.83, 1.056, 30.86
#: Estimates up to this number are sent to every task; more are joined by their group.
SENT_GROUPS = 20_000


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window found twice or more, the first included.

    Windows are compared by a 64-bit hash. Positions of repeated ones come from one sort; each
    covers three words, less what the next one covers.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )

    def covered(at: Column) -> Column:
        return _total(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p).cast("long")))

    def positions(pairs: Column) -> Column:
        def twice(p: Column, i: Column) -> Column:
            same = lambda other: F.coalesce(other["h"] == p["h"], F.lit(False))
            return ((i > 0) & same(F.get(pairs, F.greatest(i - 1, F.lit(0))))) | same(F.get(pairs, i + 1))

        return F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["i"]))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            bind(pairs, lambda p: bind(positions(p), covered))
        )

    return bind(words, lambda w: bind(windows(w), count))


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document: ids, counts and transformed statistics of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), "lang", "source", text.alias("text"), words.alias("words"), lines.alias("lines"))
    counted = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.withColumns(
        {
            "f0": F.log1p(F.col("n_words").cast("double")),
            "f1": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
            "f2": F.sqrt(part("n_symbols", "word_chars")),
            "f3": (part("n_dup_lines", "n_lines") + part("n_repeat_words", "n_words")) / 2,
            "f4": F.sqrt(part("n_upper", "word_chars")),
        }
    )


def _starts(rows: DataFrame) -> DataFrame:
    """(g, m0.., s0.., and the like for the other starts): centres at STARTS and quartile spreads of every group, from counts in bins; g#k is start k of g."""
    bins = F.array(*[F.floor(F.col(f) / w).cast("int") for f, w in zip(FEATURES, BIN_WIDTH, strict=True)])
    counts = rows.select("g", F.posexplode(bins).alias("k", "bin")).groupBy("g", "k", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("g", "k")
    running = counts.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    found = running.groupBy("g").pivot("k", list(range(len(FEATURES)))).agg(*[at(q).alias(f"q{i}") for i, q in enumerate(STARTS)], at(0.25).alias("a"), at(0.75).alias("b"))
    starts = []
    for i in range(len(STARTS)):
        out = [F.concat("g", F.lit(f"#{i}")).alias("g")]
        for k, w in enumerate(BIN_WIDTH):
            out.append(((F.col(f"{k}_q{i}") + 0.5) * w).alias(f"m{k}"))
            spread = (F.col(f"{k}_b") - F.col(f"{k}_a")) * w / 1.349
            out.append(F.greatest(spread, F.lit(LEAST_SPREAD[k])).alias(f"s{k}"))
        starts.append(F.struct(*out))
    return found.select(F.explode(F.array(*starts)).alias("s")).select("s.*")


def _lower(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _distance(p: int) -> Column:
    """Squared length of G (x - m), G the inverse of the covariance's lower root."""
    rows = [reduce(lambda a, b: a + b, [F.col(f"g{i}{j}") * (F.col(f"f{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in range(p)]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def _inverse_root(moments: DataFrame, p: int, factor: float) -> DataFrame:
    """From means m* and covariances c*: (g, m*, g*), one column at a time on one row a group."""
    df = moments
    for i, j in _lower(p):
        cov = F.col(f"c{i}{j}") * factor
        if i == j:
            cov = cov + LEAST_SPREAD[i] ** 2 / 4  # a feature that is constant in the core keeps a spread
        cross = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        rest = reduce(lambda a, b: a - b, cross, cov)
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for i, j in _lower(p):
        if i == j:
            df = df.withColumn(f"g{i}{j}", 1 / F.col(f"l{i}{i}"))
        else:
            terms = [F.col(f"l{i}{k}") * F.col(f"g{k}{j}") for k in range(j, i)]
            df = df.withColumn(f"g{i}{j}", -reduce(lambda a, b: a + b, terms) / F.col(f"l{i}{i}"))
    return df.select("g", "core", *[f"m{i}" for i in range(p)], *[f"g{i}{j}" for i, j in _lower(p)])


def _moments(core: DataFrame, p: int) -> DataFrame:
    """Means and covariances of each group's core, from sums about the current centre; core: a sum over its members that tells whether it changed."""
    d = [F.col(f"f{i}") - F.col(f"m{i}") for i in range(p)]
    sums = [F.avg(d[i]).alias(f"d{i}") for i in range(p)] + [F.avg(d[i] * d[j]).alias(f"q{i}{j}") for i, j in _lower(p)]
    members = F.struct(F.count("*"), F.sum(F.xxhash64(*FEATURES).cast("decimal(38,0)"))).alias("core")
    got = core.groupBy("g").agg(members, *[F.first(f"m{i}").alias(f"o{i}") for i in range(p)], *sums)
    return got.select(
        "g", "core",
        *[(F.col(f"o{i}") + F.col(f"d{i}")).alias(f"m{i}") for i in range(p)],
        *[(F.col(f"q{i}{j}") - F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in _lower(p)],
    )


def _core(measured: DataFrame) -> DataFrame:
    """The share COVERAGE of each group with the smallest distances, up to the end of a distance bin."""
    binned = measured.withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * 64))
    counts = binned.groupBy("g", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("g")
    running = counts.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    edge = running.where(F.col("upto") >= F.col("all") * COVERAGE).groupBy("g").agg(F.min("bin").alias("edge"))
    return binned.join(edge, "g").where(F.col("bin") <= F.col("edge"))


def _with_estimate(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """rows with their group's estimate and squared distance; few: whether the estimates are at most SENT_GROUPS."""
    return rows.join(F.broadcast(now) if few else now, "g").withColumn("d2", _distance(len(FEATURES)))


def estimates(rows: DataFrame) -> DataFrame:
    """(g, core, m*, c*): size of the core, centre and scatter of every group of rows (g, f*)."""
    p = len(FEATURES)
    start = stored(_starts(rows), "mcd-centres")
    root = [(F.lit(0.0) if i != j else 1 / F.col(f"s{i}")).alias(f"g{i}{j}") for i, j in _lower(p)]
    now = stored(start.select("g", *[f"m{i}" for i in range(p)], *root), "mcd-start")
    few = now.count() <= SENT_GROUPS  # all starts counted
    each = rows.withColumn("g", F.explode(F.array(*[F.concat("g", F.lit(f"#{k}")) for k in range(len(STARTS))])))
    for _ in range(2):
        now = stored(_inverse_root(_moments(_core(_with_estimate(each, now, few)), p), p, CONSISTENCY).drop("core"), "mcd-try")
    determinant = -2 * reduce(lambda a, b: a + b, [F.log(f"g{i}{i}") for i in range(p)])
    of = F.expr("substring(g, 1, length(g) - 2)")
    least = now.withColumn("nth", F.row_number().over(Window.partitionBy(of).orderBy(determinant, "g"))).where("nth = 1").drop("nth")
    now = stored(least.withColumn("g", of), "mcd-best")
    seen = set()
    for _ in range(CONCENTRATIONS):
        step = stored(_inverse_root(_moments(_core(_with_estimate(rows, now, few)), p), p, CONSISTENCY), "mcd-step")
        now = step.drop("core")
        cores = step.agg(F.sum(F.xxhash64("g", "core").cast("decimal(38,0)"))).first()[0]
        if cores in seen:  # no core changes, or they come round in a cycle
            break
        seen.add(cores)
    else:
        warnings.warn(f"the cores of some groups still change after {CONCENTRATIONS} steps", stacklevel=2)
    within = _moments(_with_estimate(rows, now, few).where(F.col("d2") <= REWEIGHT), p)
    # a group none of whose documents is within the bound of its own estimate keeps what the steps found
    return stored(within.withColumn("core", F.col("core")[within.schema["core"].dataType.names[0]]), "mcd")


def shrunk(found: DataFrame, names: DataFrame) -> DataFrame:
    """(g, m*, g*) for every group of names (g, rest): its estimate, shrunk towards that of rest, and that towards all documents'."""
    p = len(FEATURES)
    values = [f"m{i}" for i in range(p)] + [f"c{i}{j}" for i, j in _lower(p)]

    def of(prefix: str) -> DataFrame:
        return found.select(F.col("g").alias(f"{prefix}g"), F.col("core").alias(f"{prefix}n"), *[F.col(v).alias(f"{prefix}{v}") for v in values])

    rows = names.join(of("o_"), F.col("g") == F.col("o_g"), "left").join(of("l_"), F.col("rest") == F.col("l_g"), "left")
    rows = rows.withColumn("whole", F.lit("all")).join(of("a_"), F.col("whole") == F.col("a_g"), "left")
    weight = lambda prefix: F.coalesce(F.col(f"{prefix}n") / (F.col(f"{prefix}n") + SHRINK), F.lit(0.0))

    def mean(v: str) -> Column:
        wide = weight("l_") * F.coalesce(f"l_{v}", F.lit(0.0)) + (1 - weight("l_")) * F.col(f"a_{v}")
        return weight("o_") * F.coalesce(f"o_{v}", F.lit(0.0)) + (1 - weight("o_")) * wide

    made = stored(rows.select("g", F.lit(0).alias("core"), *[mean(v).alias(v) for v in values]), "shrunk")
    return stored(_inverse_root(made, p, REWEIGHT_CONSISTENCY).drop("core"), "judges")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)."""
    rows = stored(statistics(docs), "statistics")
    own, rest = F.concat(F.lit("own"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("lang"), F.to_json(F.struct("lang")))
    rows = rows.withColumns({"g": own, "rest": rest})
    worded = rows.where("n_words > 0")
    found = estimates(worded.select(F.explode(F.array("g", "rest", F.lit("all"))).alias("g"), *FEATURES))
    judges = shrunk(found, worded.select("g", "rest").distinct())
    few = judges.count() <= SENT_GROUPS
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = rows.join(F.broadcast(judges) if few else judges, "g", "left").withColumn("distance", _distance(len(FEATURES)))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"),
        "distance",
    )
