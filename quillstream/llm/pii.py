"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the spans of four base patterns (email, ip, card, phone). A mention is a word with a digit or "@",
with number groups that follow it; it is an instance of the kinds whose shape it has (SHAPES), or of the kind
of the base match that it holds. What surrounds an instance, and how it is written, are its lexical patterns:
its characters by class, the word and the two words to its left, the words on both sides, the word to the left
or the start of a line with the instance's outline. Digits in them count as one digit, a word longer than
LONG_WORD by its digest.

The graph of patterns and instances is summed over all documents and scored in rounds. A pattern's trust in a
kind is the confidence of its known instances of that kind over all its instances that could be of it, plus
CAUTION; patterns of trust LEAST or more are accepted. An instance's confidence is one minus the chance that
all accepted patterns around it are wrong; those of LEAST or more are known in the next round. Trust never
falls as more is known, so the rounds end, when a round finds what the one before it found. Spans of
discovered instances that overlap no base span are added to the base ones, which always stay.

Offsets count code points; ends are exclusive.

Defined results: a null text is an empty one; texts of any length are taken whole, in time about linear in
their length and spans; of kinds that tie in confidence the first holds; a null doc_id keeps its row; repeated
rows each get a row, and an instance counts once however often it is repeated; an empty table gives no rows;
other columns are ignored by report and pass through redact, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm._support import bind, named, prefix_sums, running_most, stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no part is ever tried twice (long runs stay linear): the same
#: leftmost matches as the plain forms, since a run either leads to a match from its start or not at all.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD, GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
MENTION = rf"(?<!{WORD})(?={WORD}*[0-9@]){WORD}++(?:\x20[(]?[0-9][0-9().-]*+(?!{WORD}))*+"
#: Shapes that a discovered instance of a kind must have.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,7}$",
    "card": r"^(?:[0-9][\x20-]?){11,18}[0-9]$",
    "phone": r"^[+(]?(?:[0-9][\x20().-]*){6,14}[0-9]$",
}
CAUTION, LEAST = 2.0, 0.5
LONG_WORD = 64
SPAN = "array<struct<start:bigint,k:int,end:bigint>>"


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, value, before, after): all matches, leftmost and non-overlapping.

    before and after: the pieces of text between this match and its neighbours.
    """
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>")

    def placed(values: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            steps = F.transform(values, lambda v, i: (F.length(F.get(pieces, i)) + F.length(v)).cast("long"))
            return bind(
                prefix_sums(steps),
                lambda at: F.transform(
                    values,
                    lambda v, i: F.struct(
                        (F.get(at, i) + F.length(F.get(pieces, i))).alias("start"),
                        (F.get(at, i) + F.length(F.get(pieces, i)) + F.length(v)).alias("end"),
                        v.alias("value"),
                        F.get(pieces, i).alias("before"),
                        F.get(pieces, i + 1).alias("after"),
                    ),
                ),
            )

        return F.when(F.size(values) == 0, empty).otherwise(bind(F.split(text, pattern, -1), with_pieces))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column, turned: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    steps = F.sequence(F.lit(0), F.length(digits) - 1)
    return bind(F.reverse(digits), lambda t: F.aggregate(steps, F.lit(0), lambda a, i: add(a, i, t))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, r"^0+(?=.)", "")
            return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)

        return F.forall(F.split(value, r"\.", -1), small)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), bind(digits, _luhn)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(text: Column, k: int, kind: str) -> Column:
    none = F.array().cast(SPAN)
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if NEEDS[kind] else spans


def base_spans(text: Column) -> Column:
    """array of (start, k, end): valid matches of the base patterns, by start and kind."""
    return F.array_sort(F.concat(*[_spans(text, k, kind) for k, kind in enumerate(KINDS)]))


def _kind_within(value: Column) -> Column:
    """The first kind that has a valid base match in value; null: none."""

    def holds(kind: str) -> Column:
        return F.exists(F.regexp_extract_all(value, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: _valid(kind, x))

    return F.coalesce(*[F.when(holds(kind), k) for k, kind in enumerate(KINDS)])


def _suits(value: Column) -> Column:
    """array of the kinds whose shape value has."""
    return F.array_compact(F.array(*[F.when(value.rlike(SHAPES[kind]), k) for k, kind in enumerate(KINDS)]))


def _words(piece: Column) -> Column:
    """piece in lower case with single spaces and one digit for all."""
    flat = F.translate(F.lower(piece), "\t\n\x0b\f\r0123456789", "     9999999999")
    return F.btrim(F.regexp_replace(flat, r"\x20{2,}", " "))


def _bare(words: Column) -> Column:
    """words without the marks around them; long ones by their digest."""
    own = F.regexp_replace(words, r"^[^0-9\p{L}]+|[^0-9\p{L}]++$", "")
    return F.when(F.length(own) <= LONG_WORD, own).otherwise(F.concat(F.lit("#"), F.sha2(own, 256)))


def _patterns(value: Column, before: Column, after: Column, first: Column) -> Column:
    """array of the lexical patterns of a mention, the empty ones left out."""
    classes = F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}+", "a")
    outline = F.regexp_replace(classes, "9+", "9")

    def with_words(left: Column) -> Column:
        one, two = _bare(F.substring_index(left, " ", -1)), _bare(F.substring_index(left, " ", -2))
        next_ = _bare(F.substring_index(_words(after), " ", 1))
        line = first | F.regexp_replace(before, r"[\x20\x09\r]+$", "").endswith("\n")
        at_left = lambda name, *parts: F.when(one != "", F.concat_ws(" ", F.lit(name), *parts))
        return F.array_compact(
            F.array(
                F.concat_ws(" ", F.lit("written"), _bare(classes)),
                at_left("left", one),
                F.when(two != one, at_left("two", two)),
                at_left("both", one, F.lit("_"), next_),
                at_left("left, outline", one, _bare(outline)),
                F.when(line, F.concat_ws(" ", F.lit("line, outline"), _bare(outline))),
            )
        )

    return bind(_words(before), with_words)


def _mentions(text: Column) -> Column:
    """array of (start, end, value, k, suits, patterns): mentions that can be of a kind; k: the kind of a base match inside."""
    lead, tail = r"^[^0-9A-Za-z@+(]+", r"[^0-9A-Za-z)]++$"

    def one(m: Column) -> Column:
        bare = F.regexp_replace(m["value"], lead, "")
        start = m["start"] + F.length(m["value"]) - F.length(bare)

        def placed(value: Column) -> Column:
            return F.struct(
                start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                _kind_within(m["value"]).alias("k"), _suits(value).alias("suits"),
                m["before"].alias("before"), m["after"].alias("after"), m["start"].alias("at"),
            )

        return bind(F.lower(F.regexp_replace(bare, tail, "")), placed)

    def finished(m: Column) -> Column:
        found = _patterns(m["value"], m["before"], m["after"], F.length(m["before"]) == m["at"])
        return F.struct(m["start"], m["end"], m["value"], m["k"], m["suits"], found.alias("patterns"))

    able = F.filter(F.transform(matches(text, MENTION), one), lambda m: m["k"].isNotNull() | (F.size(m["suits"]) > 0))
    return F.transform(able, finished)


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One pass over the texts: row key, kept columns, base spans and mentions; a table in the shared folder."""
    text = F.coalesce(named(docs, "text"), F.lit(""))
    own = F.struct(*[named(docs, c).alias(c) for c in keep]).alias("own")
    rows = docs.select(own, text.alias("text"), F.monotonically_increasing_id().alias("row"))
    return stored(rows.select("row", "own", base_spans(F.col("text")).alias("base"), _mentions(F.col("text")).alias("mentions")), "pii-scan")


def occurrences(scanned: DataFrame) -> DataFrame:
    return scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")


def discover(occurring: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(value, k, confidence): instances found by patterns, beside the seeds.

    seeds: (value, k) of base matches; given, only these are known at the start (to hold out others).
    """
    kinds = F.when(F.col("k").isNotNull(), F.array("k")).otherwise(F.col("suits"))
    instances = occurring.select("value", "k", "patterns", F.explode(kinds).alias("kind"))
    edges = stored(
        instances.select("value", "kind", "k", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value", "kind").agg(F.max("k").alias("k")),
        "pattern-instances",
    )
    if seeds is None:
        seeds = edges.where("k IS NOT NULL").select("value", "k").distinct()
    seeds = stored(seeds.select("value", F.col("k").alias("kind"), F.lit(1.0).alias("confidence")), "seeds")
    degree = stored(edges.groupBy("pattern", "kind").agg(F.count("*").alias("n")).where("n > 1"), "pattern-degrees")
    open_ = edges.join(seeds.select("value").distinct(), "value", "left_anti").select("pattern", "value", "kind")
    # an instance counts only where some pattern of it has a known one beside it
    open_ = stored(open_.join(degree.select("pattern", "kind"), ["pattern", "kind"]), "open-instances")
    known, before = seeds, None
    while True:
        support = edges.select("pattern", "value", "kind").join(known, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("confidence").alias("support"))
        trusted = (
            support.join(degree, ["pattern", "kind"]).withColumn("trust", F.col("support") / (F.col("n") + CAUTION))
            .where(F.col("trust") >= LEAST).select("pattern", "kind", "trust")
        )
        wrong = F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999))))
        scored = open_.join(trusted, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(wrong)).alias("confidence"))
        best = Window.partitionBy("value").orderBy(F.desc("confidence"), "kind")
        found = stored(scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth"), "instances")
        state = found.agg(F.count("*"), F.sum(F.xxhash64("value", "kind").cast("decimal(38,0)"))).first()
        if state == before:
            return found.withColumnRenamed("kind", "k")
        before = state
        known = seeds.unionByName(found)


def held_back(docs: DataFrame, one_in: int = 3) -> dict[str, int]:
    """How discovery does on identifiers that it is not told: one in so many distinct seeds is hidden, by a hash of its value.

    hidden: how many; returned: found again with their kind; wrong: found again as another kind; others: found beside them.
    """
    occurring = stored(occurrences(scan(docs, ["doc_id"])), "mentions")
    seeds = occurring.where("k IS NOT NULL").groupBy("value").agg(F.max("k").alias("k"))
    hide = F.pmod(F.xxhash64("value"), F.lit(one_in)) == 0
    hidden = seeds.where(hide).withColumnRenamed("k", "real")
    # to discovery the hidden ones are mentions like any other
    blind = occurring.join(hidden.select("value", F.lit(True).alias("hidden")), "value", "left").withColumn("k", F.when(F.col("hidden").isNull(), F.col("k")))
    found = discover(blind, seeds.where(~hide)).join(hidden, "value", "full")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return found.agg(
        count(F.col("real").isNotNull()).alias("hidden"), count(F.col("real") == F.col("k")).alias("returned"),
        count(F.col("real") != F.col("k")).alias("wrong"), count(F.col("real").isNull()).alias("others"),
    ).first().asDict()


def clear_of(base: Column, more: Column) -> Column:
    """The spans of more that overlap none of base, in one pass over both in order."""

    def marked(spans: Column, of: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(of).alias("of"), s["end"].alias("end"), s["k"].alias("k")))

    def checked(both: Column) -> Column:
        reach = running_most(F.transform(both, lambda s: F.when(s["of"] == 0, s["end"]).otherwise(F.lit(-1).cast("long"))))
        ahead = running_most(F.transform(F.reverse(both), lambda s: F.when(s["of"] == 0, -s["start"]).otherwise(F.lit(-(1 << 62)).cast("long"))))
        n = F.size(both)

        def clear(r: Column) -> Column:
            def and_ahead(a: Column) -> Column:
                keep = F.filter(both, lambda s, i: (s["of"] == 1) & (F.get(r, i) <= s["start"]) & (-F.get(a, n - 1 - i) >= s["end"]))
                return F.transform(keep, lambda s: F.struct(s["start"], s["k"], s["end"]))

            return bind(ahead, and_ahead)

        return bind(reach, clear)

    return bind(F.array_sort(F.concat(marked(base, 0), marked(more, 1))), checked)


def extract(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(own, base, spans): kept columns as a struct, base spans, and all spans with the discovered ones."""
    scanned = scan(docs, keep or ["doc_id"])
    occurring = occurrences(scanned)
    found = discover(occurring)
    more = (
        occurring.where("k IS NULL").drop("k").join(found.select("value", "k"), "value")
        .groupBy("row").agg(F.collect_list(F.struct(F.col("start"), F.col("k"), F.col("end"))).alias("more"))
    )
    everything = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear_of(F.col("base"), F.col("more")))))
    return scanned.join(more, "row", "left").select("own", "base", everything.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found)."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return extract(docs).select(
        F.col("own.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_found"),
    )


def redacted(text: Column, spans: Column, block: int = 256) -> Column:
    """text with <EMAIL>, <IP>, <CARD> or <PHONE> in place of every span; spans that overlap count as one.

    The text is cut into the reaches of blocks of spans, and each of these at its own spans, so that no
    piece is sought from the start of a long text.
    """
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cut(of: Column, start: Column, end: Column) -> Column:
        return F.substring(of, (start + 1).cast("int"), (end - start).cast("int"))

    def pieces(s: Column) -> Column:
        def with_reach(r: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))

            def of_block(b: Column) -> Column:
                base = F.get(r, b * block)
                until = F.get(r, F.least((b + 1) * block, F.size(s)))

                def parts(t: Column) -> Column:
                    own = F.transform(
                        F.slice(s, b * block + 1, F.lit(block)),
                        lambda x, i: F.when(
                            x["start"] >= F.get(r, b * block + i),
                            F.concat(cut(t, F.get(r, b * block + i) - base, x["start"] - base), F.get(tags, x["k"])),
                        ).otherwise(F.lit("")),
                    )
                    return F.array_join(own, "")

                return bind(cut(text, base, until), parts)

            rest = F.substring(text, (F.get(r, F.size(s)) + 1).cast("int"), F.length(text))
            return F.concat(F.array_join(F.transform(blocks, of_block), ""), rest)

        # how far the spans before each one reach, and all of them
        ends = F.concat(F.transform(s, lambda x: x["end"]), F.array(F.lit(0).cast("long")))
        return bind(F.transform(running_most(ends), lambda x: F.greatest(x, F.lit(0).cast("long"))), with_reach)

    return F.when(F.size(spans) == 0, text).otherwise(bind(spans, pieces))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced in text; the same rows and columns (null texts become empty)."""
    found = extract(docs, docs.columns)
    text = redacted(F.coalesce(F.col("own.text"), F.lit("")), F.col("spans"))
    columns = [text.alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns]
    return found.select(*columns)
