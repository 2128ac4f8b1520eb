"""Registered queries over the driver's tables, and the same in DuckDB's SQL.

The events table is read as a log: three events a transaction, with inversions so that the order
of transactions differs from that of positions.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions.serde import merge_by_schema
from quillstream.functions.upcast import Registry, Upcaster, dropped, query_events, renamed
from quillstream.model import (
    AppendCriteria, EphemeralEvent, EventFilter, EventQuery, EventReference, FilterItem, LimitExceeded, OptimisticLockingError, StreamId, Tags,
)
from quillstream.operators import analytics as A
from quillstream.plans import predicates as P
from quillstream.plans import reader as R
from quillstream.sources import jsonio
from quillstream.sources.store import EventLedger
from quillstream.streaming.projector import PiecewiseProjection, ProjectionError, Projector, TableProjector, add_up, newest
from quillstream.streaming.source import into_table, project, read_stream, read_table
from quillstream.workspace import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHOP, OPS = "shop", "ops"


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the log's times are UTC
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tags = F.array(F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("k:"), F.get_json_object("props", "$.k")))
    tags = F.when(F.col("value") > 50, F.concat(tags, F.array(F.lit("big")))).otherwise(tags)
    return e.select(
        (F.col("event_id") + 1).alias("position"),
        (F.expr("event_id div 3") + 1 + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)).alias("tx"),
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "error", OPS).otherwise(SHOP).alias("stream_context"),
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("stream_purpose"),
        "event_type",
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("props").alias("event_data"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"note":"n'), (F.col("event_id") % 7).cast("string"), F.lit('"}'))).alias("event_erasable_data"),
        F.array_sort(tags).alias("event_tags"),
        "value",
    )


LOG = """log AS (
  SELECT event_id + 1 AS position, event_id // 3 + 1 + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS tx,
    CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'error' THEN 'ops' ELSE 'shop' END AS stream_context,
    'u' || (user_id % 4) AS stream_purpose, event_type, ts AS event_timestamp, props AS event_data,
    regexp_extract(props, '[0-9]+') AS k, CASE WHEN event_id % 3 = 0 THEN 'n' || (event_id % 7) END AS note,
    list_sort(list_concat(['user:' || user_id, 'k:' || regexp_extract(props, '[0-9]+')], CASE WHEN value > 50 THEN ['big'] ELSE [] END)) AS event_tags,
    value
  FROM events)"""


def read_model_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_view(spark, sf_dir)
    n = F.col("position") - 1
    once = log.select(
        (n * 2).alias("id"), "event_id", F.col("position").alias("event_position"),
        F.timestamp_add("MILLISECOND", (n % 17).cast("int"), F.col("event_timestamp")).alias("processed_at"),
        F.col("tx").alias("readmodel_tx"), F.lit("t1").alias("readmodel_thread"),
    )
    return once.union(once.where("(event_position - 1) % 500 = 0").withColumn("id", F.col("id") + 1))


MODEL = """once AS (
  SELECT (position - 1) * 2 AS id, event_id, position AS event_position,
    event_timestamp + to_milliseconds((position - 1) % 17) AS processed_at, tx AS readmodel_tx FROM log),
model AS (SELECT * FROM once UNION ALL SELECT id + 1, event_id, event_position, processed_at, readmodel_tx FROM once WHERE (event_position - 1) % 500 = 0)"""

ROW = "position, tx, event_type, stream_context || '#' || stream_purpose AS stream, array_to_string(event_tags, ',') AS tags"


def rows(df: DataFrame) -> DataFrame:
    return df.select(
        "position", "tx", "event_type", F.concat_ws("#", "stream_context", "stream_purpose").alias("stream"), F.array_join("event_tags", ",").alias("tags")
    )


def numbered(df: DataFrame, *order) -> DataFrame:
    """A column seq over the rows of a limited result."""
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long"))


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {LOG} {sql}"


def reading(name: str, query: EventQuery, where: str, stream: StreamId = StreamId.any(), cursor: EventReference | None = None) -> None:
    """A query whose result is checked as a set of rows."""
    add(
        name,
        lambda spark, sf: rows(R.select_events(log_view(spark, sf), query, stream, cursor)),
        f"SELECT {ROW} FROM log WHERE {where}",
    )


def ordered(name: str, query: EventQuery, where: str, order: str, limit: int, cursor: EventReference | None = None) -> None:
    """A limited query, checked with its order."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = R.query_log(log_view(spark, sf), query.limited(limit), cursor=cursor)
        return numbered(rows(found), *P.reading_order(query.direction))

    add(name, run, f"SELECT {ROW}, row_number() OVER (ORDER BY {order}) AS seq FROM log WHERE {where} ORDER BY {order} LIMIT {limit}")


def ref(tx: int, position: int, index: int = 0) -> EventReference:
    return EventReference("x", position, tx, index)


def has(*tags: str) -> str:
    return " AND ".join(f"list_contains(event_tags, '{t}')" for t in tags)


Q = EventQuery
UNTIL = "(tx < 200 OR (tx = 200 AND position <= 598))"
AFTER = "(tx > 100 OR (tx = 100 AND position > 300))"
BEFORE = "(tx < 100 OR (tx = 100 AND position < 300))"
reading("scan_all", Q.match_all(), "true")
reading("filter_type", Q.for_events(["purchase"]), "event_type = 'purchase'")
reading("filter_types_in", Q.for_events(["purchase", "error"]), "event_type IN ('purchase', 'error')")
reading("filter_tag", Q.for_events(tags=["user:8"]), has("user:8"))
reading("filter_tags_all", Q.for_events(tags=["user:8", "big"]), has("user:8", "big"))
reading("filter_type_and_tags", Q.for_events(["click"], ["big", "user:8"]), f"event_type = 'click' AND {has('big', 'user:8')}")
OR_ITEMS = Q(EventFilter((FilterItem(frozenset({"signup"}), Tags.of("big")), FilterItem(frozenset({"view", "signup"}), Tags.of("user:3")))))
reading("filter_or_items", OR_ITEMS, f"(event_type = 'signup' AND {has('big')}) OR (event_type IN ('view', 'signup') AND {has('user:3')})")
reading("match_none", Q.match_none(), "false")
reading("until_inclusive", Q.match_all().until(ref(200, 598)), UNTIL)
reading("cursor_forward", Q.for_events(["click"]), f"event_type = 'click' AND {AFTER}", cursor=ref(100, 300))
reading("cursor_backward", Q.for_events(["click"]).backwards(), f"event_type = 'click' AND {BEFORE}", cursor=ref(100, 300))
reading("cursor_until_range", Q.match_all().until(ref(200, 598)), f"{UNTIL} AND {AFTER}", cursor=ref(100, 300))
reading("stream_exact", Q.match_all(), "stream_context = 'shop' AND stream_purpose = 'u1'", StreamId(SHOP, "u1"))
reading("stream_any_purpose", Q.for_events(tags=["big"]), f"stream_context = 'ops' AND {has('big')}", StreamId(OPS, None))
reading("stream_any_context", Q.for_events(tags=["big"]), f"stream_purpose = 'u2' AND {has('big')}", StreamId(None, "u2"))
A1, A2 = Q.for_events(["signup", "view"]), Q.for_events(["view", "error"], ["big"])
reading("combine_overlap", A1.combine_with(A2), f"event_type IN ('signup', 'view') OR (event_type IN ('view', 'error') AND {has('big')})")
reading("key_only_tag", Q.for_events(["error"], ["big"]), f"event_type = 'error' AND {has('big')}")
ordered("order_backward", Q.for_events(["view"]).backwards(), "event_type = 'view'", "tx DESC, position DESC", 200)
ordered("topk_newest", Q.for_events(tags=["big"]).backwards(), has("big"), "tx DESC, position DESC", 10)
ordered("limit_forward", Q.for_events(tags=["big"]), f"{has('big')} AND {AFTER}", "tx, position", 7, ref(100, 300))
ordered("cursor_limit_flagship", Q.for_events(["purchase"], ["big"]).backwards(), f"event_type = 'purchase' AND {has('big')} AND {BEFORE}", "tx DESC, position DESC", 25, ref(100, 300))

add(
    "filter_tags_any",
    lambda s, d: rows(log_view(s, d).where(P.has_any_tag(Tags.of("user:8", "k:5")))),
    f"SELECT {ROW} FROM log WHERE list_has_any(event_tags, ['user:8', 'k:5'])",
)
add(
    "filter_tags_indexed",
    lambda s, d: rows(R.with_all_tags(log_view(s, d), R.tag_index(log_view(s, d)), ["user:8", "big"])),
    f"SELECT {ROW} FROM log WHERE {has('user:8', 'big')}",
)
add("get_by_id", lambda s, d: rows(R.event_by_id(log_view(s, d), "77", StreamId(None, None))), f"SELECT {ROW} FROM log WHERE event_id = '77'")
add(
    "tag_lookup_by_key",
    lambda s, d: log_view(s, d).groupBy(R.tag_value("user").alias("user")).agg(F.count("*").alias("n"), F.max("position").alias("last")),
    "SELECT substr(list_filter(event_tags, lambda t: starts_with(t, 'user:'))[1], 6) AS \"user\", count(*) AS n, max(position) AS last FROM log GROUP BY 1",
)
add(
    "reference_text",
    lambda s, d: log_view(s, d).select("position", R.reference_text().alias("reference")),
    "SELECT position, event_id || ':' || tx || ':' || position AS reference FROM log",
)


def history() -> Registry:
    """click was renamed to tap, purchase split into two, error dropped."""
    k = lambda data: F.get_json_object(data, "$.k")
    split = Upcaster(
        ("order_placed", "payment_made"),
        lambda data: [
            ("order_placed", F.concat(F.lit('{"order":'), k(data), F.lit("}"))),
            ("payment_made", F.concat(F.lit('{"amount":'), k(data), F.lit("}"))),
        ],
    )
    return (
        Registry().event("tap").event("order_placed").event("payment_made").event("signup").event("view")
        .interface("sale", ["order_placed", "payment_made"])
        .legacy_event("click", renamed("tap")).legacy_event("purchase", split).legacy_event("error", dropped())
    )


def upcast(name: str, query: EventQuery, where: str, keep: str, order: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        got = query_events(log_view(spark, sf), query, history(), merge_erasable=False)
        got = got.select("position", "tx", F.col("index").cast("long").alias("index"), "event_type", "stored_type", "data")
        return numbered(got, *P.reading_order(query.direction, index=True)) if order else got

    limit = f"ORDER BY {order} LIMIT {query.limit.value}" if order else ""
    seq = f", row_number() OVER (ORDER BY {order}, index {'DESC' if 'DESC' in order else ''}) AS seq" if order else ""
    add(
        name, run,
        f""", chosen AS (SELECT * FROM log WHERE {where} {limit}), parts AS (
  SELECT position, tx, 0 AS index, 'tap' AS event_type, event_type AS stored_type, event_data AS data FROM chosen WHERE event_type = 'click'
  UNION ALL SELECT position, tx, 0, 'order_placed', event_type, '{{"order":' || k || '}}' FROM chosen WHERE event_type = 'purchase'
  UNION ALL SELECT position, tx, 1, 'payment_made', event_type, '{{"amount":' || k || '}}' FROM chosen WHERE event_type = 'purchase'
  UNION ALL SELECT position, tx, 0, event_type, event_type, event_data FROM chosen WHERE event_type IN ('signup', 'view'))
SELECT position, tx, CAST(index AS BIGINT) AS index, event_type, stored_type, data{seq} FROM parts WHERE {keep}""",
    )


upcast("upcast_rename", Q.for_events(["tap"]), "event_type = 'click'", "true")
upcast("upcast_split", Q.for_events(["sale"]), "event_type = 'purchase'", "true")
upcast("upcast_drop", Q.for_events(tags=["user:8"]), has("user:8"), "true")
upcast("upcast_limit_before_expand", Q.match_all().backwards().limited(50), "true", "true", "tx DESC, position DESC")
upcast("legacy_widening", Q.for_events(["payment_made", "view"], ["big"]), f"event_type IN ('purchase', 'view') AND {has('big')}", "event_type IN ('payment_made', 'view')")


def erasable_merge(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import types as T

    from quillstream.functions.serde import erasable

    schema = T.StructType([T.StructField("k", T.LongType()), erasable("note", T.StringType())])
    data = merge_by_schema(F.col("event_data"), F.col("event_erasable_data"), schema)
    return log_view(spark, sf).select("position", data.alias("data")).select("position", "data.k", "data.note")


add("erasable_merge", erasable_merge, "SELECT position, CAST(k AS BIGINT) AS k, note FROM log")

TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def range_text(s: SparkSession, d: str) -> DataFrame:
    return A.log_range(log_view(s, d)).select("n", second("first_at").alias("first_at"), second("last_at").alias("last_at"))


add("event_count_range", range_text, f"SELECT count(*) AS n, {TEXT.format('min(event_timestamp)')} AS first_at, {TEXT.format('max(event_timestamp)')} AS last_at FROM log")
add(
    "events_per_second",
    lambda s, d: A.per_second(log_view(s, d)).select(second("second").alias("second"), "n"),
    f"SELECT {TEXT.format('event_timestamp')} AS second, count(*) AS n FROM log GROUP BY 1",
)
ONCE = f", {MODEL}"
JOINED = ", j AS (SELECT log.*, processed_at, epoch_us(processed_at) - epoch_us(event_timestamp) AS us FROM log JOIN model ON position = event_position)"
SUMMARY = """count(*) AS n, round(avg(us / 1000), 6) AS avg_ms, round(min(us / 1000), 6) AS min_ms, round(max(us / 1000), 6) AS max_ms,
  round(quantile_cont(us / 1000, 0.5), 6) AS p50, round(quantile_cont(us / 1000, 0.9), 6) AS p90, round(quantile_cont(us / 1000, 0.95), 6) AS p95"""


def six() -> list:
    """Doubles to six places: engines differ in the last bit."""
    return ["n", *[F.round(c, 6).alias(c) for c in ("avg_ms", "min_ms", "max_ms", "p50", "p90", "p95")]]


add(
    "latency_per_event",
    lambda s, d: A.latencies(log_view(s, d), read_model_view(s, d)).select("position", "id", F.round("latency_ms", 6).alias("latency_ms")),
    f"{ONCE} SELECT position, id, round((epoch_us(processed_at) - epoch_us(event_timestamp)) / 1000, 6) AS latency_ms FROM log JOIN model ON position = event_position",
)
add("latency_summary", lambda s, d: A.latency_summary(log_view(s, d), read_model_view(s, d)).select(*six()), f"{ONCE}{JOINED} SELECT {SUMMARY} FROM j")
add(
    "latency_by_bucket",
    lambda s, d: A.latency_by_second(log_view(s, d), read_model_view(s, d)).select(second("second").alias("second"), *six()),
    f"{ONCE}{JOINED} SELECT {TEXT.format('event_timestamp')} AS second, {SUMMARY} FROM j GROUP BY 1",
)
add("duplicate_positions", lambda s, d: A.duplicate_positions(read_model_view(s, d)), f"{ONCE} SELECT event_position, count(*) AS n FROM model GROUP BY 1 HAVING count(*) > 1")
add(
    "duplicate_detail",
    lambda s, d: A.duplicate_details(log_view(s, d), read_model_view(s, d).drop("event_id")).select("event_position", "id", "event_type", "tx"),
    f"{ONCE} SELECT event_position, model.id, event_type, tx FROM model LEFT JOIN log ON event_position = position WHERE event_position IN (SELECT event_position FROM model GROUP BY 1 HAVING count(*) > 1)",
)
add(
    "unprocessed",
    lambda s, d: rows(A.unprocessed(log_view(s, d), read_model_view(s, d).where("event_position % 7 <> 0"))),
    f"{ONCE} SELECT {ROW} FROM log WHERE NOT EXISTS (SELECT 1 FROM model WHERE event_position = position AND event_position % 7 <> 0)",
)
add(
    "out_of_order_lag",
    lambda s, d: A.out_of_order(log_view(s, d)),
    ", l AS (SELECT position, tx, lag(position) OVER (ORDER BY position) AS prev_position, lag(tx) OVER (ORDER BY position) AS prev_tx FROM log) SELECT * FROM l WHERE tx < prev_tx",
)
add(
    "out_of_order_unprocessed",
    lambda s, d: A.out_of_order(log_view(s, d)).join(read_model_view(s, d), F.col("position") == F.col("event_position"), "left").groupBy("position").agg(F.count("id").alias("n")),
    f"{ONCE}, l AS (SELECT position, tx, lag(tx) OVER (ORDER BY position) AS prev_tx FROM log) SELECT position, count(id) AS n FROM l LEFT JOIN model ON position = event_position WHERE tx < prev_tx GROUP BY 1",
)
add(
    "fold_last_value",
    lambda s, d: A.last_value(log_view(s, d), R.tag_value("user"), F.col("event_type")),
    "SELECT substr(list_filter(event_tags, lambda t: starts_with(t, 'user:'))[1], 6) AS key, arg_max(event_type, tx * 1000000000 + position) AS value FROM log GROUP BY 1",
)


def k_value():
    return F.get_json_object("event_data", "$.k").cast("long")


add(
    "fold_running_balance",
    lambda s, d: log_view(s, d).groupBy("stream_purpose").agg(
        F.sum(F.when(F.col("event_type") == "purchase", k_value()).when(F.col("event_type") == "error", -k_value()).otherwise(0)).alias("balance"),
        F.bool_or(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "view").alias("views"),
    ),
    "SELECT stream_purpose, CAST(sum(CASE event_type WHEN 'purchase' THEN CAST(k AS BIGINT) WHEN 'error' THEN -CAST(k AS BIGINT) ELSE 0 END) AS BIGINT) AS balance, bool_or(event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS views FROM log GROUP BY 1",
)


def fold_savepoint(s: SparkSession, d: str) -> DataFrame:
    """Start from the newest signup of the stream, then count what follows: two scans, the first a top-1."""
    log, stream = log_view(s, d), StreamId(SHOP, "u1")
    save = R.query_log(log, Q.for_events(["signup"]).backwards().limited(40), stream).orderBy("tx", "position").limit(1)
    save = save.select("tx", "position").first()
    rest = R.select_events(log, Q.match_all(), stream, ref(save["tx"], save["position"]) if save else None)
    return rest.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k_value()).alias("k_sum"))


add(
    "fold_savepoint", fold_savepoint,
    """, u AS (SELECT * FROM log WHERE stream_context = 'shop' AND stream_purpose = 'u1'),
s AS (SELECT tx AS s_tx, position AS s_position FROM u WHERE event_type = 'signup' ORDER BY tx DESC, position DESC LIMIT 1 OFFSET 39)
SELECT event_type, count(*) AS n, CAST(sum(CAST(k AS BIGINT)) AS BIGINT) AS k_sum FROM u, s WHERE tx > s_tx OR (tx = s_tx AND position > s_position) GROUP BY 1""",
)
add(
    "decision_model_counts",
    lambda s, d: R.select_events(log_view(s, d), Q.for_events(["purchase", "signup"], ["big"])).groupBy(R.tag_value("user").alias("user")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "signup").alias("signups")),
    f"SELECT substr(list_filter(event_tags, lambda t: starts_with(t, 'user:'))[1], 6) AS \"user\", count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'signup') AS signups FROM log WHERE event_type IN ('purchase', 'signup') AND {has('big')} GROUP BY 1",
)
add(
    "occ_conflict_probe",
    lambda s, d: R.select_events(log_view(s, d), Q.for_events(["purchase"], ["user:8"]), StreamId(SHOP, "u0"), ref(100, 300)).agg((F.count("*") > 0).alias("conflict")),
    f"SELECT count(*) > 0 AS conflict FROM log WHERE event_type = 'purchase' AND {has('user:8')} AND stream_context = 'shop' AND stream_purpose = 'u0' AND {AFTER}",
)
add(
    "bookmark_latest",
    lambda s, d: log_view(s, d).groupBy(F.concat(F.lit("reader-"), F.col("event_type")).alias("reader")).agg(F.max(F.struct("tx", "position")).alias("r")).select("reader", "r.tx", "r.position"),
    "SELECT 'reader-' || event_type AS reader, max(tx * 1000000000 + position) // 1000000000 AS tx, max(tx * 1000000000 + position) % 1000000000 AS position FROM log GROUP BY 1",
)
add(
    "notify_last_per_stream", lambda s, d: A.last_per_stream(log_view(s, d)),
    "SELECT stream_context, stream_purpose, max(tx) AS tx, arg_max(position, tx * 1000000000 + position) AS position, arg_max(event_id, tx * 1000000000 + position) AS event_id FROM log GROUP BY 1, 2",
)


def page_boundaries(s: SparkSession, d: str, size: int = 500, rows_of_a_range: int = 100_000) -> DataFrame:
    """Every keyset page of a query: its rows, and the reference after which the next one begins.

    Rows are numbered inside ranges of tx and shifted by the sizes of the ranges before, so no task sees them all.
    """
    clicks = R.select_events(log_view(s, d), Q.for_events(["click"]), StreamId.any(), None).select("tx", "position")
    low, high, n = clicks.agg(F.min("tx"), F.max("tx"), F.count("*")).first()
    wide = max(1, (high - low + 1) * rows_of_a_range // n) if n else 1
    ranged = clicks.withColumn("range", F.floor((F.col("tx") - (low or 0)) / wide))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("own"))
    before = sizes.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))  # a row a range
    nth = F.row_number().over(Window.partitionBy("range").orderBy("tx", "position")) + F.col("before")
    paged = ranged.join(before, "range").select(F.floor((nth - 1) / size + 1).alias("page"), "tx", "position")
    pages = paged.groupBy("page").agg(F.count("*").alias("n"), F.max(F.struct("tx", "position")).alias("r"))
    return pages.select("page", "n", "r.tx", "r.position")


add(
    "page_boundaries", page_boundaries,
    """, c AS (SELECT tx, position, (row_number() OVER (ORDER BY tx, position) - 1) // 500 + 1 AS page FROM log WHERE event_type = 'click')
SELECT page, count(*) AS n, max(tx * 1000000000 + position) // 1000000000 AS tx, max(tx * 1000000000 + position) % 1000000000 AS position FROM c GROUP BY 1""",
)


# ---- through the store: what is written is read back ----------------------------------------

TYPES = ("click", "error", "purchase", "signup", "view")
STORED = "position, CAST(1 AS BIGINT) AS tx, event_type, stream_context || '#' || stream_purpose AS stream, array_to_string(event_tags, ',') AS tags"


def ledger_of(spark: SparkSession, sf: str) -> EventLedger:
    """A new ledger in the shared folder that holds the whole events table as its first version."""
    ledger = EventLedger(spark, fresh_folder(spark, "ledger"))
    ledger.import_events(log_view(spark, sf).drop("value"))
    return ledger


def written(name: str, query: Callable[[EventLedger], DataFrame], sql: str) -> None:
    add(name, lambda spark, sf: query(ledger_of(spark, sf)), sql)


written("ledger_import", lambda ledger: rows(ledger.snapshot()), f"SELECT {STORED} FROM log")


def _compacted(ledger: EventLedger) -> DataFrame:
    ledger.stream(StreamId(SHOP, "u1"), Registry().event("click")).append(EphemeralEvent("click", {"k": 1}, Tags.of("user:0")))
    ledger.compact()
    return rows(ledger.snapshot().withColumn("event_type", F.when(F.col("tx") > 1, "appended").otherwise(F.col("event_type"))))


written(
    "ledger_append_compact", _compacted,
    f"SELECT {STORED} FROM log UNION ALL SELECT (SELECT max(position) FROM log) + 1, 2, 'appended', 'shop#u1', 'user:0'",
)


def _erased(ledger: EventLedger) -> DataFrame:
    ledger.erase(F.array_contains("event_tags", "big"), None)
    return ledger.snapshot().select("position", F.get_json_object("event_erasable_data", "$.note").alias("note"))


written("ledger_erase", _erased, "SELECT position, CASE WHEN NOT list_contains(event_tags, 'big') THEN note END AS note FROM log")


def _conflicts(ledger: EventLedger) -> DataFrame:
    """For each type: whether an append that expects nothing newer than the log's middle is refused, and whether one that knows all is."""
    log = ledger.snapshot()
    half = log.agg((F.max("position") / 2).cast("long")).first()[0]
    last = {r["event_type"]: r["p"] for r in log.groupBy("event_type").agg(F.max("position").alias("p")).collect()}  # a row a type
    out = []
    for kind, position in sorted(last.items()):
        refused = []
        for known in (half, position):
            watched = AppendCriteria.of(EventFilter.for_events([kind]), EventReference("x", known, 1))
            try:
                ledger.append(watched, StreamId.any(), [])
                refused.append(False)
            except OptimisticLockingError:
                refused.append(True)
        out.append((kind, *refused))
    return ledger.spark.createDataFrame(out, "event_type string, behind boolean, up_to_date boolean")


written(
    "ledger_conflicts", _conflicts,
    """SELECT event_type, max(position) > (SELECT CAST(floor(max(position) / 2) AS BIGINT) FROM log) AS behind, false AS up_to_date FROM log GROUP BY 1""",
)


def _bookmarked(ledger: EventLedger) -> DataFrame:
    """A bookmark for each stream at its newest event, one of them moved back to the oldest and one taken away."""
    ends = ledger.snapshot().groupBy("stream_context", "stream_purpose").agg(
        F.min(F.struct("position", "event_id")).alias("low"), F.max(F.struct("position", "event_id")).alias("high")
    )
    for r in sorted(ends.collect()):  # a row a stream
        reader = f"{r['stream_context']}#{r['stream_purpose']}"
        ledger.place_bookmark(reader, EventReference(r["high"]["event_id"], r["high"]["position"], 1), Tags.of("kind:newest"))
        if reader == "shop#u0":
            ledger.place_bookmark(reader, EventReference(r["low"]["event_id"], r["low"]["position"], 1), Tags.of("kind:oldest"))
        if reader == "shop#u1":
            ledger.remove_bookmark(reader)
    return ledger.bookmarks_table().select("reader", "position", "event_id", F.array_join("tags", ",").alias("tags"))


written(
    "ledger_bookmarks", _bookmarked,
    """, b AS (SELECT stream_context || '#' || stream_purpose AS reader, min(position) AS low, max(position) AS high FROM log GROUP BY 1)
SELECT reader, CASE WHEN reader = 'shop#u0' THEN low ELSE high END AS position, CAST(CASE WHEN reader = 'shop#u0' THEN low ELSE high END - 1 AS VARCHAR) AS event_id,
  CASE WHEN reader = 'shop#u0' THEN 'kind:oldest' ELSE 'kind:newest' END AS tags FROM b WHERE reader <> 'shop#u1'""",
)


class _Totals(PiecewiseProjection):
    def __init__(self, kinds: tuple[str, ...]):
        self.kinds, self.n, self.last = kinds, Counter(), {}

    def query(self) -> EventQuery:
        return Q.for_events(list(self.kinds))

    def when(self, event) -> None:
        self.n[event.type] += 1
        self.last[event.type] = event.reference.position

    def piece(self) -> "_Totals":
        made = copy.copy(self)
        made.n, made.last = Counter(), {}
        return made

    def found(self) -> tuple[dict[str, int], dict[str, int]]:
        return dict(self.n), self.last

    def merge(self, found: tuple[dict[str, int], dict[str, int]]) -> None:
        self.n.update(found[0])
        self.last.update(found[1])


def _projected(ledger: EventLedger) -> DataFrame:
    """A bookmarked projection run twice: the second run finds nothing new."""
    registry = Registry()
    for kind in TYPES:
        registry.event(kind)
    stream, totals = ledger.stream(StreamId.any(), registry), _Totals(("purchase", "error"))
    for _ in range(2):
        Projector(stream, totals, batch_size=20_000, bookmark="totals").run()
    reached = ledger.bookmark("totals").position
    found = [(k, n, totals.last[k], reached) for k, n in sorted(totals.n.items())]
    return ledger.spark.createDataFrame(found, "event_type string, n long, last long, bookmark long")


written(
    "ledger_projection", _projected,
    """, p AS (SELECT * FROM log WHERE event_type IN ('purchase', 'error'))
SELECT event_type, count(*) AS n, max(position) AS last, (SELECT max(position) FROM p) AS bookmark FROM p GROUP BY 1""",
)


def _streamed(ledger: EventLedger) -> DataFrame:
    """Structured Streaming over the ledger into a table; the erasure before it has replaced the files of the first version."""
    ledger.erase(F.lit(False))
    out = fresh_folder(ledger.spark, "streamed")
    project(read_stream(ledger), fresh_folder(ledger.spark, "offsets"), into_table(out)).awaitTermination()
    return rows(read_table(ledger.spark, out))


written("ledger_stream", _streamed, f"SELECT {STORED} FROM log")


def exported(spark: SparkSession, sf: str) -> DataFrame:
    """JSON documents written by the executors and read back."""
    folder = fresh_folder(spark, "documents")
    jsonio.write_events(ledger_of(spark, sf).snapshot(), folder)
    back = jsonio.read_events_lines(spark, folder)
    return back.select(
        "position", "tx", "event_type", F.concat_ws("#", "stream_context", "stream_purpose").alias("stream"),
        F.array_join("event_tags", ",").alias("tags"), F.get_json_object("event_erasable_data", "$.note").alias("note"),
    )


add("json_round_trip", exported, f"SELECT {STORED}, note FROM log")


def every_type() -> Registry:
    registry = Registry()
    for kind in TYPES:
        registry.event(kind)
    return registry


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    """An import that keeps its transactions; the next append follows the largest of them."""
    ledger = EventLedger(spark, fresh_folder(spark, "ledger"))
    ledger.import_events(log_view(spark, sf).drop("value"), keep_tx=True)
    ledger.stream(StreamId(SHOP, "u1"), every_type()).append(EphemeralEvent("signup", {}, Tags.of("user:0")))
    return rows(EventLedger(spark, ledger.base).snapshot())


add(
    "ledger_seeded", _seeded,
    f"SELECT {ROW} FROM log UNION ALL SELECT max(position) + 1, max(tx) + 1, 'signup', 'shop#u1', 'user:0' FROM log",
)


def _type_counts(ledger: EventLedger) -> list[tuple[str, int]]:
    """A row a type."""
    return sorted(tuple(r) for r in ledger.snapshot().groupBy("event_type").agg(F.count("*")).collect())


def _one_transaction(ledger: EventLedger) -> DataFrame:
    """An event a type, with that type's count, appended as one transaction: contiguous positions, one number."""
    stream = ledger.stream(StreamId(OPS, "totals"), every_type())
    stream.append([EphemeralEvent(kind, {"n": n}, Tags.of("total", f"of:{kind}")) for kind, n in _type_counts(ledger)])
    back = stream.events(Q.for_events(tags=["total"]))
    return back.select("position", "tx", "event_type", F.get_json_object("data", "$.n").cast("long").alias("n"), F.array_join("event_tags", ",").alias("tags"))


written(
    "ledger_append_transaction", _one_transaction,
    """, t AS (SELECT event_type, count(*) AS n FROM log GROUP BY 1)
SELECT (SELECT max(position) FROM log) + row_number() OVER (ORDER BY event_type) AS position, CAST(2 AS BIGINT) AS tx, event_type, n, 'of:' || event_type || ',total' AS tags FROM t""",
)


def _versions(ledger: EventLedger) -> DataFrame:
    """The log as it was before appends and a compaction."""
    stream = ledger.stream(StreamId(OPS, "totals"), every_type())
    for kind in TYPES:
        stream.append(EphemeralEvent(kind, {}))
    ledger.compact()
    return rows(ledger.snapshot(1))


written("ledger_earlier_version", _versions, f"SELECT {STORED} FROM log")


def _keys(ledger: EventLedger) -> DataFrame:
    """How many events an idempotency key lets in: at first, again, and through a ledger opened anew."""
    first, later = (EventLedger(ledger.spark, ledger.base).stream(StreamId(OPS, "keys"), every_type()) for _ in range(2))
    found = []
    for kind, n in _type_counts(ledger):
        event = EphemeralEvent(kind, {"n": n}, Tags(), f"key of {kind}")
        found.append((kind, *[len(s.append(event)) for s in (first, first, later)]))
    return ledger.spark.createDataFrame(found, "event_type string, first long, again long, reopened long")


written("ledger_idempotency", _keys, 'SELECT event_type, CAST(1 AS BIGINT) AS "first", CAST(0 AS BIGINT) AS again, CAST(0 AS BIGINT) AS reopened FROM log GROUP BY 1')


def _legacy_conflicts(ledger: EventLedger) -> DataFrame:
    """Whether an append that watches a current type and knows half the log is refused: stored legacy rows that become that type count."""
    half = ledger.snapshot().agg((F.max("position") / 2).cast("long")).first()[0]
    registry, found = history(), []
    for kind in ("order_placed", "payment_made", "signup", "tap", "view"):
        watched = AppendCriteria(registry.widened(EventFilter.for_events([kind])), EventReference("x", half, 1))
        try:
            ledger.append(watched, StreamId.any(), [])
            found.append((kind, False))
        except OptimisticLockingError:
            found.append((kind, True))
    return ledger.spark.createDataFrame(found, "event_type string, refused boolean")


written(
    "ledger_legacy_conflicts", _legacy_conflicts,
    """, m AS (SELECT unnest([('order_placed', 'purchase'), ('payment_made', 'purchase'), ('signup', 'signup'), ('tap', 'click'), ('view', 'view')]) AS pair)
SELECT pair[1] AS event_type, EXISTS (SELECT 1 FROM log WHERE event_type = pair[2] AND position > (SELECT CAST(floor(max(position) / 2) AS BIGINT) FROM log)) AS refused FROM m""",
)


def _upcast_stream(ledger: EventLedger) -> DataFrame:
    """A stream of every purpose of one context, read with today's types and bounded by the earlier of two references."""
    middle = ledger.snapshot().agg((F.max("position") / 2).cast("long")).first()[0]
    stream = ledger.stream(StreamId(SHOP, None), history())
    query = Q.match_all().until(EventReference("x", middle, 1, 9)).until_if_earlier(EventReference("x", middle + 100, 1))
    return stream.events(query).select("position", F.col("index").cast("long").alias("index"), "event_type", "stored_type")


written(
    "ledger_stream_upcast_until", _upcast_stream,
    """, s AS (SELECT * FROM log WHERE stream_context = 'shop' AND position <= (SELECT CAST(floor(max(position) / 2) AS BIGINT) FROM log))
SELECT position, CAST(0 AS BIGINT) AS index, CASE event_type WHEN 'click' THEN 'tap' WHEN 'purchase' THEN 'order_placed' ELSE event_type END AS event_type, event_type AS stored_type FROM s WHERE event_type <> 'error'
UNION ALL SELECT position, 1, 'payment_made', event_type FROM s WHERE event_type = 'purchase'""",
)


def _hard_limit(ledger: EventLedger) -> DataFrame:
    """For each type, whether a store limited to a fifth of the log refuses to read it whole."""
    fifth = ledger.snapshot().count() // 5
    stream = EventLedger(ledger.spark, ledger.base, hard_limit=fifth).stream(StreamId.any(), every_type())
    found = []
    for kind in TYPES:
        try:
            stream.events(Q.for_events([kind]))
            found.append((kind, False))
        except LimitExceeded:
            found.append((kind, True))
    return ledger.spark.createDataFrame(found, "event_type string, refused boolean")


written("ledger_hard_limit", _hard_limit, "SELECT event_type, count(*) > (SELECT count(*) // 5 FROM log) AS refused FROM log GROUP BY 1")


def _bookmark_files(ledger: EventLedger) -> DataFrame:
    """Bookmarks as one document each, one of them deleted, read back."""
    folder = fresh_folder(ledger.spark, "bookmark-files")
    ends = ledger.snapshot().groupBy("event_type").agg(F.max(F.struct("position", "event_id")).alias("r"))
    for row in ends.collect():  # a row a type
        ledger.place_bookmark(f"reader/{row['event_type']}", EventReference(row["r"]["event_id"], row["r"]["position"], 1), Tags.of(f"of:{row['event_type']}"))
    for mark in ledger.bookmarks():
        jsonio.write_bookmark(folder, mark)
    jsonio.delete_bookmark(folder, "reader/error")
    return jsonio.read_bookmarks(ledger.spark, folder).select("reader", "position", "tx", "event_id", F.array_join("tags", ",").alias("tags"))


written(
    "ledger_bookmark_files", _bookmark_files,
    """SELECT 'reader/' || event_type AS reader, max(position) AS position, CAST(1 AS BIGINT) AS tx, CAST(max(position) - 1 AS VARCHAR) AS event_id, 'of:' || event_type AS tags
FROM log WHERE event_type <> 'error' GROUP BY event_type""",
)


def _resumed(ledger: EventLedger) -> DataFrame:
    """A fold up to the log's middle, then the rest, in pages of 10,000: what each run handled and asked, and where it ended."""
    middle = ledger.snapshot().agg((F.max("position") / 2).cast("long")).first()[0]
    projector = Projector(ledger.stream(StreamId.any(), every_type()), _Totals(("purchase", "error")), batch_size=10_000)
    runs = [projector.run_until(EventReference("x", middle, 1)), projector.run()]
    found = [(i + 1, m.handled, m.queries, m.last.position) for i, m in enumerate(runs)]
    return ledger.spark.createDataFrame(found, "run long, handled long, queries long, last long")


written(
    "ledger_projector_resumed", _resumed,
    """, p AS (SELECT position, CASE WHEN position <= (SELECT CAST(floor(max(position) / 2) AS BIGINT) FROM log) THEN 1::BIGINT ELSE 2 END AS run FROM log WHERE event_type IN ('purchase', 'error'))
SELECT run, count(*) AS handled, count(*) // 10000 + 1 AS queries, max(position) AS last FROM p GROUP BY 1""",
)


class _Poisoned(_Totals):
    def __init__(self, kinds: tuple[str, ...], poison: int):
        super().__init__(kinds)
        self.poison = poison

    def when(self, event) -> None:
        if event.reference.position >= self.poison:
            raise ValueError("poison")
        super().when(event)


def _poison(ledger: EventLedger) -> DataFrame:
    """A projection that fails in the log's second half: which event it names, and the bookmark, which is the end of the last whole page."""
    middle = ledger.snapshot().agg((F.max("position") / 2).cast("long")).first()[0]
    projector = Projector(ledger.stream(StreamId.any(), every_type()), _Poisoned(("view",), middle), batch_size=1_000, bookmark="poisoned")
    try:
        projector.run()
        failed = None
    except ProjectionError as e:
        failed = e.reference.position
    reached = ledger.bookmark("poisoned")
    return ledger.spark.createDataFrame([(failed, reached.position if reached else None)], "failed long, bookmark long")


written(
    "ledger_poison", _poison,
    """, v AS (SELECT position, row_number() OVER (ORDER BY position) AS nth FROM log WHERE event_type = 'view'),
f AS (SELECT min(nth) AS nth, min(position) AS position FROM v WHERE position >= (SELECT CAST(floor(max(position) / 2) AS BIGINT) FROM log))
SELECT f.position AS failed, (SELECT max(position) FROM v WHERE v.nth <= (f.nth - 1) // 1000 * 1000) AS bookmark FROM f""",
)


def _table(ledger: EventLedger) -> DataFrame:
    """A read model in a table, made from the import and brought up to date after appends, by jobs over what is new."""
    stream = ledger.stream(StreamId.any(), every_type())

    def delta(events: DataFrame) -> DataFrame:
        return events.groupBy(R.tag_value("user").alias("user")).agg(F.count("*").alias("n"), F.max("position").alias("last"))

    projector = TableProjector(
        stream, Q.for_events(["click", "view"]), ["user"], delta, {"n": add_up, "last": newest}, fresh_folder(ledger.spark, "read-model"), "per user",
    )
    projector.run()
    shop = ledger.stream(StreamId(SHOP, "u0"), every_type())
    shop.append([EphemeralEvent("click", {}, Tags.of("user:8")), EphemeralEvent("view", {}, Tags.of("user:new")), EphemeralEvent("error", {}, Tags.of("user:8"))])
    projector.run()
    projector.run()
    return projector.table()


written(
    "ledger_table_projection", _table,
    """, seen AS (SELECT substr(list_filter(event_tags, lambda t: starts_with(t, 'user:'))[1], 6) AS "user", position FROM log WHERE event_type IN ('click', 'view')
  UNION ALL SELECT '8', max(position) + 1 FROM log UNION ALL SELECT 'new', max(position) + 2 FROM log)
SELECT "user", count(*) AS n, max(position) AS last FROM seen GROUP BY 1""",
)


def _told(ledger: EventLedger) -> DataFrame:
    """What listeners hear of: each append's reference, where their stream can read it."""
    heard: list[tuple[str, int]] = []
    for name, stream in (("every", StreamId.any()), ("shop", StreamId(SHOP, None)), ("u1", StreamId(None, "u1"))):
        ledger.stream(stream).on_append_eventually(lambda r, name=name: heard.append((name, r.position)))
    for context, purpose in ((SHOP, "u1"), (SHOP, "u2"), (OPS, "u1"), (OPS, "u2")):
        ledger.stream(StreamId(context, purpose), every_type()).append([EphemeralEvent("view", {}), EphemeralEvent("view", {})])
    ledger.close()
    return ledger.spark.createDataFrame(sorted(heard), "listener string, position long")


written(
    "ledger_listeners", _told,
    """, top AS (SELECT max(position) AS p FROM log), h AS (SELECT unnest([('every', 2), ('every', 4), ('every', 6), ('every', 8), ('shop', 2), ('shop', 4), ('u1', 2), ('u1', 6)]) AS pair)
SELECT pair[1] AS listener, p + pair[2] AS position FROM h, top""",
)


def _indexed(ledger: EventLedger) -> DataFrame:
    """Events with both tags, from the files that the tag index names and those written since."""
    ledger.index_tags()
    stream = ledger.stream(StreamId(SHOP, "u0"), every_type())
    stream.append([EphemeralEvent("view", {}, Tags.of("user:8", "big")), EphemeralEvent("view", {}, Tags.of("user:8"))])
    return rows(ledger.stream(StreamId.any(), every_type()).events(Q.for_events(tags=["user:8", "big"])))


written(
    "ledger_tag_index", _indexed,
    f"SELECT {STORED} FROM log WHERE {has('user:8', 'big')} UNION ALL SELECT max(position) + 1, 2, 'view', 'shop#u0', 'big,user:8' FROM log",
)
