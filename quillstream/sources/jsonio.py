"""The log and bookmarks as JSON files: one document an event, and one a bookmark."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import schema as S

REFERENCE = "struct<id:string,position:bigint,tx:bigint,index:int>"
TAGS = "array<struct<key:string,value:string>>"


def _tag_texts(tags: Column) -> Column:
    """Canonical texts, sorted and distinct; missing tags are none."""
    texts = F.transform(
        F.coalesce(tags, F.array().cast(TAGS)),
        lambda t: F.concat(F.coalesce(t["key"], F.lit("")), F.when(t["value"].isNotNull(), F.concat(F.lit(":"), t["value"])).otherwise(F.lit(""))),
    )
    return F.array_sort(F.array_distinct(F.filter(texts, lambda t: t != "")))


def _tag_objects(texts: Column) -> Column:
    def one(t: Column) -> Column:
        at = F.instr(t, ":")
        key = F.when(at == 0, t).when(at > 1, F.substring(t, F.lit(1), at - 1))
        value = F.when(at > 0, F.substring(t, at + 1, F.length(t)))
        return F.struct(key.alias("key"), F.nullif(value, F.lit("")).alias("value"))

    return F.transform(texts, one)


def read_events(spark: SparkSession, folder: str, ordered: bool = True) -> DataFrame:
    """Rows of the log from a folder of event documents, in the log's order unless that is not asked for; payloads stay JSON text."""
    raw = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True)
    field = lambda path: F.get_json_object("value", path)
    reference = F.from_json(field("$.reference"), REFERENCE)
    rows = raw.select(reference.alias("r"), "value")
    rows = rows.select(
        F.col("r.position").alias("position"), F.col("r.tx").alias("tx"), F.col("r.id").alias("event_id"),
        field("$.idempotencyKey").alias("idempotency_key"),
        field("$.stream.context").alias("stream_context"), field("$.stream.purpose").alias("stream_purpose"),
        field("$.type").alias("event_type"), field("$.timestamp").cast("timestamp").alias("event_timestamp"),
        field("$.immutableData").alias("event_data"), field("$.erasableData").alias("event_erasable_data"),
        _tag_texts(F.from_json(field("$.tags"), TAGS)).alias("event_tags"),
        F.coalesce("r.index", F.lit(0)).alias("index"),
    )
    return rows.orderBy("tx", "position", "index") if ordered else rows


def event_json(index: Column | None = None) -> Column:
    """The document of a row. Payloads are embedded as JSON, not as text."""
    head = F.to_json(
        F.struct(
            F.struct(F.col("stream_context").alias("context"), F.col("stream_purpose").alias("purpose")).alias("stream"),
            F.col("event_type").alias("type"),
            F.struct(
                F.col("event_id").alias("id"), F.col("position").alias("position"), F.col("tx").alias("tx"),
                (F.lit(0) if index is None else index).alias("index"),
            ).alias("reference"),
            _tag_objects(F.col("event_tags")).alias("tags"),
            F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.col("idempotency_key").alias("idempotencyKey"),
        )
    )
    body = F.concat(F.lit(',"immutableData":'), F.coalesce("event_data", F.lit("null")))
    erasable = F.when(F.col("event_erasable_data").isNotNull(), F.concat(F.lit(',"erasableData":'), F.col("event_erasable_data"))).otherwise(F.lit(""))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), body, erasable, F.lit("}"))


def _padded(number: str, size: int) -> Column:
    """A number's digits, with zeros in front up to a size; longer ones stay whole."""
    digits = F.col(number).cast("string")
    return F.when(F.length(digits) >= size, digits).otherwise(F.lpad(digits, size, "0"))


def file_name() -> Column:
    """tx(10)-position(5)-index-timestamp.json"""
    return F.concat_ws(
        "-", _padded("tx", 10), _padded("position", 5), F.lit("0"),
        F.date_format("event_timestamp", "yyyy-MM-dd-HH-mm-ss-SSSS"),
    )


def write_events(events: DataFrame, folder: str) -> None:
    """Export: JSON lines, one document a row, in as many files as there are partitions."""
    events.select(event_json().alias("value")).write.mode("overwrite").text(folder)


def write_event_files(events: DataFrame, folder: str) -> int:
    """Export of a small log to a local folder, one file an event, as the file-based store keeps it; a file that exists is an error."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in events.select(file_name().alias("name"), event_json().alias("value")).toLocalIterator():
        with open(os.path.join(folder, f"{row['name']}.json"), "x", encoding="utf-8") as file:
            file.write(row["value"])
        n += 1
    return n


def read_events_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The log from an export of JSON lines."""
    return spark.read.text(folder).select("value").transform(lambda raw: _parse(raw))


def _parse(raw: DataFrame) -> DataFrame:
    field = lambda path: F.get_json_object("value", path)
    return raw.select(
        field("$.reference.position").cast("long").alias("position"), field("$.reference.tx").cast("long").alias("tx"),
        field("$.reference.id").alias("event_id"), field("$.idempotencyKey").alias("idempotency_key"),
        field("$.stream.context").alias("stream_context"), field("$.stream.purpose").alias("stream_purpose"),
        field("$.type").alias("event_type"), field("$.timestamp").cast("timestamp").alias("event_timestamp"),
        field("$.immutableData").alias("event_data"), field("$.erasableData").alias("event_erasable_data"),
        _tag_texts(F.from_json(field("$.tags"), TAGS)).alias("event_tags"),
    )


def safe_name(reader: str) -> str:
    return re.sub(r"[^a-zA-Z0-9._-]", "_", reader)


def write_bookmark(folder: str, bookmark) -> str:
    """One file a reader."""
    os.makedirs(folder, exist_ok=True)
    r = bookmark.reference
    path = os.path.join(folder, f"{safe_name(bookmark.reader)}.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(
            {
                "reader": bookmark.reader, "reference": {"id": r.id, "position": r.position, "tx": r.tx, "index": r.index},
                "tags": [{"key": t.key, "value": t.value} for t in sorted(bookmark.tags, key=str)], "updatedAt": bookmark.updated_at.isoformat(),
            },
            file,
        )
    return path


def delete_bookmark(folder: str, reader: str) -> None:
    path = os.path.join(folder, f"{safe_name(reader)}.json")
    if os.path.exists(path):
        os.unlink(path)


def read_bookmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Bookmarks from a folder of documents; missing tags are none, a missing time is the epoch."""
    raw = spark.read.schema(f"reader string, reference {REFERENCE}, tags {TAGS}, updatedAt timestamp").option("multiLine", True).json(f"{folder.rstrip('/')}/*.json")
    return raw.select(
        "reader", F.col("reference.position").alias("position"), F.col("reference.tx").alias("tx"), F.col("reference.id").alias("event_id"),
        F.coalesce("reference.index", F.lit(0)).alias("index"), _tag_texts(F.col("tags")).alias("tags"),
        F.coalesce("updatedAt", F.timestamp_seconds(F.lit(0))).alias("updated_at"),
    )


def validate_events(df: DataFrame) -> None:
    S.validate(df.drop("index"), S.EVENTS)
