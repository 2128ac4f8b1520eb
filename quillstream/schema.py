"""Fixed schemas of the log, of bookmarks and of the read model, and the check of a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(text: str, required: str = "") -> T.StructType:
    need = set(required.split())
    pairs = [column.split() for column in text.split(", ")]
    return T.StructType([T.StructField(name, KINDS[kind], name not in need) for name, kind in pairs])


EVENTS = _struct(
    "position long, tx long, event_id string, idempotency_key string, stream_context string, stream_purpose string, "
    "event_type string, event_timestamp timestamp, event_data string, event_erasable_data string, event_tags array<string>",
    "position tx event_id stream_context stream_purpose event_type event_timestamp event_data event_tags",
)
BOOKMARKS = _struct(
    "reader string, position long, tx long, event_id string, index int, tags array<string>, updated_at timestamp, removed boolean, version long",
    "reader version",
)
READ_MODEL = _struct(
    "id long, event_id string, event_position long, processed_at timestamp, readmodel_tx long, readmodel_thread string"
)


class SchemaError(Exception):
    pass


def validate(df: DataFrame, expected: T.StructType) -> None:
    """Raise unless df has every column of expected with its type; further columns are allowed."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}, not {f.dataType.simpleString()}" for f in expected if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaError("; ".join(map(str, wrong)))
