"""Payloads: typed and raw decoding, deep merge of erasable data, and routing of new payloads.

Payloads rest as JSON text. Erasable fields carry metadata {"erasable": True}, partly erasable
structs {"erasable": "partly"}; they are stored apart, so erasing personal data leaves the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def erasable(name: str, kind: T.DataType, partly: bool = False) -> T.StructField:
    return T.StructField(name, kind, True, {"erasable": "partly" if partly else True})


def merge(kept: Any, erased: Any) -> Any:
    """Objects merge field by field; anything else, null included, is replaced by the second."""
    if isinstance(kept, dict) and isinstance(erased, dict):
        out = dict(kept)
        for name, value in erased.items():
            out[name] = merge(kept[name], value) if name in kept else value
        return out
    return erased


def merged_json(data: str | None, erasable_data: str | None) -> str | None:
    if not erasable_data:
        return data
    return json.dumps(merge(json.loads(data or "{}"), json.loads(erasable_data)), separators=(",", ":"), ensure_ascii=False)


def deep_merge(data: Column, erasable_data: Column) -> Column:
    """Merged JSON where the schema is not known. Rows without erasable data never reach Python's parser."""
    udf = F.pandas_udf(lambda a, b: pd.Series([merged_json(x, y) for x, y in zip(a, b, strict=True)]), "string")
    return F.when(erasable_data.isNull(), data).otherwise(udf(data, erasable_data))


def merge_by_schema(data: Column, erasable_data: Column, schema: T.StructType) -> Column:
    """Merged struct where the schema is known: field by field, inside generated code."""

    def fields(a: Column, b: Column, kind: T.StructType) -> Column:
        out = []
        for f in kind.fields:
            route = f.metadata.get("erasable")
            if route == "partly" and isinstance(f.dataType, T.StructType):
                value = fields(a[f.name], b[f.name], f.dataType)
                value = F.when(a[f.name].isNotNull() | b[f.name].isNotNull(), value)
            else:
                value = b[f.name] if route else a[f.name]
            out.append(value.alias(f.name))
        return F.struct(*out)

    return fields(F.from_json(data, schema), F.from_json(F.coalesce(erasable_data, F.lit("{}")), schema), schema)


def known_fields(data: Column, schema: T.StructType, type_name: str) -> Column:
    """data, or an error where it has a field that the schema lacks; missing fields are null."""
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    extra = F.array_except(F.coalesce(F.json_object_keys(data), F.array().cast("array<string>")), names)
    complaint = F.concat(F.lit(f"Failed to deserialize event data of {type_name}: unknown "), F.array_join(extra, ", "))
    return F.when(F.size(extra) > 0, F.raise_error(complaint).cast("string")).otherwise(data)


def decode(df: DataFrame, schema: T.StructType, type_name: str, data: str = "event_data", strict: bool = True) -> DataFrame:
    """df with a column data of the declared struct."""
    text = known_fields(F.col(data), schema, type_name) if strict else F.col(data)
    return df.withColumn("data", F.from_json(text, schema))


def decode_raw(df: DataFrame, data: str = "event_data") -> DataFrame:
    """df with a variant column data: payloads whose types are not registered."""
    return df.withColumn("data", F.parse_json(data))


def split_payload(payload: dict[str, Any], schema: T.StructType | None) -> tuple[str, str | None]:
    """(immutable JSON, erasable JSON or None) of a new payload, by the schema's metadata."""

    def route(value: dict[str, Any], kind: T.StructType) -> tuple[dict, dict]:
        kept, erased = {}, {}
        by_name = {f.name: f for f in kind.fields}
        for name, x in value.items():
            f = by_name.get(name)
            how = f.metadata.get("erasable") if f else None
            if how == "partly" and isinstance(f.dataType, T.StructType) and isinstance(x, dict):
                a, b = route(x, f.dataType)
                kept[name] = a
                if b:
                    erased[name] = b
            elif how:
                erased[name] = x
            else:
                kept[name] = x
        return kept, erased

    kept, erased = route(payload, schema) if schema is not None else (payload, {})
    return dump(kept), dump(erased) if erased else None


def dump(value: Any) -> str:
    """JSON text of a payload; fails on what JSON cannot hold."""
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=_plain, allow_nan=False)
    json.loads(text)
    return text


def _plain(value: Any) -> Any:
    import datetime
    import decimal

    if isinstance(value, decimal.Decimal):
        return float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    raise TypeError(f"not JSON: {value!r}")


def erased_fields(schema: T.StructType) -> Iterable[str]:
    return [f.name for f in schema.fields if f.metadata.get("erasable")]
