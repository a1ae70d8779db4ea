"""Structured queries over JSON records: filters, sorts, facets. Fields are dotted paths into a variant column."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "not_eq", "in", "gt", "gte", "lt", "lte", "contains")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*(\.[A-Za-z_][A-Za-z0-9_-]*)*")


def field(data: Column, path: str) -> Column:
    """The value at a dotted path, as variant; null where it is missing. Paths walk objects only."""
    if not _NAME.fullmatch(path):
        raise ValueError(f"unsafe field name: {path!r}")
    return F.try_variant_get(data, "$" + "".join(f"['{k}']" for k in path.split(".")), "variant")


def _text(v: Column) -> Column:
    return F.to_json(v)


def literal_text(value: object) -> Column:
    """The JSON text of a value, as records' values are compared by it."""
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _compare(v: Column, value: object, op: str) -> Column:
    """Numbers by value, strings bytewise, booleans; other pairs by their JSON text."""

    def by(x: Column, y: Column) -> Column:
        return {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]

    json_text = _text(v)  # its first character tells the kind
    text = by(json_text, literal_text(value))
    if isinstance(value, bool):
        return text  # false sorts before true, as their texts do
    if isinstance(value, (int, float)):
        return F.when(json_text.rlike("^[-0-9]"), by(json_text.cast("double"), F.lit(float(value)))).otherwise(text)
    if isinstance(value, str):
        return F.when(json_text.startswith('"'), by(F.try_variant_get(v, "$", "string"), F.lit(value))).otherwise(text)
    return text


def predicate(data: Column, path: str, op: str, value: object) -> Column:
    """A missing field makes every predicate false, not_eq too."""
    if op not in OPS:
        raise ValueError(f"unknown operator: {op!r}")
    v = field(data, path)
    if op == "eq":
        out = _text(v) == literal_text(value)
    elif op == "not_eq":
        out = _text(v) != literal_text(value)
    elif op == "in":
        out = _text(v).isin([literal_text(x) for x in value]) if isinstance(value, list) and value else F.lit(False)
    elif op == "contains":
        members = F.transform(F.try_variant_get(v, "$", "array<variant>"), _text)
        is_array = F.schema_of_variant(v).startswith("ARRAY")
        inside = F.contains(F.try_variant_get(v, "$", "string"), F.lit(value)) if isinstance(value, str) else F.lit(False)
        out = F.when(is_array, F.array_contains(members, literal_text(value))).otherwise(inside & (F.schema_of_variant(v) == "STRING"))
    else:
        out = _compare(v, value, op)
    return F.coalesce(v.isNotNull() & out, F.lit(False))


@dataclass(frozen=True)
class Query:
    """filters: (field, op, value), all of which must hold; sort: (field, "asc" or "desc"); limit after sorting."""

    filters: tuple[tuple[str, str, object], ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    limit: int = 100


def sort_keys(data: Column, sort: tuple[tuple[str, str], ...]) -> list[Column]:
    """Numbers, then strings, then the rest by JSON text; a missing field comes last ascending and first descending."""
    keys = []
    for path, direction in sort:
        v = field(data, path)
        kind = F.schema_of_variant(v)
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(_text(v))
        missing, rank = v.isNull(), F.when(number.isNotNull(), 0).when(kind == "STRING", 1).otherwise(2)
        for key in (missing, rank, number, F.when(number.isNull(), text)):
            keys.append(key.asc_nulls_last() if direction == "asc" else key.desc_nulls_first())
    return keys


def run_query(records: DataFrame, query: Query, enabled: set[str] | None = None) -> DataFrame:
    """Filters, sorts and cuts records (data variant, start_ms, record_id); ties go by start_ms, record_id. enabled: fields the index allows."""
    used = {f[0] for f in query.filters} | {s[0] for s in query.sort}
    if enabled is not None and used - enabled:
        raise ValueError(f"fields not enabled on this index: {sorted(used - enabled)}")
    for path, op, value in query.filters:
        records = records.filter(predicate(F.col("data"), path, op, value))
    return records.orderBy(*sort_keys(F.col("data"), query.sort), "start_ms", "record_id").limit(query.limit)


def facet(records: DataFrame, path: str, filters: tuple[tuple[str, str, object], ...] = ()) -> DataFrame:
    """value (JSON text), count: members of arrays count each, missing fields not, JSON null does; by count, then value."""
    for name, op, value in filters:
        records = records.filter(predicate(F.col("data"), name, op, value))
    v = field(F.col("data"), path)
    is_array = F.schema_of_variant(v).startswith("ARRAY")
    values = F.when(is_array, F.transform(F.try_variant_get(v, "$", "array<variant>"), _text)).otherwise(F.array(_text(v)))
    each = records.filter(v.isNotNull()).select(F.explode(values).alias("value"))
    return each.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
