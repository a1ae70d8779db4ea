"""Index versions with their enabled fields as typed columns, so that filters, sorts and facets read columns and not JSON.

A record's field gives four columns: its JSON text (null where it is missing), its number, its string, and the JSON
texts of an array's members. The table is partitioned by index version; predicates are comparisons of columns with
literals, which the scan of the files takes over, and answer as structured.predicate() does on the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.operators import structured
from momentlake.operators.structured import Query

_KINDS = {"json": "string", "number": "double", "string": "string", "members": "array<string>"}


def columns_of(path: str) -> dict[str, str]:
    """The columns of a field, by what they hold."""
    return {kind: f"{path.replace('.', '/')}:{kind}" for kind in _KINDS}


def _column(path: str, kind: str) -> Column:
    return F.col(f"`{columns_of(path)[kind]}`")


def project(records: DataFrame, fields: list[str]) -> DataFrame:
    """index_version_id, record_id, start_ms, end_ms and the columns of fields, of records (with data, a variant)."""
    parts = []
    for path in fields:
        v = structured.field(F.col("data"), path)
        text = F.to_json(v)
        number = F.when(text.rlike("^[-0-9]"), text.cast("double"))
        string = F.when(text.startswith('"'), F.try_variant_get(v, "$", "string"))
        members = F.when(text.startswith("["), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))
        parts += [x.alias(columns_of(path)[kind]) for kind, x in zip(_KINDS, (text, number, string, members), strict=True)]
    return records.select("index_version_id", "record_id", "start_ms", "end_ms", *parts)


def predicate(path: str, op: str, value: object) -> Column:
    """structured.predicate() on typed columns."""
    if op not in structured.OPS:
        raise ValueError(f"unknown operator: {op!r}")
    text, number, string, members = (_column(path, kind) for kind in _KINDS)
    literal = structured.literal_text(value)
    if op == "eq":
        return text == literal
    if op == "not_eq":
        return text != literal
    if op == "in":
        return text.isin([structured.literal_text(x) for x in value]) if isinstance(value, list) and value else F.lit(False)
    if op == "contains":
        inside = string.contains(value) if isinstance(value, str) else F.lit(False)
        return inside | F.coalesce(F.array_contains(members, literal), F.lit(False))

    def by(x: Column, y: Column) -> Column:
        return {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]

    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return by(number, F.lit(float(value))) | (number.isNull() & by(text, literal))
    if isinstance(value, str):
        return by(string, F.lit(value)) | (string.isNull() & by(text, literal))
    return by(text, literal)


class TypedIndex:
    """Index versions under a path; all have the same enabled fields."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str]) -> None:
        self.spark, self.path, self.fields = spark, path.rstrip("/"), sorted(set(fields))
        types = [f"`{name}` {_KINDS[kind]}" for f in self.fields for kind, name in columns_of(f).items()]
        self.schema = ", ".join(["record_id {}", "start_ms long", "end_ms long", *types, "index_version_id string"])

    def write(self, records: DataFrame) -> None:
        """Adds versions, or puts them in place of what they were: records of index_version_id, record_id, start_ms, end_ms, data."""
        rows = project(records, self.fields)
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("index_version_id").parquet(f"{self.path}/records")

    def read(self, version: str, id_type: str = "string") -> DataFrame:
        rows = self.spark.read.schema(self.schema.format(id_type)).parquet(f"{self.path}/records")
        return rows.filter(F.col("index_version_id") == version)

    def _enabled(self, used: set[str]) -> None:
        if used - set(self.fields):
            raise ValueError(f"fields not enabled on this index: {sorted(used - set(self.fields))}")

    def filtered(self, rows: DataFrame, filters: tuple[tuple[str, str, object], ...]) -> DataFrame:
        self._enabled({f[0] for f in filters})
        return reduce(lambda df, f: df.filter(predicate(*f)), filters, rows)

    def query(self, rows: DataFrame, query: Query) -> DataFrame:
        """structured.run_query() on rows of read()."""
        self._enabled({s[0] for s in query.sort})
        keys = []
        for path, direction in query.sort:
            text, number, string, _ = (_column(path, kind) for kind in _KINDS)
            rank = F.when(number.isNotNull(), 0).when(string.isNotNull(), 1).otherwise(2)
            for key in (text.isNull(), rank, number, F.when(number.isNull(), F.coalesce(string, text))):
                keys.append(key.asc_nulls_last() if direction == "asc" else key.desc_nulls_first())
        return self.filtered(rows, query.filters).orderBy(*keys, "start_ms", "record_id").limit(query.limit)

    def facet(self, rows: DataFrame, path: str, filters: tuple[tuple[str, str, object], ...] = ()) -> DataFrame:
        """structured.facet() on rows of read()."""
        self._enabled({path})
        text, _, _, members = (_column(path, kind) for kind in _KINDS)
        values = F.when(members.isNotNull(), members).otherwise(F.array(text))
        each = self.filtered(rows, filters).filter(text.isNotNull()).select(F.explode(values).alias("value"))
        return each.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
