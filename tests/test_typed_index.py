import itertools
import re

import pytest
from pyspark.sql import functions as F

from momentlake.operators import structured
from momentlake.operators.structured import Query
from momentlake.operators.typed_index import TypedIndex, predicate

VALUES = ['1', '1.5', '-3', '1e3', '"1"', '"abc"', '"a\\"b"', '""', 'true', 'false', 'null', '[]', '[1, "a", null]', '["abc"]', '{"b": 1}', '12345678901234567890', None]
FIELDS = ["f", "o.g"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"r{i:02d}", i % 5, i % 5 + 1, "{" + ", ".join(x for x in (a and f'"f": {a}', b and f'"o": {{"g": {b}}}') if x) + "}") for i, (a, b) in enumerate(zip(VALUES, VALUES[3:] + VALUES[:3], strict=True))]
    df = spark.createDataFrame(rows, "record_id string, start_ms long, end_ms long, json string").withColumn("data", F.parse_json("json")).drop("json")
    store = TypedIndex(spark, str(tmp_path_factory.mktemp("typed")), FIELDS)
    store.write(df.withColumn("index_version_id", F.lit("v1")))
    store.write(df.limit(3).withColumn("index_version_id", F.lit("v2")))
    store.write(df.limit(2).withColumn("index_version_id", F.lit("v2")))
    return store, df


def ids(df):
    return [r.record_id for r in df.collect()]


def test_same_answers_as_on_records(index):
    store, df = index
    rows = store.read("v1")
    assert store.read("v2").count() == 2 and rows.count() == len(VALUES)
    asked = [("f", op, v) for op, v in itertools.product(("eq", "not_eq", "gt", "lte"), (1, 1.5, "abc", "1", True, None, [1, "a", None]))]
    asked += [("o.g", "in", [1, "abc", None]), ("f", "in", []), ("f", "in", 3), ("f", "contains", "a"), ("f", "contains", 1), ("f", "contains", None)]
    ours = [F.coalesce(predicate(*a), F.lit(False)).alias(f"c{k}") for k, a in enumerate(asked)]
    theirs = [structured.predicate(F.col("data"), *a).alias(f"c{k}") for k, a in enumerate(asked)]
    got = {r.record_id: r[1:] for r in rows.select("record_id", *ours).collect()}
    want = {r.record_id: r[1:] for r in df.select("record_id", *theirs).collect()}
    for i, values in want.items():
        assert [a for a, x, y in zip(asked, got[i], values, strict=True) if x != y] == [], (i, VALUES[int(i[1:])])
    for sort in ((("f", "asc"),), (("f", "desc"), ("o.g", "asc"))):
        assert ids(store.query(rows, Query((), sort))) == ids(structured.run_query(df, Query((), sort)))
    for path in FIELDS:
        assert store.facet(rows, path).collect() == structured.facet(df, path).collect()
    with pytest.raises(ValueError, match="not enabled"):
        store.filtered(rows, (("x", "eq", 1),))
    with pytest.raises(ValueError, match="unknown operator"):
        store.filtered(rows, (("f", "like", 1),))


def test_filters_reach_the_scan(spark, index, capsys):
    store, _ = index
    df = store.filtered(store.read("v1"), (("f", "gte", 1), ("o.g", "eq", "abc"), ("f", "lt", "b"))).select("record_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df.explain("formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = capsys.readouterr().out
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", plan)[1]
    assert "GreaterThanOrEqual(`f:number`,1.0)" in pushed and "EqualTo(`o/g:json`," in pushed and "LessThan(`f:string`,b)" in pushed
    assert "index_version_id" in re.search(r"PartitionFilters: \[(.*?)\]\n", plan)[1]
    assert "members" not in re.search(r"ReadSchema: (.*)", plan)[1]
