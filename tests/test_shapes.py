"""Fields of several types: the type they get, their values, and how they are read and written."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockscan.operators.year_slice import PARSED, year_slice
from flockscan.sources import posts, shapes
from flockscan.storage import new_path, save


def kind(text: str) -> T.DataType:
    return T._parse_datatype_string(text)


@pytest.mark.parametrize(
    ("a", "b", "joined"),
    [
        ("int", "bigint", "bigint"),
        ("tinyint", "double", "double"),
        ("float", "double", "double"),
        ("bigint", "double", "variant"),
        ("bigint", "decimal(10,2)", "decimal(21,2)"),
        ("decimal(38,0)", "decimal(10,2)", "variant"),
        ("bigint", "string", "variant"),
        ("boolean", "int", "variant"),
        ("date", "timestamp", "timestamp"),
        ("timestamp", "string", "variant"),
        ("void", "array<int>", "array<int>"),
        ("array<int>", "array<string>", "array<variant>"),
        ("array<int>", "string", "variant"),
        ("map<string,int>", "map<string,bigint>", "map<string,bigint>"),
        ("struct<a:int,b:string>", "struct<b:int,c:date>", "struct<a:int,b:variant,c:date>"),
        ("variant", "int", "variant"),
    ],
)
def test_types_are_joined_without_loss(spark, a, b, joined):
    assert shapes.joined_type(kind(a), kind(b)).simpleString() == joined
    assert shapes.joined_type(kind(b), kind(a)) == shapes.joined_type(kind(a), kind(b)) or joined.startswith("struct")


@pytest.fixture(scope="module")
def mixed(spark):
    numbers = spark.createDataFrame([(2**60 + 1, 1, {"a": 1}, [1, 2])], "id bigint, x int, info map<string,int>, tags array<int>")
    texts = spark.createDataFrame([("12", "a \"b\"", "none", ["é"]), (None, None, None, None)], "ID string, y string, info string, tags array<string>")
    return shapes.one_shape(numbers, texts)


def test_clashing_fields_keep_their_values(mixed):
    assert mixed.columns == ["id", "x", "info", "tags", "y"]
    stored = save(mixed, "mixed").frame
    rows = stored.select(
        shapes.as_text(F.col("id")).alias("id"),
        shapes.as_number(F.col("id")).alias("n"),
        shapes.variant_kind(F.col("id")).alias("kind"),
        shapes.as_text(F.col("info")).alias("info"),
        F.transform("tags", shapes.as_text).alias("tags"),
        "y",
    ).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [
            (str(2**60 + 1), float(2**60 + 1), "BIGINT", '{"a":1}', ["1", "2"], None),
            ("12", 12.0, "STRING", "none", ["é"], 'a "b"'),
            (None, None, None, None, None, None),
        ],
        key=str,
    )


def test_sinks_take_clashing_fields_as_json(spark, mixed):
    flat = {json.loads(r["id"]) if r["id"] else None: r for r in posts.nested_to_json(mixed).collect()}
    assert set(flat) == {2**60 + 1, "12", None}
    assert json.loads(flat["12"]["info"]) == "none" and json.loads(flat[2**60 + 1]["tags"]) == [1, 2]
    path = new_path(spark, "csv")
    posts.write_csv(mixed, path)
    read = posts.read_posts(spark, path, "csv", "id string, x int, info string, tags string, y string")
    assert {r["id"] for r in read.collect()} == {str(2**60 + 1), '"12"', None}


def test_nested_and_empty_batches(spark):
    a = spark.createDataFrame([(1, (1, "x"))], "id int, s struct<n:int,t:string>")
    b = spark.createDataFrame([(2, ("one", True)), (3, None)], "id int, s struct<n:string,u:boolean>")
    both = shapes.one_shape(a, b, a.limit(0))
    rows = both.select("id", shapes.as_text(F.col("s.n")).alias("n"), "s.t", "s.u", F.col("s").isNull().alias("none"))
    assert sorted(map(tuple, rows.collect())) == [(1, "1", "x", None, False), (2, "one", None, True, False), (3, None, None, None, True)]


def test_times_of_several_types(spark):
    ms = spark.createDataFrame([(1, 1_750_000_000_000), (2, None)], "id int, created_at bigint")
    texts = spark.createDataFrame([(3, "2025-03-04"), (4, "soon"), (5, "Wed Oct 10 20:19:24 +0000 2018")], "id int, created_at string")
    times = spark.createDataFrame([(6, dt.datetime(2025, 1, 2))], "id int, created_at timestamp")
    kept = year_slice(shapes.one_shape(ms, texts, times), 2025)
    assert sorted((r["id"], r[PARSED].date().isoformat()) for r in kept.collect()) == [
        (1, "2025-06-15"),
        (3, "2025-03-04"),
        (6, "2025-01-02"),
    ]


def test_a_year_is_replaced_alone(spark):
    path = new_path(spark, "years")
    rows = [(i, dt.datetime(2023 + i % 3, 5, 6)) for i in range(30)] + [(99, None)]
    frame = spark.createDataFrame(rows, "id int, at timestamp")
    posts.write_years(frame, path, "at")
    posts.write_years(frame.filter("id = 1"), path, "at")
    found = {(r["id"], r["year"]) for r in posts.read_posts(spark, path).collect()}
    assert found == {(1, 2024), (99, None)} | {(i, 2023 + i % 3) for i in range(30) if i % 3 != 1}
    # A write that fails leaves the archive as it was.
    broken = frame.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        posts.write_years(broken, path, "at")
    assert {(r["id"], r["year"]) for r in posts.read_posts(spark, path).collect()} == found
