from __future__ import annotations

import datetime as dt
import json

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockscan.operators.text_column import guess_slice_text_column, guess_text_column
from flockscan.functions.times import text_to_time
from flockscan.operators.year_slice import PARSED, TimeColumn, guess_time_column, with_time, year_slice
from flockscan.plans.archive import slice_archive
from flockscan.sources import posts, shapes

TIMES = {
    "datetime": ("post_created_at timestamp", dt.datetime(2025, 1, 1), "2025-01-01 00:00:00"),
    "datetime without zone": ("date timestamp_ntz", dt.datetime(2025, 1, 1), "2025-01-01 00:00:00"),
    "date": ("date date", dt.date(2025, 1, 1), "2025-01-01 00:00:00"),
    "ms": ("created_at_ms bigint", 1735689600000, "2025-01-01 00:00:00"),
    "ms as float": ("timestamp double", 1735689600000.0, "2025-01-01 00:00:00"),
    "null ms": ("created_at_ms bigint", None, "1970-01-01 00:00:00"),
    "nan ms": ("created_at_ms double", float("nan"), "1970-01-01 00:00:00"),
    "infinite ms": ("created_at_ms double", float("inf"), None),
    "seconds read as ms": ("created_at_ts bigint", 1735689600, "1970-01-21 02:08:09.6"),
    "out of range": ("created_at_ms bigint", 10**17, None),
    "iso text": ("created_at string", "2025-01-02 10:00:00", "2025-01-02 10:00:00"),
    "iso text with zone": ("created_at string", "2025-01-02T10:00:00.5+02:00", "2025-01-02 08:00:00.5"),
    "platform text": ("created_at string", "Wed Oct 10 20:19:24 +0000 2025", "2025-10-10 20:19:24"),
    "slashes": ("created_at string", "10/12/2025 09:30", "2025-10-12 09:30:00"),
    "one digit slashes": ("created_at string", "1/2/2025", "2025-01-02 00:00:00"),
    "year first slashes": ("created_at string", "2025/10/12 09:30:15", "2025-10-12 09:30:15"),
    "day first words": ("created_at string", "5 Oct 2025", "2025-10-05 00:00:00"),
    "month first words": ("created_at string", "Oct 15 2025 8:15", "2025-10-15 08:15:00"),
    "one digit platform day": ("created_at string", "Wed Oct 1 20:19:24 +0200 2025", "2025-10-01 18:19:24"),
    "day first slashes": ("created_at string", "25/12/2025", "2025-12-25 00:00:00"),
    "day first slashes with clock": ("created_at string", "25/12/2025 10:00:00", "2025-12-25 10:00:00"),
    "digits only": ("created_at string", "20250102", "2025-01-02 00:00:00"),
    "year and month": ("created_at string", "2025-10", "2025-10-01 00:00:00"),
    "comma": ("created_at string", "Oct 10, 2025", "2025-10-10 00:00:00"),
    "whole month name": ("created_at string", "10 October 2025", "2025-10-10 00:00:00"),
    "mail": ("created_at string", "Wed, 10 Oct 2025 20:19:24 GMT", "2025-10-10 20:19:24"),
    "fraction": ("created_at string", "2025/01/02 10:00:00.123", "2025-01-02 10:00:00.123"),
    "afternoon": ("created_at string", "12/25/2025 01:05 PM", "2025-12-25 13:05:00"),
    "no such day": ("created_at string", "13/45/2025", None),
    "bad text": ("created_at string", "x", None),
    "clock only": ("created_at string", "10:00", None),
    "year only": ("created_at string", "2025", None),
    "null text": ("created_at string", None, None),
}


@pytest.mark.parametrize("case", TIMES)
def test_time_of_each_kind(spark, case):
    schema, value, want = TIMES[case]
    df = spark.createDataFrame([(value,)], schema)
    chosen = guess_time_column(df)
    assert chosen.name == df.columns[0]
    assert with_time(df, chosen).select(F.col(PARSED).cast("string")).first()[0] == want


def test_day_may_come_first(spark):
    df = spark.createDataFrame([("10/12/2025",), ("12/25/2025",)], "t string")
    read = df.select(text_to_time(F.col("t"), day_first=True).cast("date")).collect()
    assert [str(r[0]) for r in read] == ["2025-12-10", "2025-12-25"]


def test_nanoseconds_keep_their_digits(spark):
    chosen = TimeColumn("n", T.LongType(), nanoseconds=True)
    df = spark.createDataFrame([(1735689600123456999,), (-1,)], "n bigint")
    read = df.select(chosen.value().cast("string")).collect()
    assert [r[0] for r in read] == ["2025-01-01 00:00:00.123456", "1969-12-31 23:59:59.999999"]


def test_texts_survive_csv(spark, tmp_path):
    rows = [
        (1, ' lead\n"q",x\\ ', ""),
        (2, None, "a"),
        (3, "\r\nz\r", None),
        (4, '\\"', " "),
        (5, "", '""'),
        (6, "a,b\n\n,c", "NULL"),
    ]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    path = str(tmp_path / "csv")
    posts.write_csv(df, path)
    assert sorted(map(tuple, posts.read_posts(spark, path, "csv", df.schema).collect())) == rows
    inferred = posts.read_posts(spark, path, "csv")
    assert sorted(map(tuple, inferred.collect())) == rows


def test_null_fields_stay_in_json(spark):
    df = spark.createDataFrame([((None, "x"),)], "s struct<a: int, b: string>")
    assert posts.nested_to_json(df).first()[0] == '{"a":null,"b":"x"}'


def test_layouts_may_mix_in_one_column(spark):
    df = spark.createDataFrame(
        [("2025-03-01",), ("Wed Oct 10 20:19:24 +0000 2025",), ("y",)], "created_at string"
    )
    assert year_slice(df, 2025).count() == 2


def test_time_column_priority(spark):
    df = spark.createDataFrame([("2020-01-01", "2025-01-01")], "date string, created_at string")
    assert guess_time_column(df).name == "created_at"
    # A named column is final even when nothing in it parses.
    df = spark.createDataFrame([("x", "2025-01-01")], "created_at string, other string")
    assert guess_time_column(df).name == "created_at"
    assert year_slice(df, 2025).isEmpty()


def test_time_column_fallback(spark):
    row = (1875000000000000000, "no", "2025-05-05", dt.datetime(2024, 1, 1))
    df = spark.createDataFrame([row], "post_id bigint, a string, b string, c timestamp")
    assert guess_time_column(df).name == "b"
    flagged = guess_time_column(df, numeric_fallback_ns=True)
    assert flagged.name == "post_id"
    assert with_time(df, flagged).select(F.year(PARSED)).first()[0] == 2029
    assert year_slice(df, 2029, numeric_fallback_ns=True).count() == 1


def test_no_time_column_gives_an_empty_slice(spark):
    df = spark.createDataFrame([(1, "x")], "n bigint, s string")
    kept = year_slice(df, 2025)
    assert kept.columns == ["n", "s"] and kept.isEmpty()
    assert guess_time_column(spark.createDataFrame([(1,)], "n bigint")) is None


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_slice_of_epochs_in_any_zone(spark, zone):
    hours = [1735689600000 + h * 3_600_000 for h in range(-30, 30)]
    df = spark.createDataFrame([(h,) for h in hours] + [(None,)], "created_at_ms bigint")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        kept = year_slice(df, 2025).count()
        want = df.filter(F.year(F.timestamp_millis("created_at_ms")) == 2025).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert kept == want > 0
    assert year_slice(df, 1970).count() == 1


def test_year_range_reaches_the_scan(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = plan_of(year_slice(orders, 1997))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in plan
    assert "LessThan(o_orderdate,1998-01-01" in plan
    path = str(tmp_path / "ms")
    spark.range(10).select((F.col("id") * 10**11).alias("created_at_ms")).write.parquet(path)
    plan = plan_of(year_slice(spark.read.parquet(path), 1997))
    assert "GreaterThanOrEqual(created_at_ms" in plan and "LessThan(created_at_ms" in plan


TEXTS = {
    "names in order": ("text string, full_text string", ("a", "b"), "full_text"),
    "longest": ("a string, b string", ("x" * 41, "y" * 2110), "b"),
    "exactly ten": ("a string", ("x" * 10,), None),
    "eleven": ("a string", ("x" * 11,), "a"),
    "ties go left": ("a string, b string", ("x" * 20, "y" * 20), "a"),
    "all null first": ("a string, b string", (None, "y" * 20), "b"),
    "only nulls": ("a string", (None,), None),
    "no text": ("n bigint", (1,), None),
}


@pytest.mark.parametrize("case", TEXTS)
def test_text_column(spark, case):
    schema, row, want = TEXTS[case]
    assert guess_text_column(spark.createDataFrame([row], schema)) == want


def test_text_column_of_slice_or_whole(spark):
    whole = spark.createDataFrame([("x" * 30, "y" * 20), ("x" * 5, "y" * 20)], "a string, b string")
    assert guess_slice_text_column(whole.filter("length(a) = 5"), whole) == "b"
    assert guess_slice_text_column(whole.limit(0), whole) == "b"


@pytest.fixture
def nested(spark):
    rows = [(1, ("n", [1, 2]), ["a", "b"], {"k": 1}, dt.datetime(2025, 6, 1)), (2, None, [], None, dt.datetime(2024, 6, 1))]
    return spark.createDataFrame(
        rows,
        "id bigint, who struct<name:string,l:array<int>>, tags array<string>, m map<string,int>, date timestamp",
    )


def test_nested_cells_become_json(nested):
    flat = {r["id"]: r for r in posts.nested_to_json(nested).collect()}
    assert json.loads(flat[1]["who"]) == {"name": "n", "l": [1, 2]}
    assert json.loads(flat[1]["tags"]) == ["a", "b"] and json.loads(flat[1]["m"]) == {"k": 1}
    assert flat[2]["who"] is None and flat[2]["tags"] == "[]"


def test_archive_slice_and_sinks(spark, nested, tmp_path):
    made = slice_archive(
        nested, 2025, str(tmp_path / "csv"), "tweets_of_test", str(tmp_path / "table")
    )
    assert made.rows == 1 and made.text_column is None
    back = posts.read_posts(spark, str(tmp_path / "csv"), "csv")
    assert back.columns == made.posts.columns
    assert back.first()["tags"] == '["a","b"]'
    table = spark.table("tweets_of_test")
    assert [r["id"] for r in table.collect()] == [1]
    # Writing again replaces the table.
    posts.write_table(nested, "tweets_of_test", str(tmp_path / "table2"))
    assert spark.table("tweets_of_test").count() == 2
    spark.sql("DROP TABLE tweets_of_test")


def test_reading_mixed_records(spark, tmp_path):
    path = tmp_path / "posts.json"
    path.write_text('{"id": 1, "text": "a"}\n{"id": 2, "lang": "fr", "u": {"n": 3}}\n', encoding="utf8")
    read = posts.read_posts(spark, str(path), "json")
    assert sorted(read.columns) == ["id", "lang", "text", "u"]
    assert [r["text"] for r in read.orderBy("id").collect()] == ["a", None]
    one, two = str(tmp_path / "p1"), str(tmp_path / "p2")
    spark.range(2).write.parquet(one)
    spark.range(2).withColumn("x", F.lit("v")).write.parquet(two)
    assert posts.read_posts(spark, [one, two]).filter("x is null").count() == 2
    with pytest.raises(ValueError, match="pickle"):
        posts.read_posts(spark, one, "pickle")


def test_one_shape_and_preview(spark):
    a = spark.createDataFrame([(1, "x")], "id bigint, text string")
    b = spark.createDataFrame([(2, True)], "id bigint, seen boolean")
    assert sorted(map(tuple, shapes.one_shape(a, b).collect())) == [(1, "x", None), (2, None, True)]
    wide = spark.range(1).select(*(F.lit(i).alias(f"c{i}") for i in range(60)))
    assert posts.column_preview(wide) == [f"c{i}" for i in range(50)]


def test_fill_cores_leaves_large_scans_alone(spark, monkeypatch):
    few = spark.range(10).coalesce(1)
    assert posts.fill_cores(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(posts, "FILL_BYTES", 8)
    assert posts.fill_cores(few) is few
