from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flockscan.operators import accounts

TODAY = dt.date(2025, 3, 1)
# The figures of the first five rows are those of the report in FIXTURES.md
# section 6, under other names.
# name, age, lifetime posts, followers, following, description, posts, engagements
PEOPLE = [
    ("anna", 27, 3519, 111, 156, "hello", 8, 90),
    ("bert", 21, 1443, 85, 319, "hi", 8, 2),
    ("carl", 5, 290, 335, 341, "x", 4, 8),
    ("dora", 29, 2825, 13, 33, " \n\t", 4, 4),
    ("emil", 23, 3235, 285, 209, "y", 4, 21),
    ("fred", 0, 10, 1, 0, None, 1, 0),
    ("gina", 400, 99999, 5, 5, "old", 3, 3),
    ("hugo", 20, 100, 5, 5, "slow", 3, 3),
]


@pytest.fixture(scope="module")
def profile(spark):
    people = spark.createDataFrame(
        [
            (n, dt.datetime.combine(TODAY - dt.timedelta(days=a), dt.time(13)), p, f, g, d)
            for n, a, p, f, g, d, _, _ in PEOPLE
        ]
        + [("silent", dt.datetime(2025, 1, 1), 5, 5, 5, "never posted")],
        "screen_name string, created_at timestamp, lifetime_posts bigint, followers bigint, "
        "following bigint, description string",
    )
    posts = [(n, e if i == 0 else 0) for n, *_, k, e in PEOPLE for i in range(k)]
    posts.append(("unlisted", 3))
    table = spark.createDataFrame(posts, "screen_name string, engagements bigint")
    return accounts.account_profile(table, people, F.lit(TODAY))


def test_profile_formulas(profile):
    assert tuple(profile.columns) == accounts.REPORT
    got = {r["account_screen_name"]: r for r in profile.collect()}
    assert set(got) == {p[0] for p in PEOPLE} | {"unlisted"}
    unlisted = got.pop("unlisted")
    assert tuple(unlisted) == ("unlisted", None, 1, None, None, None, None, 3.0)
    anna = got["anna"]
    assert anna["posts_per_day"] == pytest.approx(130.33333333333334)
    assert anna["followers_following_ratio"] == pytest.approx(0.7115384615384616)
    assert anna["avg_engagements_per_post"] == 11.25
    assert (anna["account_age_days"], anna["nb_posts_in_dataset"]) == (27, 8)
    assert anna["account_followers"] == 111.0
    assert got["emil"]["followers_following_ratio"] == pytest.approx(1.3636363636363635)
    assert {n for n, r in got.items() if r["has_no_description"]} == {"dora", "fred"}
    assert got["fred"]["posts_per_day"] is None
    assert got["fred"]["followers_following_ratio"] is None


def test_report_order_filter_and_sink(spark, profile, tmp_path):
    report = accounts.top_accounts(accounts.suspects(profile), 4)
    names = [r["account_screen_name"] for r in report.collect()]
    assert names == ["anna", "bert", "carl", "dora"]
    path = str(tmp_path / "report")
    accounts.write_report(report, path)
    back = spark.read.option("header", True).csv(path)
    assert tuple(back.columns) == accounts.REPORT
    assert [r[0] for r in back.collect()] == names
    assert len(list((tmp_path / "report").glob("part-*.csv"))) == 1
