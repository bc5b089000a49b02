"""Activity signals of accounts and the report of the most suspicious ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the report, as FIXTURES.md section 6 lists them.
REPORT = (
    "account_screen_name",
    "account_age_days",
    "nb_posts_in_dataset",
    "posts_per_day",
    "account_followers",
    "followers_following_ratio",
    "has_no_description",
    "avg_engagements_per_post",
)


def post_activity(posts: DataFrame) -> DataFrame:
    """Posts and engagements of each account, from ``posts(screen_name, engagements)``."""
    return posts.groupBy("screen_name").agg(
        F.count(F.lit(1)).alias("nb_posts_in_dataset"),
        F.coalesce(F.sum("engagements"), F.lit(0)).alias("engagements"),
    )


def account_profile(posts: DataFrame, accounts: DataFrame, reference_date: Column) -> DataFrame:
    """The report columns of every account that posted.

    ``accounts(screen_name, created_at, lifetime_posts, followers, following,
    description)`` holds each account once; an account it lacks has NULL attributes. The rate covers the whole life of the
    account, not only the posts at hand. Zero age and zero following give NULL.
    Posts are summed before the join, so a busy account is one row in it.
    """
    age = F.datediff(reference_date, "created_at")
    blank = F.coalesce(F.col("description"), F.lit("")).rlike(r"^\s*$")
    return (
        post_activity(posts)
        .join(accounts.withColumn("known", F.lit(True)), "screen_name", "left")
        .withColumn("age", age)
        .select(
            F.col("screen_name").alias("account_screen_name"),
            F.col("age").alias("account_age_days"),
            "nb_posts_in_dataset",
            F.try_divide(F.col("lifetime_posts").cast("double"), "age").alias("posts_per_day"),
            F.col("followers").cast("double").alias("account_followers"),
            F.try_divide(F.col("followers").cast("double"), "following").alias(
                "followers_following_ratio"
            ),
            F.when(F.col("known"), blank).alias("has_no_description"),
            (F.col("engagements").cast("double") / F.col("nb_posts_in_dataset")).alias(
                "avg_engagements_per_post"
            ),
        )
    )


def suspects(
    profile: DataFrame, max_age_days: int = 30, min_posts_per_day: float = 50.0
) -> DataFrame:
    """Young accounts that post at a high rate; both thresholds are exclusive."""
    return profile.filter(
        (F.col("account_age_days") < max_age_days) & (F.col("posts_per_day") > min_posts_per_day)
    )


def top_accounts(profile: DataFrame, limit: int = 20) -> DataFrame:
    """The report: most posts first, then by name."""
    return profile.orderBy(F.desc("nb_posts_in_dataset"), "account_screen_name").limit(limit)


def write_report(report: DataFrame, path: str) -> None:
    """One CSV file with a header; a report is ``limit`` rows, so one task writes it."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
