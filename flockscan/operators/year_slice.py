"""Finding the time column of a post table and keeping one calendar year."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockscan.functions import times

# Usual names of the time column, the first one present wins.
TIME_NAMES = (
    "post_created_at",
    "created_at",
    "created_at_ms",
    "created_at_ts",
    "date",
    "timestamp",
    "source_date",
)
PARSED = "_parsed_created_at"


@dataclass(frozen=True)
class TimeColumn:
    """The chosen column; ``nanoseconds`` when a number was taken as such by the fallback."""

    name: str
    kind: T.DataType
    nanoseconds: bool = False

    def value(self) -> Column:
        column = F.col(f"`{self.name}`")
        if self.nanoseconds:
            # Whole division, rounded down, as a double has too few digits.
            return F.expr(f"timestamp_micros((bigint(`{self.name}`) - pmod(bigint(`{self.name}`), 1000)) div 1000)")
        return times.to_time(column, self.kind)


def _fallback_time(column: Column, kind: T.DataType) -> Column:
    if times.is_number(kind):
        # Every finite number is some time when read as nanoseconds.
        return F.when(F.abs(column.cast("double")) <= 9.2e18, column)
    return times.to_time(column, kind)


def parse_counts(df: DataFrame, numeric_fallback_ns: bool = False) -> DataFrame:
    """One row: for each column that could hold times, how many of its values do."""
    return df.agg(
        *(
            F.count(_fallback_time(F.col(f"`{f.name}`"), f.dataType)).alias(f.name)
            for f in _fallback_fields(df, numeric_fallback_ns)
        )
    )


def _fallback_fields(df: DataFrame, numeric_fallback_ns: bool) -> list[T.StructField]:
    return [
        f
        for f in df.schema.fields
        if times.is_parseable(f.dataType)
        and (numeric_fallback_ns or not times.is_number(f.dataType))
    ]


def guess_time_column(df: DataFrame, numeric_fallback_ns: bool = False) -> TimeColumn | None:
    """By name without touching the data, else the first column in which a value parses.

    A column found by name is final, even when none of its values parses.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in TIME_NAMES:
        if name in kinds and times.is_parseable(kinds[name]):
            return TimeColumn(name, kinds[name])
    # Columns are looked at one by one, so each is read at most once, and reading stops
    # with the first value that parses.
    for field in _fallback_fields(df, numeric_fallback_ns):
        column = F.col(f"`{field.name}`")
        if not df.select(column).filter(_fallback_time(column, field.dataType).isNotNull()).isEmpty():
            return TimeColumn(field.name, field.dataType, times.is_number(field.dataType))
    return None


def _in_year(chosen: TimeColumn, year: int) -> Column:
    """A range test on the stored column, so the scan can skip files and row groups."""
    first, after = f"{year:04d}-01-01", f"{year + 1:04d}-01-01"
    column = F.col(f"`{chosen.name}`")
    if isinstance(chosen.kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        kind = chosen.kind.simpleString()
        return (column >= F.lit(first).cast(kind)) & (column < F.lit(after).cast(kind))
    parsed = F.col(PARSED)
    in_year = (parsed >= F.lit(first).cast("timestamp")) & (parsed < F.lit(after).cast("timestamp"))
    if times.is_number(chosen.kind) and year != 1970:
        # Missing numbers count as 1970, so elsewhere a plain number range is equivalent
        # but for the session's time zone, which the day of slack on both sides covers.
        per_day = 86_400_000 * (1_000_000 if chosen.nanoseconds else 1)
        low = (dt.date(year, 1, 1) - dt.date(1970, 1, 1)).days - 1
        high = (dt.date(year + 1, 1, 1) - dt.date(1970, 1, 1)).days + 1
        in_year = in_year & (column >= low * per_day) & (column < high * per_day)
    return in_year


def with_time(df: DataFrame, chosen: TimeColumn) -> DataFrame:
    return df.withColumn(PARSED, chosen.value())


def year_slice(df: DataFrame, year: int = 2025, numeric_fallback_ns: bool = False) -> DataFrame:
    """Rows of one calendar year plus their parsed time; no rows if no column holds times."""
    chosen = guess_time_column(df, numeric_fallback_ns)
    if chosen is None:
        return df.limit(0)
    return with_time(df, chosen).filter(_in_year(chosen, year))
