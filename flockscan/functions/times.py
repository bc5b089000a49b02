"""Turning date, epoch and text columns into times; NULL where a value is no time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The furthest epoch that fits 64-bit nanoseconds, in milliseconds.
MAX_EPOCH_MS = 9_223_372_036_854

# How text of a known layout starts, and the layout. Text that starts
# otherwise is no time, which spares the cost of failing to parse it.
CLOCK = "[ h:mm[:ss] a][ H:mm[:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]]]"
TEXT_LAYOUTS = (
    (r"^\d{4}/\d{1,2}/\d{1,2}", f"yyyy/M/d{CLOCK}"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}", f"d MMM yyyy{CLOCK}"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}", f"d MMMM yyyy{CLOCK}"),
    (r"^[A-Z][a-z]{2} \d{1,2},? \d{4}", f"MMM d[,] yyyy{CLOCK}"),
    (r"^[A-Z][a-z]{3,} \d{1,2},? \d{4}", f"MMMM d[,] yyyy{CLOCK}"),
)
# Numbers parted by slashes, the month first or the day first.
SLASHES_START = r"^\d{1,2}/\d{1,2}/\d{4}"
MONTH_FIRST, DAY_FIRST = f"M/d/yyyy{CLOCK}", f"d/M/yyyy{CLOCK}"
# Fixed value: `Wed, 10 Oct 2025 20:19:24 GMT` once its day name is cut off.
MAIL_LAYOUT, MAIL_START = "d MMM yyyy HH:mm:ss[ z][ Z]", r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4}"
# Fixed value: `Wed Oct 10 20:19:24 +0000 2025` once its day name is cut off.
PLATFORM_LAYOUT = "MMM d HH:mm:ss Z yyyy"
PLATFORM_START = r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d"
ISO_START = r"^\s*\d{4}-\d{1,2}(-\d{1,2}|$)"


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_parseable(kind: T.DataType) -> bool:
    return is_time(kind) or is_number(kind) or isinstance(kind, (T.StringType, T.VariantType))


def epoch_ms_to_time(value: Column, kind: T.DataType) -> Column:
    """Milliseconds since 1970; a missing number counts as 0, one out of range is NULL."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.nanvl(value, F.lit(0.0).cast(kind))
    filled = F.coalesce(value, F.lit(0).cast(kind))
    # The range test comes first: converting a number beyond it would fail the query.
    return F.when(
        filled.between(-MAX_EPOCH_MS, MAX_EPOCH_MS), F.timestamp_millis(filled.cast("bigint"))
    )


def text_to_time(value: Column, day_first: bool = False) -> Column:
    """Each value is read on its own, so one column may mix layouts.

    Of ``10/12/2025`` the month comes first unless ``day_first``; where that gives no time,
    as in ``25/12/2025``, the other order is tried.
    """
    platform = F.try_to_timestamp(F.substring(value, 5, 64), F.lit(PLATFORM_LAYOUT))
    parsed = F.when(value.rlike(ISO_START), F.try_to_timestamp(value)).when(
        value.rlike(PLATFORM_START), platform
    )
    mail = F.try_to_timestamp(F.substring(value, 6, 64), F.lit(MAIL_LAYOUT))
    orders = (DAY_FIRST, MONTH_FIRST) if day_first else (MONTH_FIRST, DAY_FIRST)
    slashes = F.coalesce(*(F.try_to_timestamp(value, F.lit(layout)) for layout in orders))
    parsed = parsed.when(value.rlike(MAIL_START), mail).when(value.rlike(SLASHES_START), slashes)
    for start, layout in TEXT_LAYOUTS:
        parsed = parsed.when(value.rlike(start), F.try_to_timestamp(value, F.lit(layout)))
    return parsed


def variant_to_time(value: Column, day_first: bool = False) -> Column:
    """Each value by its own type; a missing one is no time."""
    own = F.schema_of_variant(value)
    got = lambda kind: F.try_variant_get(value, "$", kind)
    parsed = F.when(own == "STRING", text_to_time(got("string"), day_first))
    parsed = parsed.when(own.isin("TIMESTAMP", "TIMESTAMP_NTZ", "DATE"), got("timestamp"))
    return parsed.when(own.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), epoch_ms_to_time(got("double"), T.DoubleType()))


def to_time(value: Column, kind: T.DataType, day_first: bool = False) -> Column:
    if isinstance(kind, T.VariantType):
        return variant_to_time(value, day_first)
    if isinstance(kind, T.DateType):
        return value.cast("timestamp")
    if is_time(kind):
        return value
    if is_number(kind):
        return epoch_ms_to_time(value, kind)
    return text_to_time(value, day_first)
