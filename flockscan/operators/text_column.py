"""Finding the text column of a post table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Usual names of the text column, the first one present wins.
TEXT_NAMES = ("full_text", "text", "content", "message", "body")
# Fixed value: a column counts as text when its median length is above this.
MIN_MEDIAN_LENGTH = 10


def length_medians(df: DataFrame) -> DataFrame:
    """``(position, column, median_length)`` of every text column, in one pass.

    The exact median counts distinct lengths, so its state stays as small as the
    range of lengths however many rows there are.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, median_length double"
        )
    one_row = df.agg(
        F.array(
            *(
                F.struct(
                    F.lit(df.columns.index(n)).alias("position"),
                    F.lit(n).alias("column"),
                    F.median(F.length(F.col(f"`{n}`"))).alias("median_length"),
                )
                for n in names
            )
        ).alias("medians")
    )
    return one_row.select(F.inline("medians"))


def guess_text_column(df: DataFrame) -> str | None:
    """By name, else the column of greatest median length above 10; ties to the earlier."""
    for name in TEXT_NAMES:
        if name in df.columns:
            return name
    # One row per column, never per record.
    medians = [r for r in length_medians(df).collect() if r["median_length"] is not None]
    if not medians:
        return None
    best = max(medians, key=lambda r: (r["median_length"], -r["position"]))
    return best["column"] if best["median_length"] > MIN_MEDIAN_LENGTH else None


def guess_slice_text_column(part: DataFrame, whole: DataFrame) -> str | None:
    """Look at the slice if it has rows, otherwise at the whole table."""
    return guess_text_column(whole if part.isEmpty() else part)
