"""Post archives: reading, bringing to one shape, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


# Tasks that write one year, each one file.
YEAR_PARTS = 64
# Archives beyond this size have splits enough; they are never shuffled to fill cores.
FILL_BYTES = 128 << 20
# How text survives a CSV file: line breaks, quotes, outer blanks, and empty apart from missing.
CSV_TEXT = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": '""',
    "nullValue": "",
}


def fill_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small scan over all cores.

    Small archives often hold a single row group. Beyond ``FILL_BYTES`` a scan is
    returned as it is, whatever the number of cores.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > FILL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def read_posts(
    spark: SparkSession,
    path: str | list[str],
    kind: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read an archive; records that lack a field get NULL there.

    With a ``schema`` nothing is read before the first row is asked for. Without one JSON
    and CSV are read once more to infer it, of parquet the footers.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        paths = [path] if isinstance(path, str) else path
        return reader.option("mergeSchema", schema is None).parquet(*paths)
    if kind == "json":
        return reader.json(path)
    if kind == "csv":
        # An unquoted empty cell is read as the null value, which no text is equal to.
        options = {**CSV_TEXT, "emptyValue": "", "nullValue": "\0", "header": True, "multiLine": True}
        return reader.options(**options).csv(path, inferSchema=schema is None)
    raise ValueError(f"cannot read posts from {kind!r}")


def column_preview(df: DataFrame, limit: int = 50) -> list[str]:
    return df.columns[:limit]


def nested_to_json(df: DataFrame) -> DataFrame:
    """Struct, array, map and VARIANT columns as JSON text, for sinks that take flat rows only."""
    return df.select(
        *(
            F.to_json(F.col(f"`{f.name}`"), {"ignoreNullFields": "false"}).alias(f.name)
            if isinstance(f.dataType, NESTED)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Replace ``path`` by CSV files with a header, to be read by ``read_posts``.

    Texts come back as they were, with line breaks, quotes and outer blanks; an empty
    text is told apart from a missing one.
    """
    nested_to_json(df).write.mode("overwrite").options(**CSV_TEXT, header=True).csv(path)


def write_table(df: DataFrame, name: str = "tweets", path: str | None = None) -> None:
    """Replace the table ``name``; with ``path`` its files live there, not in the warehouse."""
    writer = nested_to_json(df).write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_years(df: DataFrame, path: str, time: str) -> None:
    """Replace the years of ``df`` in an archive in folders by year; other years stay as they are.

    The year is that of the column ``time``; rows without one go to a folder of their own.
    New files are written aside and moved when all are whole, so that a failed write
    loses nothing. ``read_posts`` reads the archive, and a filter on ``year`` skips folders.
    """
    dated = df.withColumn("year", F.year(time))
    writer = dated.repartition("year", F.pmod(F.xxhash64(*_plain(df)), F.lit(YEAR_PARTS))).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def _plain(df: DataFrame) -> list[str]:
    """Columns that can be hashed."""
    return [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.VariantType, T.MapType))]
