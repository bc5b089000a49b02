"""Intermediate tables in the cluster's shared checkpoint folder.

Iterative operators write each step as a parquet table and read it back. That
cuts the lineage, survives the loss of any executor, and gives the optimizer
true sizes for the next step.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="flockscan-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/flockscan/{label}-{uuid.uuid4().hex}"
    if _WORKSPACES:
        _WORKSPACES[-1].append(path)
    return path


# Open workspaces, each with the paths made within it.
_WORKSPACES: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """Deletes the intermediate tables made inside it when it is left.

    Results read these tables, so they have to be written or collected before.
    """
    made: list[str] = []
    _WORKSPACES.append(made)
    try:
        yield
    finally:
        _WORKSPACES.remove(made)
        for path in made:
            _delete(spark, path)


@dataclass
class Saved:
    """A table written to the shared folder, with what was measured while writing."""

    frame: DataFrame
    path: str
    metrics: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return self.metrics["rows"]

    def discard(self) -> None:
        """Delete the files of a step that no later plan reads."""
        _delete(self.frame.sparkSession, self.path)


def save(df: DataFrame, label: str, **metrics: Column) -> Saved:
    """Write ``df`` once, counting rows (and any extra aggregate) in the same job."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    path = new_path(spark, label)
    seen = Observation()
    measured = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in metrics.items())
    )
    measured.write.parquet(path)
    return Saved(spark.read.schema(df.schema).parquet(path), path, dict(seen.get))
