"""From a post archive to the posts of one year, on disk and ready for analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from flockscan.operators.text_column import guess_slice_text_column
from flockscan.operators.year_slice import year_slice
from flockscan.sources.posts import write_csv, write_table
from flockscan.storage import save


@dataclass
class ArchiveSlice:
    posts: DataFrame
    rows: int
    text_column: str | None


def slice_archive(
    posts: DataFrame,
    year: int = 2025,
    csv_path: str | None = None,
    table: str | None = None,
    table_path: str | None = None,
) -> ArchiveSlice:
    """Keep one year, find its text column, and write it wherever asked.

    The slice is stored once, so that both sinks and later steps skip the archive.
    """
    kept = save(year_slice(posts, year), "slice")
    if csv_path is not None:
        write_csv(kept.frame, csv_path)
    if table is not None:
        write_table(kept.frame, table, table_path)
    whole = posts if kept.rows == 0 else kept.frame
    return ArchiveSlice(kept.frame, kept.rows, guess_slice_text_column(kept.frame, whole))
