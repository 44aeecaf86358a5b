"""The same cleaning and profiling over files as they arrive."""

from .files import (
    read_totals,
    rows_read,
    stream_batch_fill,
    stream_clean,
    stream_dedup,
    stream_profile,
    stream_scan,
    stream_statistics,
    stream_table_counts,
    stream_to_parquet,
    stream_totals,
)
from .sketches import (
    distinct_error,
    rank_error,
    read_sketches,
    rows_error,
    sketch_files,
    sketched_duplicates,
    sketched_profile,
)

__all__ = [
    "distinct_error",
    "rank_error",
    "read_sketches",
    "read_totals",
    "rows_error",
    "rows_read",
    "sketch_files",
    "sketched_duplicates",
    "sketched_profile",
    "stream_batch_fill",
    "stream_clean",
    "stream_dedup",
    "stream_profile",
    "stream_scan",
    "stream_statistics",
    "stream_table_counts",
    "stream_to_parquet",
    "stream_totals",
]
