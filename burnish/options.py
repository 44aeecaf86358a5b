"""Settings shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Limits a user of the service this replaces relies on.
CHUNK_ROWS = 10_000
SAMPLE_ROWS = 10_000
PREVIEW_ROWS = 10
SAMPLE_VALUES = 3
DISTINCT_CHUNKS = 3
DISTINCT_PER_CHUNK = 100
DISTINCT_CAP = 1_000
LARGE_TABLE_ROWS = 50_000
MAX_FILE_BYTES = 100 * 1024 * 1024
HISTORY_ROWS = 10

# Ours: the most rows one task is given to look up, and to sort for a median.
ONE_TASK_ROWS = 1_000_000
MEDIAN_TASK_ROWS = 100_000

# Ours: the bytes of files that are cleaned at a time where progress is logged.
RANGE_BYTES = 1 << 40

FILL_METHODS = ("fill_mean", "fill_median", "fill_mode")


@dataclass(frozen=True)
class CleanOptions:
    """What `clean` does, in this order: duplicates, names, missing values, trim, types.

    `handle_missing` is one of drop, fill_mean, fill_median, fill_mode; any other value leaves
    missing values alone. `scope` says whether a fill value is taken from the whole table or
    from each run of `chunk_rows` rows. `dedup_strategy` is that of `remove_duplicates`.
    """

    remove_duplicates: bool = False
    standardize_columns: bool = False
    handle_missing: str | None = None
    trim_whitespace: bool = False
    convert_types: bool = False
    scope: str = "table"
    chunk_rows: int = CHUNK_ROWS
    dedup_strategy: str = "rows"

    def __post_init__(self) -> None:
        if self.scope not in ("table", "chunk"):
            raise ValueError(f"scope must be 'table' or 'chunk', not {self.scope!r}")
        if self.chunk_rows < 1:
            raise ValueError("chunk_rows must be positive")

    @classmethod
    def from_dict(cls, options: dict) -> CleanOptions:
        """Build from a plain dict; unknown keys are ignored, as a JSON request may carry more."""
        known = {k: v for k, v in options.items() if k in cls.__dataclass_fields__ and v is not None}
        return replace(cls(), **known)
