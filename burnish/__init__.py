"""Profile and clean tables of any size with Spark."""

from .functions import normalize_na
from .operators.cleaning import (
    convert_types,
    drop_missing,
    fill_by_chunk,
    fill_mean,
    fill_median,
    fill_mode,
    standardize_columns,
    trim_whitespace,
)
from .operators.counts import column_missing, table_counts
from .operators.distinct import (
    bounded_distinct,
    distinct_counts,
    distinct_labels,
    duplicate_estimate,
    duplicate_rows,
    remove_duplicates,
)
from .operators.expiry import expire_rewrite, read_kept, read_manifest
from .operators.inference import infer_types, scan_csv_typed
from .operators.preview import preview, to_json_records
from .operators.report import completeness_split, dtype_distribution, missing_by_column, missing_heat_bucket
from .operators.rules import expire_rows, regex_rule, unique_rule
from .operators.runlog import append_run, read_runs, recent_runs
from .operators.samples import sample_values
from .operators.statistics import describe_numeric, exact_medians
from .options import CleanOptions
from .plans import (
    CleanResult,
    clean,
    clean_in_ranges,
    clean_progress,
    clean_summary,
    clean_to_csv,
    column_profile,
    quality_report_json,
    table_profile,
)
from .sources import (
    admit_files,
    first_n,
    scan_csv,
    scan_parquet,
    size_mb,
    with_chunk,
    with_row_index,
    write_csv,
)

__all__ = [
    "CleanOptions",
    "CleanResult",
    "admit_files",
    "append_run",
    "bounded_distinct",
    "clean",
    "clean_in_ranges",
    "clean_progress",
    "clean_summary",
    "clean_to_csv",
    "column_missing",
    "column_profile",
    "completeness_split",
    "convert_types",
    "describe_numeric",
    "distinct_counts",
    "distinct_labels",
    "drop_missing",
    "dtype_distribution",
    "duplicate_estimate",
    "duplicate_rows",
    "exact_medians",
    "expire_rewrite",
    "expire_rows",
    "fill_by_chunk",
    "fill_mean",
    "fill_median",
    "fill_mode",
    "first_n",
    "infer_types",
    "missing_by_column",
    "missing_heat_bucket",
    "normalize_na",
    "preview",
    "quality_report_json",
    "read_kept",
    "read_manifest",
    "read_runs",
    "recent_runs",
    "regex_rule",
    "remove_duplicates",
    "sample_values",
    "scan_csv",
    "scan_csv_typed",
    "scan_parquet",
    "size_mb",
    "standardize_columns",
    "table_counts",
    "table_profile",
    "to_json_records",
    "trim_whitespace",
    "unique_rule",
    "with_chunk",
    "with_row_index",
    "write_csv",
]
