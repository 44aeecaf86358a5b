"""Whole tasks put together from operators: the quality report and the cleaning run."""

from .cleaning import CleanResult, clean, clean_summary, clean_to_csv
from .ranges import clean_in_ranges, clean_progress
from .report import column_profile, quality_report_json, table_profile

__all__ = [
    "CleanResult",
    "clean",
    "clean_in_ranges",
    "clean_progress",
    "clean_summary",
    "clean_to_csv",
    "column_profile",
    "quality_report_json",
    "table_profile",
]
