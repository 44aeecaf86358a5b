"""Reading, writing, admitting and ordering data."""

from .csv import header_names, scan_csv, write_csv
from .files import admit_files, scan_parquet, size_mb, working_dir
from .order import first_n, with_chunk, with_row_index

__all__ = [
    "admit_files",
    "first_n",
    "header_names",
    "scan_csv",
    "scan_parquet",
    "size_mb",
    "with_chunk",
    "with_row_index",
    "working_dir",
    "write_csv",
]
