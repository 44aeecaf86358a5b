"""Column expressions: missing values, numbers in text, whitespace, names, percentages."""

from .columns import (
    col,
    dtype_name,
    float_columns,
    groupable_columns,
    numeric_columns,
    present,
    quoted,
    string_columns,
)
from .missing import NA_TOKENS, as_missing, is_missing, normalize_na
from .names import csv_header_names, short_name, standard_name
from .numbers import (
    is_boolean_text,
    is_integer_text,
    is_number_text,
    is_unsigned_text,
    to_boolean,
    to_double,
    to_long,
    to_unsigned,
)
from .ratio import percent
from .rows import column_values, literal_of, literal_rows, name_at, row_digest
from .text import WHITESPACE, strip

__all__ = [
    "NA_TOKENS",
    "WHITESPACE",
    "as_missing",
    "col",
    "column_values",
    "csv_header_names",
    "dtype_name",
    "float_columns",
    "groupable_columns",
    "is_boolean_text",
    "is_integer_text",
    "is_missing",
    "is_number_text",
    "is_unsigned_text",
    "literal_of",
    "literal_rows",
    "name_at",
    "row_digest",
    "normalize_na",
    "numeric_columns",
    "percent",
    "present",
    "quoted",
    "short_name",
    "standard_name",
    "string_columns",
    "strip",
    "to_boolean",
    "to_double",
    "to_long",
    "to_unsigned",
]
