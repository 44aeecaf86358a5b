"""Column names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_NAME_CHARS = 12  # fixed value: the longest name a report shows in full


def standard_name(name: str) -> str:
    """Trimmed, lower case, each blank an underscore."""
    return name.strip().lower().replace(" ", "_")


def distinct_names(names: Iterable[str], separator: str) -> list[str]:
    """Number repeated names; Spark compares names without case, so `A` and `a` also repeat."""
    wanted = list(names)
    reserved = {n.lower() for n in wanted}
    used: set[str] = set()
    result = []
    for name in wanted:
        chosen, number = name, 0
        while chosen.lower() in used or (number and chosen.lower() in reserved):
            number += 1
            chosen = f"{name}{separator}{number}"
        used.add(chosen.lower())
        result.append(chosen)
    return result


def csv_header_names(fields: Sequence[str | None]) -> list[str]:
    """Names for a CSV header: blanks become `Unnamed: <position>`, repeats get `.1`, `.2`, …"""
    named = [f if f else f"Unnamed: {i}" for i, f in enumerate(fields)]
    return distinct_names(named, ".")


def short_name(c: Column) -> Column:
    """Names over twelve characters cut to twelve plus an ellipsis."""
    cut = F.concat(F.substring(c, 1, SHORT_NAME_CHARS), F.lit("..."))
    return F.when(F.length(c) > SHORT_NAME_CHARS, cut).otherwise(c)
