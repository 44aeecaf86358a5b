"""A look at the first rows, to settle what a few rows can prove."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_number_text, present

_PROBE_ROWS = 5_000


@dataclass(frozen=True)
class Probe:
    """Per column the distinct values seen, and the names of the tests that some row fails."""

    distinct: dict[str, int]
    failed: frozenset[str]

    def many(self, cap: int) -> list[str]:
        return [n for n, seen in self.distinct.items() if seen >= cap]


def probe(df: DataFrame, columns: list[str], tests: dict[str, Column] | None = None) -> Probe:
    """Look at a few thousand rows from the front of the scan.

    What they show holds for the whole table: it has at least as many distinct values, and a test
    that one row fails does not hold for all. Only hashes and flags leave the tasks, and `take`
    reads no more partitions than it needs.
    """
    tests = tests or {}
    if not columns and not tests:
        return Probe({}, frozenset())
    fields = {f.name: f for f in df.schema}
    values = [present(fields[n]) for n in columns]
    hashes = [F.when(v.isNotNull(), F.xxhash64(v)) for v in values]
    rows = df.select(*[e.alias(f"p{i}") for i, e in enumerate([*hashes, *tests.values()])]).take(_PROBE_ROWS)
    seen = [{r[i] for r in rows} - {None} for i in range(len(columns) + len(tests))]
    return Probe(
        {n: len(s) for n, s in zip(columns, seen, strict=False)},
        frozenset(n for n, s in zip(tests, seen[len(columns) :], strict=True) if False in s),
    )


def maybe_numeric(df: DataFrame, texts: dict[str, Column]) -> dict[str, Column]:
    """The text columns whose first rows are all numbers."""
    failed = probe(df, [], {n: is_number_text(c) for n, c in texts.items()}).failed
    return {n: c for n, c in texts.items() if n not in failed}
