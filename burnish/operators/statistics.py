"""Statistics of numeric columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import column_values, literal_rows, numeric_columns, present
from ..options import MEDIAN_TASK_ROWS
from ..sources.order import first_n
from .counts import one_row_per_column

_ACCURACY = 10_000  # rank error of the sketch: one part in this many


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    fields = {f.name: f for f in df.schema}
    return df.select(*[present(fields[n]).cast("double").alias(f"c{i}") for i, n in enumerate(columns)])


@dataclass(frozen=True)
class _Bracket:
    """An interval of one column that holds the value of a rank; ends that are open are not in it.

    `below` rows lie before the interval and `inside` rows in it.
    """

    column: str
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    low_open: bool = False
    high_open: bool = False

    @property
    def rate(self) -> float:
        """Share of the rows inside to sample: a hundredth of them, but neither few nor too many."""
        return min(1.0, min(max(self.inside / 100, 20_000), 1_000_000) / self.inside)

    def holds(self) -> Column:
        c = F.col(self.column)
        after = c > F.lit(self.low) if self.low_open else c >= F.lit(self.low)
        return after & (c < F.lit(self.high) if self.high_open else c <= F.lit(self.high))

    def shares(self, first: int, last: int) -> list[float]:
        """Where in the interval, as shares, two values should lie that enclose the ranks: five standard errors off."""
        margin = 2.0 / _ACCURACY + (2.5 / math.sqrt(self.rate * self.inside) if self.rate < 1 else 0.0)
        start, end = (first - self.below) / self.inside, (last + 1 - self.below) / self.inside
        return [max(0.0, start - margin), min(1.0, end + margin)]

    def cut(self, low: float, high: float, counts: tuple[int, int, int, int]) -> list[_Bracket]:
        """This interval cut at two of its values: what is before, at, between, at and after them.

        `counts` are the rows before and at the lower value, between both, and at the higher value.
        """
        before, at_low, between, at_high = counts
        at_high = at_high if high > low else 0
        parts, below = [], self.below
        for part, size in (
            (replace(self, high=low, high_open=True), before),
            (replace(self, low=low, high=low, low_open=False, high_open=False), at_low),
            (replace(self, low=low, high=high, low_open=True, high_open=True), between),
            (replace(self, low=high, high=high, low_open=False, high_open=False), at_high),
            (replace(self, low=high, low_open=True), self.inside - before - at_low - between - at_high),
        ):
            parts.append(replace(part, below=below, inside=size))
            below += size
        return parts

    def has(self, rank: int) -> bool:
        return self.below <= rank < self.below + self.inside

    def settled(self) -> bool:
        return self.low == self.high


def exact_medians(
    df: DataFrame, columns: list[str], *, one_task_rows: int = MEDIAN_TASK_ROWS, gaps_only: bool = False
) -> dict[str, float | None]:
    """The exact median of each column, whatever the size of the table; with `gaps_only` of those with a gap.

    Spark's own `median` gathers every distinct value in one task, which suits small tables only.
    Here a sample of each column gives two values that enclose the middle, and a count of the rows
    before, at, between and after them tells where it is. A value that fills a large share of the
    column is settled by its own count; otherwise the interval left has lost both values, so that it
    always shrinks. Once at most `one_task_rows` are left, their values are counted and the middle is
    read off. The heavy passes are plain counts in generated code.
    """
    if not columns:
        return {}
    values = _doubles(df, columns)
    totals = values.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in values.columns]).first().asDict()
    rows = totals.pop("rows")
    names = {c: n for c, n in zip(values.columns, columns, strict=True) if not gaps_only or totals[c] < rows}
    found = _medians(values, {c: totals[c] for c in names}, one_task_rows) if names else {}
    return {n: found.get(c) for c, n in names.items()}


def _medians(values: DataFrame, totals: dict[str, int], one_task_rows: int) -> dict[str, float]:
    """Medians of double columns of which the number of filled rows is known."""
    if max(totals.values()) <= one_task_rows:
        return values.agg(*[F.median(c).alias(c) for c in totals]).first().asDict()
    # The middle is the mean of two ranks, the same one for an odd number of rows.
    middles = {c: ((total - 1) // 2, total // 2) for c, total in totals.items() if total}
    at = {(c, rank): _Bracket(c, totals[c]) for c, ranks in middles.items() for rank in ranks}
    seed = 0
    while wide := {k: b for k, b in at.items() if b.inside > one_task_rows and not b.settled()}:
        at |= _narrow(values, wide, seed)
        seed += 1
    known = {k: b.low for k, b in at.items() if b.settled()}
    known |= _read_off(values, {k: b for k, b in at.items() if k not in known})
    return {c: (known[c, first] + known[c, last]) / 2 for c, (first, last) in middles.items()}


def _narrow(values: DataFrame, wide: dict[tuple, _Bracket], seed: int) -> dict[tuple, _Bracket]:
    """One round: sample the rows inside each interval, then count around two of its values."""
    brackets = list(dict.fromkeys(wide.values()))
    ranks = {b: [rank for (_, rank), own in wide.items() if own == b] for b in brackets}
    chance = F.col("chance")
    columns = list(dict.fromkeys(b.column for b in brackets))
    drawn = values.select(*columns, F.rand(seed).alias("chance")).filter(chance < max(b.rate for b in brackets))
    sketches = [
        F.percentile_approx(
            F.when(b.holds() & (chance < b.rate), F.col(b.column)), b.shares(min(ranks[b]), max(ranks[b])), _ACCURACY
        ).alias(f"b{i}")
        for i, b in enumerate(brackets)
    ]
    found = drawn.agg(*sketches).first()
    cuts = {b: found[i] for i, b in enumerate(brackets) if found[i]}
    counts = []
    for b, (low, high) in cuts.items():
        c, inside, low, high = F.col(b.column), b.holds(), F.lit(low), F.lit(high)
        counts += [inside & (c < low), inside & (c == low), inside & (c > low) & (c < high), inside & (c == high)]
    if not counts:  # an empty sample; the next one is another
        return {}
    row = values.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(counts)]).first()
    parts = {b: b.cut(*ends, tuple(row[4 * i : 4 * i + 4])) for i, (b, ends) in enumerate(cuts.items())}
    return {k: next(p for p in parts[b] if p.has(k[1])) for k, b in wide.items() if b in parts}


def _read_off(values: DataFrame, at: dict[tuple, _Bracket]) -> dict[tuple, float]:
    """The values of the ranks from the counted values inside their intervals."""
    if not at:
        return {}
    brackets = list(dict.fromkeys(at.values()))
    near = values.select(*[F.when(b.holds(), F.col(b.column)).alias(f"b{i}") for i, b in enumerate(brackets)])
    counted = column_values(near, near.columns).groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
    wanted = [(brackets.index(b), rank - b.below) for (_, rank), b in at.items()]
    ranks = literal_rows(values.sparkSession, "position int, rank bigint", sorted(set(wanted)))
    seen = F.sum("n").over(W.partitionBy("position").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("seen", seen).join(F.broadcast(ranks), "position").filter("seen > rank")
    read = {(r["position"], r["rank"]): r["value"] for r in ranked.groupBy("position", "rank").agg(F.min("value").alias("value")).collect()}
    return {k: read[place] for k, place in zip(at, wanted, strict=True)}


def sketched_medians(values: DataFrame, accuracy: int) -> DataFrame:
    """One row with the median of each double column from a sketch of all rows: off by one rank in `accuracy`."""
    return values.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in values.columns])


def approximate_medians(df: DataFrame, columns: list[str], *, accuracy: int = _ACCURACY) -> dict[str, float | None]:
    """The median of each column from a sketch of all rows; see `sketched_medians`."""
    return dict(zip(columns, sketched_medians(_doubles(df, columns), accuracy).first(), strict=True))


_STATISTICS = ("mean", "median", "std", "min", "max")


def describe_numeric(
    df: DataFrame,
    *,
    sample_rows: int | None = None,
    order_by: str | None = None,
    approximate: bool = False,
    accuracy: int = _ACCURACY,
) -> DataFrame:
    """Mean, median, sample standard deviation, minimum and maximum of each numeric column.

    `sample_rows` limits this to the first rows by `order_by`, as the report does by default there,
    and makes it one lazy pass. For a whole table the other statistics are one pass, run at once;
    then follow the passes for the exact median. With `approximate` the median is part of the one
    pass, from a sketch of all rows that is off by at most one rank in `accuracy`.
    """
    if sample_rows is not None:
        if order_by is None:
            raise ValueError("sample_rows needs order_by: the first rows by which key?")
        df = first_n(df, sample_rows, order_by)
    names = numeric_columns(df)
    schema = "ordinal int, column string, mean double, median double, std double, min double, max double"
    if not names:
        return literal_rows(df.sparkSession, schema, [])
    values = _doubles(df, names)
    one_pass = sample_rows is not None and sample_rows <= MEDIAN_TASK_ROWS
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for c in values.columns:
        aggregates += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.median(c).alias(f"{c}_median") if one_pass
            else F.percentile_approx(c, 0.5, accuracy).alias(f"{c}_median") if approximate
            else F.count(c).alias(f"{c}_filled"),
        ]
    if one_pass:
        facts = {n: {s: f"{c}_{s}" for s in _STATISTICS} for n, c in zip(names, values.columns, strict=True)}
        return one_row_per_column(values.agg(*aggregates), facts)
    row = values.agg(*aggregates).first().asDict()
    if approximate:
        medians = {c: row[f"{c}_median"] for c in values.columns}
    else:
        medians = _medians(values, {c: row[f"{c}_filled"] for c in values.columns}, MEDIAN_TASK_ROWS)
    rows = [
        (i, n, *[medians.get(c) if s == "median" else row[f"{c}_{s}"] for s in _STATISTICS])
        for i, (n, c) in enumerate(zip(names, values.columns, strict=True))
    ]
    return literal_rows(df.sparkSession, schema, rows)
