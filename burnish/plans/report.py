"""The quality report: one row for the table, one row per column, and both as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    col,
    dtype_name,
    groupable_columns,
    is_boolean_text,
    is_missing,
    is_number_text,
    literal_rows,
    percent,
    present,
    string_columns,
)
from ..operators.cleaning import number_kind, text_fact_columns
from ..operators.counts import table_counts
from ..operators.distinct import duplicate_estimate, duplicate_rows, label_distinct, plentiful
from ..operators.probe import probe
from ..operators.samples import sample_values
from ..operators.statistics import describe_numeric
from ..options import DISTINCT_CAP
from ..sources.files import size_mb


def table_profile(
    df: DataFrame, *, duplicates: str = "exact", order_by: str | None = None, path: str | None = None
) -> DataFrame:
    """One row: table counts and duplicate rows, exact or estimated from the first rows by `order_by`.

    `path` adds the size of the files there, in MiB.
    """
    if duplicates == "exact":
        copies = duplicate_rows(df)
    elif duplicates == "estimate" and order_by is not None:
        copies = duplicate_estimate(df, order_by)
    else:
        raise ValueError("duplicates must be 'exact', or 'estimate' with order_by")
    profile = table_counts(df).withColumn("duplicate_rows", copies.scalar())
    return profile if path is None else profile.withColumn("size_mb", size_mb(df.sparkSession, path).scalar())


def _inferred(row, i: int, field: T.StructField, text: int | None, total: int) -> str:
    if not isinstance(field.dataType, T.StringType):
        return dtype_name(field.dataType)
    if total and row[f"other{i}"] == 0 and row[f"missing{i}"] == 0:
        return "bool"
    kind = None if text is None or not total else number_kind(row, text, row[f"missing{i}"] < total)
    return {"whole": "int64", "unsigned": "uint64", "fractional": "float64", None: "object"}[kind]


def column_profile(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per column: types, missing count and share, distinct values, first values.

    A look at the first rows shows most text columns and most columns with very many distinct values
    for what they are. One pass counts missing values and tests the texts that may be numbers; a
    sample finds further columns with very many distinct values, and those with few are counted
    exactly. `order_by` decides which values come first and is not itself profiled; without it no
    samples are taken.
    """
    body = df.drop(order_by) if order_by is not None else df
    fields = list(body.schema)
    names = groupable_columns(body)
    texts = {n: col(n) for n in string_columns(body)}
    first = probe(body, names, {n: is_number_text(c) for n, c in texts.items()})
    many = first.many(DISTINCT_CAP)
    texts = {n: c for n, c in texts.items() if n not in first.failed}
    aggregates = [F.count(F.lit(1)).alias("total"), *text_fact_columns(texts)]
    for i, field in enumerate(fields):
        aggregates.append(F.count_if(is_missing(field)).alias(f"missing{i}"))
        if isinstance(field.dataType, T.StringType):
            aggregates.append(F.count_if(~is_boolean_text(present(field))).alias(f"other{i}"))
    row = body.agg(*aggregates).first()
    total = row["total"]
    positions = {n: i for i, n in enumerate(texts)}

    facts = [
        (
            i,
            f.name,
            f.dataType.simpleString(),
            _inferred(row, i, f, positions.get(f.name), total),
            row[f"missing{i}"],
            total,
        )
        for i, f in enumerate(fields)
    ]
    schema = "ordinal int, column string, declared_dtype string, dtype string, missing_count bigint, total bigint"
    profile = literal_rows(df.sparkSession, schema, facts)
    share = percent(F.col("missing_count"), F.col("total"))
    profile = profile.withColumn("missing_percentage", share).drop("total")

    many += plentiful(body, [n for n in names if n not in many], total)
    labels = label_distinct(body, names, many)
    # Both frames have one row per column of the table.
    profile = profile.join(F.broadcast(labels), "column", "left")
    if order_by is not None:
        empty = [f.name for i, f in enumerate(fields) if row[f"missing{i}"] == total]
        samples = sample_values(df, order_by, empty=empty)
        profile = profile.join(F.broadcast(samples), "column", "left")
    return profile


def quality_report_json(
    df: DataFrame, order_by: str, *, path: str | None = None, statistics: bool = True, sample_rows: int | None = None
) -> DataFrame:
    """One row, one JSON text: the table profile with the column profiles nested by column name.

    `unique_values` is a number below the cap and a text such as `1000+` from there. With `statistics`
    numeric columns have mean, median, std, min and max, of the first `sample_rows` rows if given.
    `path` adds the size of the files there, in MiB, as `memory_usage`.
    """
    columns = column_profile(df, order_by)
    body = df.drop(order_by)
    known = ["dtype", "missing_count", "missing_percentage"]
    few = F.col("unique_values").try_cast("bigint")
    unique = F.when(few.isNotNull(), F.to_json(F.struct(few.alias("v")))).otherwise(
        F.to_json(F.struct(F.col("unique_values").alias("v")))
    )
    if statistics:
        described = describe_numeric(df if sample_rows else body, sample_rows=sample_rows, order_by=order_by if sample_rows else None)
        # Both have one row per column of the table.
        columns = columns.join(F.broadcast(described.drop("ordinal")), "column", "left")
    given = [c for c in ("mean", "median", "std", "min", "max") if c in columns.columns]
    first = F.to_json(F.struct(*known))
    rest = F.to_json(F.struct("sample_values", *given))  # leaves out what a column does not have
    # {"dtype":…} + {"v":…} + {"sample_values":…}: a JSON field cannot be a number in one row and a text in the next.
    entry = F.concat(
        F.expr("substring(first, 1, length(first) - 1)"),
        F.lit(',"unique_values":'),
        F.expr("substring(uniq, 6, length(uniq) - 6)"),
        F.lit(","),
        F.expr("substring(rest, 2)"),
    )
    parts = columns.select("ordinal", "column", first.alias("first"), unique.alias("uniq"), rest.alias("rest"))
    name = F.expr("substring(to_json(named_struct('v', column)), 6, length(to_json(named_struct('v', column))) - 6)")
    entries = parts.select("ordinal", F.concat(name, F.lit(":"), entry).alias("entry"))
    listed = entries.agg(F.array_sort(F.collect_list(F.struct("ordinal", "entry"))).alias("all"))
    nested = listed.select(F.concat(F.lit("{"), F.array_join("all.entry", ","), F.lit("}"))).scalar()
    table = table_profile(body, path=path)
    if path is not None:
        table = table.withColumnRenamed("size_mb", "memory_usage")
    whole = F.to_json(F.struct(*table.columns))
    report = F.concat(F.expr("substring(whole, 1, length(whole) - 1)"), F.lit(',"column_analysis":'), F.col("nested"), F.lit("}"))
    return table.select(whole.alias("whole"), nested.alias("nested")).select(report.alias("quality_report"))
