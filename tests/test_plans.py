"""What the plans must and must not contain at scale."""

import re

from pyspark.sql import functions as F

import burnish as b

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, name):
    return b.scan_parquet(spark, SF, name)


def test_only_needed_columns_are_read(spark):
    lineitem = table(spark, "lineitem")
    gaps = lineitem.withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    text = plan(b.fill_mean(gaps, ["l_tax"]).select("l_tax"))
    assert re.findall(r"ReadSchema: (\S+)", text)[0] == "struct<l_tax:double>"
    text = plan(b.expire_rows(table(spark, "events"), "ts", "2024-01-10 00:00:00").select("event_id"))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_first_rows_filter_reaches_the_scan(spark):
    orders = table(spark, "orders")
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThanOrEqual(o_orderkey" in plan(b.first_n(orders, 10, "o_orderkey"))
    text = plan(b.first_n(b.scan_parquet(spark, "/root/testdata/sf0.01", "orders"), 500, "o_orderkey"))
    assert "TakeOrderedAndProject" in text and "LessThanOrEqual(o_orderkey" in text


def test_counts_fold_before_the_shuffle(spark):
    lineitem = table(spark, "lineitem")
    for df in (b.duplicate_rows(lineitem), b.distinct_counts(lineitem), b.column_missing(lineitem), b.remove_duplicates(lineitem)):
        text = plan(df)
        first_exchange = text.rindex("Exchange")
        assert "HashAggregate" in text[first_exchange:] or "partial_" in text


def test_dedup_is_shuffled_once_for_fill_values(spark):
    """The mean is taken after removing duplicates; both read the same shuffle."""
    events = table(spark, "events").select("event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    out = b.clean(events, remove_duplicates=True, handle_missing="fill_mean")
    out.collect()
    assert "ReusedExchange" in plan(out)


def test_window_limit_prunes_samples(spark):
    orders = table(spark, "orders")
    assert "WindowGroupLimit" in plan(b.sample_values(orders, "o_orderkey"))
