"""The given tables read as file streams until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish import streaming as s
from burnish import distinct_counts, write_csv
from burnish.functions import literal_rows
from burnish.operators.counts import one_row_per_column

from .files import fresh
from .profile import LINEITEM, LINEITEM_NUMBERS, percent_sql, table_counts_sql
from .registry import check
from .views import table, view, view_sql

EVENTS = ["event_id", "user_id", "event_type", "value"]
GAPPY_EVENTS = """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN event_id % 5 = 0 THEN concat(' ', event_type, '  ') ELSE event_type END AS event_type,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events"""


def _stream(spark, sf_dir, name="events"):
    """A table as a stream, be it one file or a folder of files. A path of a stream may be a file only as a glob, `[.]`."""
    schema = table(spark, sf_dir, name).schema
    return s.stream_scan(spark, f"{sf_dir}/{name}[.]parquet", schema, file_format="parquet")


def _gappy_stream(spark, sf_dir):
    return _stream(spark, sf_dir).selectExpr(
        "event_id",
        "CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id",
        "CASE WHEN event_id % 5 = 0 THEN concat(' ', event_type, '  ') ELSE event_type END AS event_type",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value",
    )


def _finish(query):
    query.awaitTermination()


@check(f"WITH d AS ({GAPPY_EVENTS}) " + " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
        {percent_sql(f"count(*) FILTER (WHERE {c} IS NULL)", "count(*)")} AS missing_percentage FROM d"""
    for i, c in enumerate(EVENTS)
))
def stream_profile(spark, sf_dir):
    path = fresh(spark)
    totals = s.stream_profile(_gappy_stream(spark, sf_dir))
    _finish(s.stream_totals(totals, path + "/out", path + "/state"))
    return s.read_totals(spark, path + "/out")


@check(f"WITH d AS ({GAPPY_EVENTS}) {table_counts_sql('d', EVENTS)}")
def stream_table_counts(spark, sf_dir):
    path = fresh(spark)
    totals = s.stream_table_counts(_gappy_stream(spark, sf_dir))
    _finish(s.stream_totals(totals, path + "/out", path + "/state"))
    return s.read_totals(spark, path + "/out")


@check(f"""SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, trim(event_type) AS event_type, value
    FROM ({GAPPY_EVENTS}) WHERE user_id IS NOT NULL AND value IS NOT NULL""")
def stream_clean(spark, sf_dir):
    path = fresh(spark)
    as_text = _gappy_stream(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string"))
    cleaned = s.stream_clean(as_text, types={"user_id": "double"}, handle_missing="drop", trim_whitespace=True)
    _finish(s.stream_to_parquet(cleaned, path + "/out", path + "/state"))
    return spark.read.parquet(path + "/out")


@check(f"""WITH d AS ({GAPPY_EVENTS})
    SELECT event_id, round(coalesce(CAST(user_id AS DOUBLE), (SELECT avg(CAST(user_id AS DOUBLE)) FROM d)), 6) AS user_id,
           event_type, round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value FROM d""")
def stream_batch_fill(spark, sf_dir):
    """The table is one file, so one micro-batch."""
    path = fresh(spark)
    _finish(
        s.stream_batch_fill(_gappy_stream(spark, sf_dir), path + "/out", path + "/state", handle_missing="fill_mean",
                            fill_columns=["user_id", "value"])
    )
    out = spark.read.parquet(path + "/out").drop("batch_id")
    return out.select("event_id", F.round("user_id", 6).alias("user_id"), "event_type", F.round("value", 6).alias("value"))


PARTS = 6
MANY = f"""SELECT o_orderkey % {PARTS} AS part, o_orderkey,
    CASE WHEN o_orderkey % {PARTS} < 3 AND o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS o_custkey,
    o_totalprice FROM orders"""


def _many_files(spark, sf_dir) -> str:
    """Orders as one file for each part, with gaps in some of them only."""
    path = fresh(spark)
    rows = spark.sql(MANY.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    rows.repartition(PARTS, "part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return path


def _many_stream(spark, path):
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, part int"
    return s.stream_scan(spark, path, schema, file_format="parquet", max_files_per_trigger=1)


@check(f"""WITH d AS ({MANY})
    SELECT o_orderkey, CAST(part AS INTEGER) AS part, o_totalprice,
           round(coalesce(CAST(o_custkey AS DOUBLE), avg(CAST(o_custkey AS DOUBLE)) OVER (PARTITION BY part)), 6) AS o_custkey FROM d""")
def stream_batch_fill_many(spark, sf_dir):
    """Several micro-batches; an integer column has gaps in some only, and all are read as one table."""
    path = fresh(spark)
    stream = _many_stream(spark, _many_files(spark, sf_dir))
    _finish(s.stream_batch_fill(stream, path + "/out", path + "/state", handle_missing="fill_mean",
                                fill_columns=["o_custkey", "o_totalprice"]))
    out = spark.read.parquet(path + "/out")
    return out.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("part").cast("int").alias("part"), "o_totalprice",
                      F.round("o_custkey", 6).alias("o_custkey"))


@check("SELECT count(*) AS rows_read, count(*) AS rows_filled FROM orders")
def stream_rows_read_many(spark, sf_dir):
    """More batches than Spark remembers; a batch that is filled is counted once."""
    path, files = fresh(spark), _many_files(spark, sf_dir)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        plain = s.stream_to_parquet(_many_stream(spark, files), path + "/out", path + "/state")
        _finish(plain)
        filled = s.stream_batch_fill(_many_stream(spark, files), path + "/out2", path + "/state2", handle_missing="fill_median")
        _finish(filled)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    return literal_rows(spark, "rows_read bigint, rows_filled bigint", [(s.rows_read(plain), s.rows_read(filled))])


@check("SELECT DISTINCT md5(text) AS text_md5, lang, source FROM documents")
def stream_dedup(spark, sf_dir):
    path = fresh(spark)
    rows = _stream(spark, sf_dir, "documents").select("text", "lang", "source")
    _finish(s.stream_to_parquet(s.stream_dedup(rows), path + "/out", path + "/state"))
    return spark.read.parquet(path + "/out").select(F.md5("text").alias("text_md5"), "lang", "source")


@check("SELECT event_type, count(*) AS copies_kept FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def stream_dedup_hot_rows(spark, sf_dir):
    """Few distinct rows with very many copies each, spread over salts."""
    path = fresh(spark)
    rows = _stream(spark, sf_dir).select("event_type", "user_id")
    _finish(s.stream_to_parquet(s.stream_dedup(rows, salts=4), path + "/out", path + "/state"))
    return spark.read.parquet(path + "/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("copies_kept"))


@check("SELECT count(*) AS rows_read FROM events")
def stream_rows_read(spark, sf_dir):
    path = fresh(spark)
    query = s.stream_to_parquet(_stream(spark, sf_dir), path + "/out", path + "/state")
    _finish(query)
    return literal_rows(spark, "rows_read bigint", [(s.rows_read(query),)])


@check("SELECT DISTINCT event_id, ts FROM events")
def stream_dedup_watermark(spark, sf_dir):
    """Every event twice at once; the state only remembers ten minutes."""
    path = fresh(spark)
    rows = _stream(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    kept = s.stream_dedup(twice, event_time="ts", delay="10 minutes")
    _finish(s.stream_to_parquet(kept, path + "/out", path + "/state"))
    return spark.read.parquet(path + "/out").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@check("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part WHERE p_partkey % 10 <> 1")
def stream_csv_typed(spark, sf_dir):
    """Typed CSV columns in a stream: lines of another width are skipped, the rest is cast."""
    path = fresh(spark)
    lines = table(spark, sf_dir, "part").selectExpr(
        "concat_ws(',', CAST(p_partkey AS STRING), CAST(p_size AS STRING), p_brand, CASE WHEN p_partkey % 10 = 1 THEN 'more' END) AS value")
    lines.toDF("p_partkey,p_size,p_brand").write.options(header=True, sep="\x01", quote="\x02").csv(path + "/in")
    stream = s.stream_scan(spark, path + "/in", "p_partkey bigint, p_size bigint, p_brand string", file_names="*.csv", bad_lines="skip")
    _finish(s.stream_to_parquet(stream, path + "/out", path + "/state"))
    return spark.read.parquet(path + "/out")


@check("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang FROM documents")
def stream_csv_line_breaks(spark, sf_dir):
    """Whole texts with line breaks, quotes and separators, streamed from CSV files."""
    path = fresh(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # Files of some hundred texts, as they may arrive: a stream reads records within a block of a file.
    write_csv(docs.repartition(docs.count() // 400 + 1), path + "/in")
    stream = s.stream_scan(spark, path + "/in", "doc_id string, text string, lang string", file_names="*.csv", na=False)
    _finish(s.stream_to_parquet(stream, path + "/out", path + "/state"))
    return spark.read.parquet(path + "/out").select("doc_id", F.md5("text").alias("text_md5"), "lang")


STATISTICS_SQL = " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS "column", count({c}) AS filled, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
        round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, min(CAST({c} AS DOUBLE)) AS "min", max(CAST({c} AS DOUBLE)) AS "max" FROM d"""
    for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice"])
)


@check(f"WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice + 1000000 AS o_totalprice FROM ({MANY})) {STATISTICS_SQL}")
def stream_statistics(spark, sf_dir):
    """Running moments over several batches, of values far from zero too."""
    path = fresh(spark)
    stream = _many_stream(spark, _many_files(spark, sf_dir)).drop("part")
    totals = s.stream_statistics(stream.withColumn("o_totalprice", F.col("o_totalprice") + 1_000_000))
    _finish(s.stream_totals(totals, path + "/out", path + "/state"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std")]
    return s.read_totals(spark, path + "/out").select("ordinal", "column", "filled", *rounded, "min", "max")


def _sketched(spark, rows, parts: int) -> str:
    """The table sketched as its files arrive, in so many parts of several files."""
    folder, store = fresh(spark), fresh(spark)
    for part in range(parts):
        arrived = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) == part)
        arrived.repartition(3).write.mode("append").parquet(folder)
        s.sketch_files(spark, folder, store)
    return store


@check(f"WITH d AS ({view_sql('gappy_lineitem')}) " + " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing_count,
        count({c}) > 0 AS within_bound FROM d""" for i, c in enumerate(LINEITEM)
))
def unique_incremental(spark, sf_dir):
    """Distinct values from stored sketches, off by less than four standard errors of the exact ones."""
    gappy = view(spark, sf_dir, "gappy_lineitem")
    found = s.sketched_profile(spark, _sketched(spark, gappy, 3))
    exact = distinct_counts(gappy).select("column", F.col("unique_values").alias("exact"))
    close = F.abs(F.col("unique_values") - F.col("exact")) <= 4 * s.distinct_error() * F.col("exact")
    return found.join(exact, "column").select("ordinal", "column", "rows", "missing_count", close.alias("within_bound"))


#: Means of these lie close to a tie with six digits.
DIGITS = {"l_discount": 8, "l_tax": 8}


@check(f"WITH d AS ({view_sql('gappy_lineitem')}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg(CAST({c} AS DOUBLE)), {DIGITS.get(c, 5)}) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), {DIGITS.get(c, 5)}) AS std,
        min(CAST({c} AS DOUBLE)) AS "min", max(CAST({c} AS DOUBLE)) AS "max", count({c}) > 0 AS within_bound FROM d"""
    for c in LINEITEM_NUMBERS
))
def median_incremental(spark, sf_dir):
    """Statistics from stored sketches; the share of rows below the median and up to it enclose a half, within twice the rank error."""
    gappy = view(spark, sf_dir, "gappy_lineitem")
    found = s.sketched_profile(spark, _sketched(spark, gappy, 3)).filter("median IS NOT NULL")
    medians = {r["column"]: r["median"] for r in found.select("column", "median").collect()}
    off = 2 * s.rank_error()
    counted = gappy.agg(*[
        ((F.count_if(F.col(c) < m) <= (0.5 + off) * F.count(c)) & (F.count_if(F.col(c) <= m) >= (0.5 - off) * F.count(c))).alias(c)
        for c, m in medians.items()
    ])
    near = one_row_per_column(counted, {c: {"within_bound": c} for c in medians}).drop("ordinal")
    small = F.col("column").isin(*DIGITS)
    rounded = [F.when(small, F.round(c, 8)).otherwise(F.round(c, 5)).alias(c) for c in ("mean", "std")]
    return found.join(F.broadcast(near), "column").select("column", *rounded, "min", "max", "within_bound")


@check(f"WITH d AS ({view_sql('copied_events')}) SELECT count(*) AS rows, count(*) > 0 AS within_bound FROM d")
def duplicate_estimate_sketch(spark, sf_dir):
    """Copies from stored sketches of whole rows; the distinct rows are off by less than four standard errors."""
    copied = view(spark, sf_dir, "copied_events")
    found = s.sketched_duplicates(spark, _sketched(spark, copied, 2))
    exact = copied.distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    close = F.abs(F.col("rows") - F.col("duplicate_rows") - exact) <= 4 * s.rows_error() * exact
    return found.select("rows", close.alias("within_bound"))


@check("SELECT DISTINCT md5(text) AS text_md5, lang, source, n_chars FROM documents")
def stream_dedup_digest(spark, sf_dir):
    """Whole documents but their ids, each twice; the state holds digests."""
    path = fresh(spark)
    rows = _stream(spark, sf_dir, "documents").drop("doc_id")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    _finish(s.stream_to_parquet(s.stream_dedup(twice, key="digest"), path + "/out", path + "/state"))
    return spark.read.parquet(path + "/out").select(F.md5("text").alias("text_md5"), "lang", "source", "n_chars")
