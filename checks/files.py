"""CSV files written from the given tables and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

import burnish as b
from burnish.functions import literal_rows
from burnish.sources import working_dir

from .registry import check
from .views import table, view, view_sql


def fresh(spark) -> str:
    """A new folder that all executors share."""
    return f"{working_dir(spark)}/checks-{uuid4().hex}"


NORMALIZED = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    CASE WHEN o_orderpriority IN ('', 'N/A', '-1.#IND') THEN NULL ELSE o_orderpriority END AS o_orderpriority
    FROM ({view_sql('gappy_orders')})"""


@check(f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
    o_orderpriority FROM ({NORMALIZED})""")
def csv_as_text(spark, sf_dir):
    path = fresh(spark)
    b.write_csv(view(spark, sf_dir, "gappy_orders").drop("o_totalprice"), path)
    return b.scan_csv(spark, path)


@check(f"""SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
    o_orderkey % 2 = 0 AS even FROM ({NORMALIZED})""")
def csv_typed(spark, sf_dir):
    path = fresh(spark)
    b.write_csv(view(spark, sf_dir, "gappy_orders").withColumn("even", F.expr("o_orderkey % 2 = 0")), path)
    return b.scan_csv_typed(spark, path)


@check("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang FROM documents")
def csv_line_breaks(spark, sf_dir):
    """Whole texts with quotes, separators and line breaks, written and read back."""
    path = fresh(spark)
    b.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    read = b.scan_csv(spark, path, na=False)
    return read.select("doc_id", F.md5("text").alias("text_md5"), "lang")


def lines_with_headers(df, header: str):
    """Lines (value) with the header before the first row of each partition: its low 33 bits number a partition's rows."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    return df.select(F.when(first, F.concat(F.lit(header), "value")).otherwise(F.col("value")).alias("value"))


@check("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents")
def csv_line_breaks_split(spark, sf_dir):
    """Texts with line breaks in files that Spark may split anywhere, numbered in the order of files and lines."""
    path = fresh(spark)
    text = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = table(spark, sf_dir, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), text, "lang").alias("value"), "doc_id")
    lines_with_headers(rows.orderBy("doc_id"), "doc_id,text,lang\n").write.text(path)
    read = b.with_row_index(b.scan_csv(spark, path, na=False, position="at"), "at")
    return read.select("doc_id", F.md5("text").alias("text_md5"), "lang", "row_idx")


def _uneven_lines(spark, sf_dir) -> str:
    """Lines of four fields, but with one, two or none too many or too few."""
    path = fresh(spark)
    lines = table(spark, sf_dir, "part").selectExpr(
        """concat_ws(',', CAST(p_partkey AS STRING), concat('"', p_name, ', x"'), p_brand,
           CASE WHEN p_partkey % 10 = 1 THEN concat(p_type, ',more') WHEN p_partkey % 10 = 2 THEN concat(p_type, ',,')
                WHEN p_partkey % 10 = 3 THEN NULL WHEN p_partkey % 10 = 4 THEN ',,9' ELSE p_type END) AS value"""
    )
    # One column of whole lines; its name is the header, and no character in it needs quoting.
    lines.toDF("key,name,brand,type").write.options(header=True, sep="\x01", quote="\x02").csv(path)
    return path


@check("""SELECT CAST(p_partkey AS VARCHAR) AS key, concat(p_name, ', x') AS name, p_brand AS brand,
    CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE p_type END AS type
    FROM part WHERE p_partkey % 10 NOT IN (1, 2, 4)""")
def csv_skip_bad_lines(spark, sf_dir):
    return b.scan_csv(spark, _uneven_lines(spark, sf_dir), bad_lines="skip")


@check("SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS text_sha256, lang FROM documents")
def csv_crlf(spark, sf_dir):
    """Lines that end with a carriage return and a line feed; line feeds in fields are kept."""
    path = fresh(spark)
    lines = table(spark, sf_dir, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('",'), "lang").alias("value"))
    lines_with_headers(lines, "doc_id,text,lang\r\n").write.option("lineSep", "\r\n").text(path)
    read = b.scan_csv(spark, path, na=False)
    return read.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang")


@check("""SELECT CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def csv_one_column(spark, sf_dir):
    """A table of one column with gaps, written and read back: no row is lost."""
    path = fresh(spark)
    b.write_csv(table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus"), path)
    return b.scan_csv(spark, path)


@check("""SELECT count(*) AS refused FROM (SELECT 1 WHERE EXISTS (SELECT * FROM part WHERE p_partkey % 10 IN (1, 2, 4)))""")
def csv_strict(spark, sf_dir):
    """A scan that accepts no line of another width fails, and says why."""
    try:
        b.scan_csv(spark, _uneven_lines(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        refused = 0
    except Exception as e:
        if "more than 4 fields" not in str(e):
            raise
        refused = 1
    return literal_rows(spark, "refused bigint", [(refused,)])


@check(f"""WITH d AS (SELECT DISTINCT * FROM ({view_sql('copied_events')}))
    SELECT count(*) AS rows_processed, count(*) FILTER (WHERE event_id IS NOT NULL AND user_id IS NOT NULL
        AND event_type IS NOT NULL AND value IS NOT NULL) AS rows_out,
        (SELECT count(*) FROM ({view_sql('copied_events')})) - count(*) AS duplicates_removed,
        count(*) FILTER (WHERE user_id IS NULL OR value IS NULL) AS missing_removed FROM d""")
def clean_to_csv(spark, sf_dir):
    """Rows counted while writing must be the rows in the files."""
    path = fresh(spark)
    result = b.clean_to_csv(
        view(spark, sf_dir, "copied_events"), path, remove_duplicates=True, handle_missing="drop"
    )
    written = b.scan_csv(spark, path).agg(F.count(F.lit(1)).alias("rows_out"))
    counts = ("rows_processed", "duplicates_removed", "missing_removed")
    return written.select(*[F.lit(getattr(result, c)).cast("bigint").alias(c) for c in counts], "rows_out")


@check("""SELECT 'orders' AS id, 'orders.csv' AS filename, 'completed' AS status, count(*) AS rows_processed FROM orders
    UNION ALL SELECT 'part', 'part.csv', 'completed', count(*) FROM part""")
def run_log(spark, sf_dir):
    """One cleaning run per table, logged and read back."""
    path = fresh(spark)
    for name in ("orders", "part"):
        result = b.clean_to_csv(table(spark, sf_dir, name), f"{path}/{name}.csv", handle_missing="drop")
        b.append_run(spark, path + "/log", id=name, filename=f"{name}.csv", status="completed",
                     rows_processed=result.rows_processed)
    return b.recent_runs(b.read_runs(spark, path + "/log")).select("id", "filename", "status", "rows_processed")


def _event_files(spark, sf_dir) -> str:
    """Rows of the table with copies and gaps, in eight files."""
    path = fresh(spark)
    view(spark, sf_dir, "copied_events").repartition(8).write.parquet(path)
    return path


DISTINCT_EVENTS = f"SELECT DISTINCT * FROM ({view_sql('copied_events')})"


@check(f"""WITH d AS ({DISTINCT_EVENTS}) SELECT event_id, event_type,
    coalesce(CAST(user_id AS DOUBLE), (SELECT median(user_id) FROM d)) AS user_id,
    coalesce(value, (SELECT median(value) FROM d)) AS value FROM d""")
def clean_ranges(spark, sf_dir):
    """A folder cleaned file by file, with fill values of the whole table."""
    return b.clean_in_ranges(spark, _event_files(spark, sf_dir), fresh(spark), bytes_per_range=1,
                             remove_duplicates=True, handle_missing="fill_median")


@check(f"""WITH d AS ({view_sql('copied_events')}), n AS (SELECT count(*) AS n,
        count(*) FILTER (WHERE user_id IS NOT NULL AND value IS NOT NULL) AS kept FROM d)
    SELECT CAST(8 AS BIGINT) AS ranges, n AS rows_processed, kept AS rows_out, n AS last_processed, kept AS last_out, kept AS written FROM n""")
def clean_ranges_log(spark, sf_dir):
    """The log of finished ranges adds up to the rows read and the rows written."""
    path = fresh(spark)
    rows = b.clean_in_ranges(spark, _event_files(spark, sf_dir), path, bytes_per_range=1, handle_missing="drop")
    log = b.clean_progress(spark, path)
    totals = log.agg(F.count(F.lit(1)).alias("ranges"), F.sum("rows_processed").alias("rows_processed"), F.sum("rows_out").alias("rows_out"),
                     F.max("rows_processed_so_far").alias("last_processed"), F.max("rows_out_so_far").alias("last_out"))
    return totals.withColumn("written", rows.agg(F.count(F.lit(1)).alias("written")).scalar())


ORDER_FILES = """SELECT o_custkey % 40 AS part, count(*) AS n, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS length
    FROM orders GROUP BY o_custkey % 40"""


@check(f"""WITH f AS ({ORDER_FILES})
    SELECT CAST(part AS INTEGER) AS part, length, n FROM f WHERE part % 3 > 0 AND length <= (SELECT CAST(sum(length) // 40 AS BIGINT) FROM f)""")
def admit_files(spark, sf_dir):
    """Orders as files of two kinds; of one kind, those up to a fortieth of all bytes, and the rows that are read from them."""
    path = fresh(spark)
    lines = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey % 40 AS INT) AS part", "CAST(o_orderkey AS STRING) AS value").repartition("part")
    lines.filter("part % 3 > 0").write.partitionBy("part").csv(path)
    lines.filter("part % 3 = 0").write.partitionBy("part").mode("append").text(path)
    most = lines.agg(F.expr("sum(length(value) + 1) div 40")).first()[0]
    part = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("int")
    admitted = b.admit_files(spark, path, max_bytes=most).select(part.alias("part"), "length")
    rows = spark.read.text(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return admitted.join(rows, "part")


@check("SELECT round(sum(strlen(coalesce(text, '')) + 1) / 1048576.0, 2) AS size_mb FROM documents")
def size_mb(spark, sf_dir):
    """The size of whole texts written as files."""
    path = fresh(spark)
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return b.size_mb(spark, path)


@check("SELECT event_id, user_id, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def expire_rewrite(spark, sf_dir):
    """Events in files by time; two cutoffs one after the other, and the rows of the second table."""
    folder, first, second = fresh(spark), fresh(spark), fresh(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    events.repartitionByRange(8, "ts").write.parquet(folder)
    b.expire_rewrite(spark, folder, first, "ts", "2024-01-10 00:00:00")
    b.expire_rewrite(spark, first, second, "ts", "2024-01-20 00:00:00", files_at_once=1)
    return b.read_kept(spark, second)
