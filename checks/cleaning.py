"""Cleaning steps and whole cleaning runs."""

from __future__ import annotations

from pyspark.sql import functions as F

import burnish as b
from burnish.functions import col

from .profile import LINEITEM, ORDERS
from .registry import check
from .views import table, view, view_sql

GAPPY = f"WITH d AS ({view_sql('gappy_lineitem')})"
BLANKS = r"E' \t\n\r'"


@check(f"WITH d AS ({view_sql('copied_events')}) SELECT DISTINCT * FROM d")
def remove_duplicates(spark, sf_dir):
    return b.remove_duplicates(view(spark, sf_dir, "copied_events"))


@check("SELECT DISTINCT md5(text) AS text_md5, lang, source, n_chars FROM documents")
def remove_duplicates_by_hash(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").drop("doc_id")
    kept = b.remove_duplicates(documents, strategy="hash")
    return kept.select(F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@check(GAPPY + " SELECT * FROM d WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LINEITEM))
def drop_missing(spark, sf_dir):
    return b.drop_missing(view(spark, sf_dir, "gappy_lineitem"))


GAP_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice"]


def filled_sql(value: str) -> str:
    """Numeric columns with gaps filled by `value`, as double; the others as they are."""
    parts = [
        f"round(coalesce(CAST({c} AS DOUBLE), (SELECT {value.format(c=c)} FROM d)), 6) AS {c}" if c in GAP_NUMBERS else c
        for c in LINEITEM
    ]
    return f"{GAPPY} SELECT {', '.join(parts)} FROM d"


def rounded(df, names):
    return df.select(*[F.round(col(c), 6).alias(c) if c in names else col(c) for c in df.columns])


@check(filled_sql("avg(CAST({c} AS DOUBLE))"))
def fill_mean(spark, sf_dir):
    return rounded(b.fill_mean(view(spark, sf_dir, "gappy_lineitem")), GAP_NUMBERS)


@check(filled_sql("median(CAST({c} AS DOUBLE))"))
def fill_median(spark, sf_dir):
    return rounded(b.fill_median(view(spark, sf_dir, "gappy_lineitem")), GAP_NUMBERS)


@check(GAPPY + " SELECT " + ", ".join(
    f"coalesce({c}, (SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
    if c in [*GAP_NUMBERS, "l_returnflag"] else c
    for c in LINEITEM
) + " FROM d")
def fill_mode(spark, sf_dir):
    return b.fill_mode(view(spark, sf_dir, "gappy_lineitem"))


#: A column where two values share the lead, each in a quarter of the rows, a key with gaps, and one value in a third of the rows.
HEAVY = """SELECT CASE WHEN k % 4 = 0 THEN 'tie b' WHEN k % 4 = 1 THEN 'tie a' WHEN k % 4 = 2 THEN CAST(l_partkey AS VARCHAR) END AS tied,
    CASE WHEN k % 5 <> 0 THEN k END AS a_key, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN -1 ELSE l_suppkey END AS skewed
    FROM (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM {lineitem}) AS t"""


@check("WITH d AS (" + HEAVY.format(lineitem="lineitem") + ") SELECT " + ", ".join(
    f"coalesce({c}, (SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
    for c in ("tied", "a_key", "skewed")) + " FROM d")
def fill_mode_heavy(spark, sf_dir):
    """Modes of a skewed column, of one with a tie, and of a key, of which only the key's values are grouped."""
    text = HEAVY.replace("AS VARCHAR", "AS STRING").format(lineitem="{lineitem}")
    return b.fill_mode(spark.sql(text, lineitem=table(spark, sf_dir, "lineitem")))


@check("SELECT event_id, ts, event_type, row_number() OVER (ORDER BY hot, event_id) - 1 AS row_idx FROM (SELECT *, "
       "CASE WHEN event_id % 10 < 3 THEN TIMESTAMP '2020-01-01 00:00:00' ELSE ts END AS hot FROM events) AS t")
def row_index_by_time(spark, sf_dir):
    """Events numbered by time and, at the time that 30 % of them share, by arrival: ranges split such a key."""
    events = table(spark, sf_dir, "events").withColumn(
        "hot", F.expr("CASE WHEN event_id % 10 < 3 THEN TIMESTAMP_NTZ '2020-01-01 00:00:00' ELSE ts END"))
    return b.with_row_index(events, "hot", range_rows=2_000).select("event_id", "ts", "event_type", "row_idx")


def chunk_sql(value: str, names: list[str]) -> str:
    parts = [
        f"round(coalesce(CAST({c} AS DOUBLE), {value.format(c=c)} OVER (PARTITION BY o_orderkey // 10000)), 6) AS {c}"
        if c in names else c
        for c in ORDERS
    ]
    return f"WITH d AS ({view_sql('gappy_orders')}) SELECT {', '.join(parts)} FROM d"


def _by_chunk(spark, sf_dir, method):
    chunked = b.with_chunk(view(spark, sf_dir, "gappy_orders"), "o_orderkey")
    return b.fill_by_chunk(chunked, method).drop("chunk_id")


ORDER_NUMBERS = ["o_custkey", "o_totalprice"]


@check(chunk_sql("avg(CAST({c} AS DOUBLE))", ORDER_NUMBERS))
def fill_mean_chunk(spark, sf_dir):
    return rounded(_by_chunk(spark, sf_dir, "fill_mean"), ORDER_NUMBERS)


@check(chunk_sql("median(CAST({c} AS DOUBLE))", ORDER_NUMBERS))
def fill_median_chunk(spark, sf_dir):
    return rounded(_by_chunk(spark, sf_dir, "fill_median"), ORDER_NUMBERS)




def chunk_modes(c: str) -> str:
    return f"""m_{c} AS (SELECT chunk, {c} FROM (
        SELECT chunk, {c},
               row_number() OVER (PARTITION BY chunk ORDER BY n DESC, {c}) AS r
        FROM (SELECT o_orderkey // 10000 AS chunk, {c}, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1, 2))
        WHERE r = 1)"""


@check(f"WITH d AS ({view_sql('gappy_orders')}), " + ", ".join(chunk_modes(c) for c in ORDERS[1:4]) + """
    SELECT d.o_orderkey, coalesce(d.o_custkey, m_o_custkey.o_custkey) AS o_custkey,
           coalesce(d.o_orderstatus, m_o_orderstatus.o_orderstatus) AS o_orderstatus,
           coalesce(d.o_totalprice, m_o_totalprice.o_totalprice) AS o_totalprice, d.o_orderpriority
    FROM d """ + " ".join(f"LEFT JOIN m_{c} ON m_{c}.chunk = d.o_orderkey // 10000" for c in ORDERS[1:4]))
def fill_mode_chunk(spark, sf_dir):
    return _by_chunk(spark, sf_dir, "fill_mode")


PADDED = f"WITH d AS ({view_sql('padded_part')})"


@check(f"""{PADDED} SELECT " P Key ", trim("P  Name", {BLANKS}) AS "P  Name", trim(p_brand, {BLANKS}) AS p_brand,
    trim("Size", {BLANKS}) AS "Size" FROM d""")
def trim_whitespace(spark, sf_dir):
    return b.trim_whitespace(view(spark, sf_dir, "padded_part"))


@check(f"""{PADDED} SELECT " P Key ", coalesce(trim("P  Name", {BLANKS}), 'nan') AS "P  Name",
    trim(p_brand, {BLANKS}) AS p_brand, trim("Size", {BLANKS}) AS "Size" FROM d""")
def trim_whitespace_null_as_text(spark, sf_dir):
    return b.trim_whitespace(view(spark, sf_dir, "padded_part"), null_as="nan")


@check(f"""{PADDED} SELECT " P Key " AS p_key, "P  Name" AS p__name, p_brand, "Size" AS size FROM d""")
def standardize_columns(spark, sf_dir):
    return b.standardize_columns(view(spark, sf_dir, "padded_part"))


@check(f"""WITH d AS ({view_sql('text_customer')})
    SELECT c_custkey, CAST(whole AS BIGINT) AS whole, CAST(fraction AS DOUBLE) AS fraction,
           CAST(trim(exponent) AS DOUBLE) AS exponent, one_bad, CAST(gaps AS BIGINT) AS gaps,
           CAST(nothing AS DOUBLE) AS nothing, CAST(CAST(too_long AS HUGEINT) AS VARCHAR) AS too_long, c_mktsegment
    FROM d""")
def convert_types(spark, sf_dir):
    converted = b.convert_types(view(spark, sf_dir, "text_customer"))
    # All 64 bits: as text, since engines print such numbers alike.
    return converted.withColumn("too_long", F.col("too_long").cast("string"))


@check(f"""WITH d AS ({view_sql('gappy_orders')})
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           CASE WHEN o_orderpriority IN ('', 'N/A', '-1.#IND') THEN NULL ELSE o_orderpriority END AS o_orderpriority
    FROM d""")
def normalize_na(spark, sf_dir):
    return b.normalize_na(view(spark, sf_dir, "gappy_orders"))


@check(f"""WITH d AS (SELECT DISTINCT * FROM ({view_sql('copied_events')}))
    SELECT event_id, round(coalesce(CAST(user_id AS DOUBLE), (SELECT avg(CAST(user_id AS DOUBLE)) FROM d)), 6) AS user_id,
           event_type, round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value
    FROM d""")
def clean_table(spark, sf_dir):
    cleaned = b.clean(
        view(spark, sf_dir, "copied_events"),
        remove_duplicates=True,
        standardize_columns=True,
        handle_missing="fill_mean",
        trim_whitespace=True,
        convert_types=True,
    )
    return rounded(cleaned, ["user_id", "value"])


@check(f"""WITH d AS (SELECT DISTINCT * FROM ({view_sql('copied_events')}))
    SELECT event_id, coalesce(CAST(user_id AS DOUBLE), (SELECT median(CAST(user_id AS DOUBLE)) FROM d)) AS user_id,
           event_type, coalesce(value, (SELECT median(value) FROM d)) AS value FROM d""")
def clean_median(spark, sf_dir):
    return b.clean(view(spark, sf_dir, "copied_events"), remove_duplicates=True, handle_missing="fill_median")


@check(f"""{PADDED} SELECT DISTINCT " P Key " AS p_key, trim("P  Name", {BLANKS}) AS p__name,
    trim(p_brand, {BLANKS}) AS p_brand, CAST(trim("Size") AS BIGINT) AS size FROM d WHERE "P  Name" IS NOT NULL""")
def clean_drop(spark, sf_dir):
    return b.clean(
        view(spark, sf_dir, "padded_part"),
        remove_duplicates=True,
        standardize_columns=True,
        handle_missing="drop",
        trim_whitespace=True,
        convert_types=True,
    )


@check(chunk_sql("median(CAST({c} AS DOUBLE))", ORDER_NUMBERS))
def clean_by_chunk(spark, sf_dir):
    gappy = view(spark, sf_dir, "gappy_orders")
    cleaned = b.clean(gappy, handle_missing="fill_median", scope="chunk", order_by="o_orderkey")
    return rounded(cleaned, ORDER_NUMBERS)


@check(f"""WITH d AS ({view_sql('copied_events')}), u AS (SELECT DISTINCT * FROM d),
    n AS (SELECT (SELECT count(*) FROM d) AS rows_in, (SELECT count(*) FROM u) AS rows_after_dedup,
          (SELECT count(*) FROM u WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
           AND value IS NOT NULL) AS rows_out)
    SELECT *, rows_in - rows_after_dedup AS duplicates_removed, rows_after_dedup - rows_out AS missing_removed FROM n""")
def clean_summary(spark, sf_dir):
    return b.clean_summary(view(spark, sf_dir, "copied_events"), remove_duplicates=True, handle_missing="drop")


@check("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_idx FROM orders")
def row_index(spark, sf_dir):
    """Rows numbered by price; equal prices keep the order of the input."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return b.with_row_index(orders, "o_totalprice")


@check("SELECT o_orderkey, o_orderkey AS row_idx FROM orders")
def parquet_row_index(spark, sf_dir):
    """The table is stored in the order of its key, which starts at 0."""
    return b.scan_parquet(spark, sf_dir, "orders", row_index="row_idx").select("o_orderkey", "row_idx")


@check("""SELECT o_orderkey // 10000 AS chunk_id, count(*) AS rows_in_chunk, min(o_orderkey) AS first_key,
    max(o_orderkey) AS last_key FROM orders GROUP BY 1""")
def chunk_rows(spark, sf_dir):
    numbered = b.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    chunks = b.with_chunk(numbered).groupBy("chunk_id")
    return chunks.agg(
        F.count(F.lit(1)).alias("rows_in_chunk"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
    )


@check("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def first_rows(spark, sf_dir):
    return b.first_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 1000, "o_orderkey")
