"""Profiles, statistics, reports and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

import burnish as b
from burnish.functions import literal_rows
from burnish.operators.rules import EMAIL_PATTERN

from .registry import check
from .views import table, view, view_sql

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus"]
LINEITEM_NUMBERS = LINEITEM[:8]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
CUSTOMER = ["whole", "fraction", "exponent", "one_bad", "gaps", "nothing", "too_long", "c_mktsegment"]


def percent_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(CAST({part} AS DOUBLE) * 10000 / {whole}) / 100 ELSE 0.0 END"


def per_column(columns: list[str], select: str) -> str:
    """One SELECT per column: `{c}` is its name, `{i}` its position."""
    return " UNION ALL ".join(select.format(c=c, i=i) for i, c in enumerate(columns))


def missing_cells(columns: list[str]) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)


def table_counts_sql(source: str, columns: list[str]) -> str:
    return f"""
        SELECT total_rows, CAST({len(columns)} AS BIGINT) AS total_columns,
               total_rows * {len(columns)} AS total_cells, missing_cells,
               {percent_sql("missing_cells", f"(total_rows * {len(columns)})")} AS missing_percentage,
               total_rows > 50000 AS is_large_file
        FROM (SELECT count(*) AS total_rows, CAST({missing_cells(columns)} AS BIGINT) AS missing_cells FROM {source})"""


MISSING_SQL = per_column(
    LINEITEM,
    "SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\","
    " count(*) FILTER (WHERE {c} IS NULL) AS missing_count,"
    " " + percent_sql("count(*) FILTER (WHERE {c} IS NULL)", "count(*)") + " AS missing_percentage FROM d",
)


@check(f"WITH d AS ({view_sql('gappy_orders')}) {table_counts_sql('d', ORDERS)}")
def table_counts(spark, sf_dir):
    return b.table_counts(view(spark, sf_dir, "gappy_orders"))


@check(f"""WITH d AS ({view_sql('flag_lineitem')})
    SELECT t.*, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows
    FROM ({table_counts_sql('d', ['l_linenumber', 'l_quantity', 'l_discount', 'l_returnflag', 'l_linestatus'])}) t""")
def table_profile(spark, sf_dir):
    return b.table_profile(view(spark, sf_dir, "flag_lineitem"))


@check(f"WITH d AS ({view_sql('gappy_lineitem')}) {MISSING_SQL}")
def column_missing(spark, sf_dir):
    return b.column_missing(view(spark, sf_dir, "gappy_lineitem"))


UNIQUE_SQL = per_column(LINEITEM, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values FROM d")


def label_sql(count: str) -> str:
    return f"CASE WHEN {count} < 1000 THEN CAST({count} AS VARCHAR) ELSE '1000+' END"


@check(f"WITH d AS ({view_sql('gappy_lineitem')}) {UNIQUE_SQL}")
def unique_exact(spark, sf_dir):
    return b.distinct_counts(view(spark, sf_dir, "gappy_lineitem"))


@check(f"""WITH d AS ({view_sql('gappy_lineitem')}), n AS ({UNIQUE_SQL})
    SELECT "column", {label_sql('unique_values')} AS unique_values FROM n""")
def unique_labels(spark, sf_dir):
    return b.distinct_labels(view(spark, sf_dir, "gappy_lineitem"))


@check(f"""WITH d AS ({view_sql('gappy_lineitem')}) {UNIQUE_SQL.replace('AS unique_values', '> 0 AS within_bound')}""")
def unique_approx(spark, sf_dir):
    """The sketch's counts are off by less than a fifth of the exact ones, four times its standard error."""
    gappy = view(spark, sf_dir, "gappy_lineitem")
    exact = b.distinct_counts(gappy).withColumnRenamed("unique_values", "exact")
    close = F.abs(F.col("unique_values") - F.col("exact")) <= 0.2 * F.col("exact")
    return b.distinct_counts(gappy, exact=False).join(exact, "column").select("column", close.alias("within_bound"))


@check("WITH d AS (" + view_sql("gappy_orders") + ") " + per_column(
    ORDERS[1:],
    "SELECT '{c}' AS \"column\", (SELECT count(DISTINCT v) FROM ("
    "SELECT chunk, v, row_number() OVER (PARTITION BY chunk ORDER BY seen) AS r FROM ("
    "SELECT o_orderkey // 10000 AS chunk, CAST({c} AS VARCHAR) AS v, min(o_orderkey) AS seen FROM d"
    " WHERE {c} IS NOT NULL AND o_orderkey < 30000 GROUP BY ALL)) WHERE r <= 100) AS unique_values",
))
def unique_bounded(spark, sf_dir):
    return b.bounded_distinct(view(spark, sf_dir, "gappy_orders"), "o_orderkey")


SAMPLES_SQL = per_column(
    ORDERS[1:],
    "SELECT '{c}' AS \"column\", (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY o_orderkey) FROM ("
    "SELECT o_orderkey, {c} FROM d WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3)) AS sample_values",
)


@check(f"WITH d AS ({view_sql('gappy_orders')}) {SAMPLES_SQL}")
def sample_values(spark, sf_dir):
    samples = b.sample_values(view(spark, sf_dir, "gappy_orders"), "o_orderkey")
    joined = samples.select("column", F.array_join("sample_values", "|").alias("sample_values"))
    return joined.filter("column <> 'o_orderkey'")


@check(f"""WITH d AS ({view_sql('copied_orders')}),
    s AS (SELECT bucket, o_orderstatus, o_orderpriority FROM d ORDER BY row_idx LIMIT 10000)
    SELECT CAST(floor(((SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)))
        * (SELECT count(*) FROM d) / greatest((SELECT count(*) FROM s), 1)) AS BIGINT) AS duplicate_rows""")
def duplicate_estimate(spark, sf_dir):
    return b.duplicate_estimate(view(spark, sf_dir, "copied_orders"), "row_idx")


@check(f"""WITH d AS ({view_sql('copied_events')})
    SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows""")
def duplicate_exact(spark, sf_dir):
    return b.duplicate_rows(view(spark, sf_dir, "copied_events"))


@check("SELECT count(*) - count(DISTINCT text) AS duplicate_rows FROM documents")
def duplicate_exact_by_hash(spark, sf_dir):
    return b.duplicate_rows(table(spark, sf_dir, "documents").select("text"), strategy="hash")


def stats_sql(columns: list[str], source: str) -> str:
    return per_column(
        columns,
        "SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", round(avg(CAST({c} AS DOUBLE)), 8) AS mean,"
        " round(CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE), 6) AS median,"
        " round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,"
        f" CAST(max({{c}}) AS DOUBLE) AS max FROM {source}",
    )


def rounded(stats):
    return stats.select(
        "ordinal", "column", *[F.round(c, 8 if c == "mean" else 6).alias(c) for c in ("mean", "median", "std")], "min", "max"
    )


@check(f"WITH d AS ({view_sql('gappy_lineitem')}) {stats_sql(LINEITEM_NUMBERS, 'd')}")
def describe_numeric(spark, sf_dir):
    return rounded(b.describe_numeric(view(spark, sf_dir, "gappy_lineitem")))


@check(f"""WITH d AS (SELECT * FROM ({view_sql('gappy_orders')}) ORDER BY o_orderkey LIMIT 10000)
    {stats_sql(['o_orderkey', 'o_custkey', 'o_totalprice'], 'd')}""")
def describe_sample(spark, sf_dir):
    gappy = view(spark, sf_dir, "gappy_orders")
    return rounded(b.describe_numeric(gappy, sample_rows=10_000, order_by="o_orderkey"))


@check(f"WITH d AS ({view_sql('gappy_lineitem')}) " + per_column(
    LINEITEM_NUMBERS, "SELECT '{c}' AS \"column\", CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) AS median FROM d"))
def exact_median(spark, sf_dir):
    """The way for large tables, taken on the given ones by a small limit for one task."""
    gappy = view(spark, sf_dir, "gappy_lineitem")
    medians = b.exact_medians(gappy, LINEITEM_NUMBERS, one_task_rows=500)
    return literal_rows(spark, "column string, median double", list(medians.items()))


@check("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return b.preview(orders, order_by="o_orderkey")


@check(f"""WITH d AS ({view_sql('gappy_orders')})
    SELECT CAST(to_json({{'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus,
        'o_totalprice': o_totalprice, 'o_orderpriority': o_orderpriority}}) AS VARCHAR) AS record FROM d""")
def json_records(spark, sf_dir):
    return b.to_json_records(view(spark, sf_dir, "gappy_orders"))


NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
PROFILE_SQL = f"""
    WITH d AS ({view_sql('text_customer')}), n AS ({per_column(
        CUSTOMER,
        "SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, count(*) AS n,"
        " count(*) FILTER (WHERE {c} IS NULL) AS missing_count, count(DISTINCT {c}) AS u,"
        " count(*) FILTER (WHERE NOT regexp_matches({c}, '" + NUMBER.replace("{", "{{").replace("}", "}}") + "')) AS texts,"
        " count(*) FILTER (WHERE {c} IS NOT NULL AND NOT (regexp_matches({c}, '^\\s*[+-]?[0-9]+\\s*$')"
        " AND TRY_CAST(trim({c}) AS BIGINT) IS NOT NULL)) AS fractions,"
        " count(*) FILTER (WHERE {c} IS NOT NULL AND NOT (regexp_matches({c}, '^\\s*[+-]?[0-9]+\\s*$')"
        " AND TRY_CAST(trim({c}) AS UBIGINT) IS NOT NULL)) AS signed,"
        " (SELECT string_agg({c}, '|' ORDER BY c_custkey) FROM (SELECT c_custkey, {c} FROM d WHERE {c} IS NOT NULL"
        " ORDER BY c_custkey LIMIT 3)) AS samples FROM d",
    )})
    SELECT ordinal, name AS "column", 'string' AS declared_dtype,
           CASE WHEN texts > 0 THEN 'object' WHEN fractions = 0 AND missing_count < n THEN 'int64'
                WHEN signed = 0 AND missing_count < n THEN 'uint64' ELSE 'float64' END AS dtype,
           missing_count, {percent_sql('missing_count', 'n')} AS missing_percentage, {label_sql('u')} AS unique_values,
           coalesce(samples, '') AS sample_values
    FROM n"""


@check(PROFILE_SQL)
def column_profile(spark, sf_dir):
    profile = b.column_profile(view(spark, sf_dir, "text_customer"), "c_custkey")
    return profile.withColumn("sample_values", F.array_join("sample_values", "|"))


def profile_row_sql(i: int, c: str, declared: str, inferred: str) -> str:
    return f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS "column", '{declared}' AS declared_dtype,
        '{inferred}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
        {percent_sql(f"count(*) FILTER (WHERE {c} IS NULL)", "count(*)")} AS missing_percentage,
        {label_sql(f"count(DISTINCT {c})")} AS unique_values FROM d"""


DECLARED = {c: ("double", "float64") for c in LINEITEM} | {c: ("bigint", "int64") for c in LINEITEM[:3]}
DECLARED |= {"l_linenumber": ("int", "int64")} | {c: ("string", "object") for c in LINEITEM[8:]}


@check(f"WITH d AS ({view_sql('gappy_lineitem')}) " + " UNION ALL ".join(
    profile_row_sql(i, c, *DECLARED[c]) for i, c in enumerate(LINEITEM)))
def column_profile_lineitem(spark, sf_dir):
    return b.column_profile(view(spark, sf_dir, "gappy_lineitem"))


@check("""WITH d AS (SELECT embedding, label FROM embeddings) """ + " UNION ALL ".join(
    profile_row_sql(i, c, *kinds) for i, (c, kinds) in enumerate({"embedding": ("array<float>", "object"), "label": ("int", "int64")}.items())))
def column_profile_embeddings(spark, sf_dir):
    return b.column_profile(table(spark, sf_dir, "embeddings").select("embedding", "label"))


@check("WITH d AS (SELECT * FROM events) " + " UNION ALL ".join(
    profile_row_sql(i, c, *kinds) for i, (c, kinds) in enumerate({
        "event_id": ("bigint", "int64"), "ts": ("timestamp_ntz", "object"), "user_id": ("bigint", "int64"), "event_type": ("string", "object"),
        "value": ("double", "float64"), "props": ("string", "object")}.items())))
def column_profile_events(spark, sf_dir):
    return b.column_profile(table(spark, sf_dir, "events"))


@check("""WITH d AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE -o_totalprice END AS price, o_custkey % 3 AS few FROM orders)
    SELECT 'price' AS "column", CAST(median(CAST(price AS DOUBLE)) AS DOUBLE) AS median FROM d
    UNION ALL SELECT 'few', CAST(median(CAST(few AS DOUBLE)) AS DOUBLE) FROM d""")
def exact_median_frequent(spark, sf_dir):
    """Half of a column is one value, and its other values are distinct."""
    orders = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE -o_totalprice END AS price", "o_custkey % 3 AS few")
    medians = b.exact_medians(orders, ["price", "few"], one_task_rows=500)
    return literal_rows(spark, "column string, median double", list(medians.items()))


@check("""SELECT c_custkey, c_nationkey FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS c_custkey, c_custkey AS was, c_nationkey FROM customer)
    WHERE c_custkey IS NOT NULL""")
def first_rows_without_keys(spark, sf_dir):
    """Rows without a key come last: as many first rows as there are keys are those that have one."""
    customers = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS c_custkey", "c_nationkey")
    keys = customers.filter("c_custkey IS NOT NULL").count()
    every = b.first_n(customers, 2 * keys + 10, "c_custkey")
    if every.count() != customers.count():
        raise ValueError("rows without a key are lost")
    return b.first_n(customers, keys, "c_custkey")


REPORTED = {"o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64", "o_orderpriority": "object"}


def report_entry_sql(c: str, dtype: str) -> str:
    gaps = f"count(*) FILTER (WHERE {c} IS NULL)"
    first = f"SELECT {c}, o_orderkey FROM d WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3"
    fields = f"""'dtype': '{dtype}', 'missing_count': (SELECT {gaps} FROM d),
        'missing_percentage': (SELECT {percent_sql(gaps, "count(*)")} FROM d),
        'unique_values': (SELECT {label_sql(f"count(DISTINCT {c})")} FROM d),
        'sample_values': (SELECT list(CAST({c} AS VARCHAR) ORDER BY o_orderkey) FROM ({first}))"""
    if dtype != "object":
        fields += "".join(f", '{s}': (SELECT {f} FROM d)" for s, f in (
            ("mean", f"round(avg(CAST({c} AS DOUBLE)), 4)"), ("median", f"round(CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE), 4)"),
            ("std", f"round(stddev_samp(CAST({c} AS DOUBLE)), 4)"), ("min", f"CAST(min({c}) AS DOUBLE)"), ("max", f"CAST(max({c}) AS DOUBLE)")))
    return f"'{c}': {{{fields}}}"


STATISTICS = ("mean", "median", "std", "min", "max")


@check(f"""WITH d AS ({view_sql('gappy_orders')}), b AS (SELECT * EXCLUDE (o_orderkey) FROM d),
    t AS ({table_counts_sql('b', ORDERS[1:])}),
    r AS (SELECT to_json({{'total_rows': total_rows, 'missing_cells': missing_cells, 'is_large_file': is_large_file,
        'duplicate_rows': (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)),
        'column_analysis': {{{", ".join(report_entry_sql(c, t) for c, t in REPORTED.items())}}}}}) AS j FROM t)
    SELECT CAST(j->>'$.total_rows' AS BIGINT) AS total_rows, CAST(j->>'$.missing_cells' AS BIGINT) AS missing_cells,
        j->>'$.is_large_file' AS is_large_file, CAST(j->>'$.duplicate_rows' AS BIGINT) AS duplicate_rows,
        {", ".join(f"j->>'$.column_analysis.{c}.{f}' AS {c}_{f}" for c in REPORTED for f in ("dtype", "missing_count", "unique_values", "sample_values"))},
        {", ".join(f"round(CAST(j->>'$.column_analysis.{c}.{f}' AS DOUBLE), 4) AS {c}_{f}" for c, t in REPORTED.items() if t != "object" for f in STATISTICS)}
    FROM r""")
def quality_report_json(spark, sf_dir):
    """The report's JSON text, read back field by field."""
    report = b.quality_report_json(view(spark, sf_dir, "gappy_orders"), "o_orderkey")

    def at(path, kind="string"):
        return F.get_json_object("quality_report", f"$.{path}").cast(kind)

    fields = [at("total_rows", "bigint").alias("total_rows"), at("missing_cells", "bigint").alias("missing_cells"),
              at("is_large_file").alias("is_large_file"), at("duplicate_rows", "bigint").alias("duplicate_rows")]
    for c, t in REPORTED.items():
        fields += [at(f"column_analysis.{c}.{f}").alias(f"{c}_{f}") for f in ("dtype", "missing_count", "unique_values", "sample_values")]
        if t != "object":
            fields += [F.round(at(f"column_analysis.{c}.{f}", "double"), 4).alias(f"{c}_{f}") for f in STATISTICS]
    return report.select(*fields)


@check(f"""WITH d AS ({view_sql('gappy_orders')}), t AS ({table_counts_sql('d', ORDERS[1:])})
    SELECT total_columns, total_cells, missing_percentage,
        {", ".join(f"(SELECT {percent_sql(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} FROM d) AS {c}_missing_percentage" for c in REPORTED)}
    FROM t""")
def quality_report_json_totals(spark, sf_dir):
    """The fields of the report's JSON text that `quality_report_json` does not return."""
    report = b.quality_report_json(view(spark, sf_dir, "gappy_orders"), "o_orderkey")

    def at(path, kind):
        return F.get_json_object("quality_report", f"$.{path}").cast(kind)

    fields = [at(f, kind).alias(f) for f, kind in (("total_columns", "bigint"), ("total_cells", "bigint"), ("missing_percentage", "double"))]
    return report.select(*fields, *[at(f"column_analysis.{c}.missing_percentage", "double").alias(f"{c}_missing_percentage") for c in REPORTED])


@check(f"""SELECT dtype, count(*) AS columns FROM ({PROFILE_SQL}) GROUP BY dtype""")
def dtype_distribution(spark, sf_dir):
    return b.dtype_distribution(b.column_profile(view(spark, sf_dir, "text_customer").drop("c_custkey")))


@check(f"""WITH d AS ({view_sql('gappy_lineitem')}), t AS ({table_counts_sql('d', LINEITEM)})
    SELECT 'Complete' AS name, total_cells - missing_cells AS value FROM t
    UNION ALL SELECT 'Missing', missing_cells FROM t""")
def completeness_split(spark, sf_dir):
    return b.completeness_split(b.table_counts(view(spark, sf_dir, "gappy_lineitem")))


@check(f"""WITH d AS ({view_sql('gappy_lineitem')}), c AS ({MISSING_SQL})
    SELECT CASE WHEN length("column") > 12 THEN concat(substr("column", 1, 12), '...') ELSE "column" END AS name,
           missing_percentage AS missing, 100 - missing_percentage AS complete
    FROM c WHERE missing_percentage > 0 ORDER BY ordinal LIMIT 10""")
def missing_by_column(spark, sf_dir):
    return b.missing_by_column(b.column_missing(view(spark, sf_dir, "gappy_lineitem")))


@check(f"""WITH d AS ({view_sql('gappy_lineitem')}), c AS ({MISSING_SQL})
    SELECT "column", CASE WHEN missing_percentage = 0 THEN 'complete' WHEN missing_percentage < 10 THEN 'partial'
                     ELSE 'missing' END AS status, missing_percentage AS percentage
    FROM c ORDER BY ordinal LIMIT 10""")
def missing_heat_bucket(spark, sf_dir):
    return b.missing_heat_bucket(b.column_missing(view(spark, sf_dir, "gappy_lineitem")))


@check(f"""WITH d AS ({view_sql('contact_customer')}), n AS (
        SELECT count(*) FILTER (WHERE regexp_matches(email, '{EMAIL_PATTERN}')) AS valid,
               count(*) FILTER (WHERE NOT regexp_matches(email, '{EMAIL_PATTERN}')) AS invalid,
               count(*) FILTER (WHERE email IS NULL) AS missing FROM d)
    SELECT *, {percent_sql('valid', '(valid + invalid)')} AS valid_percentage FROM n""")
def regex_rule(spark, sf_dir):
    return b.regex_rule(view(spark, sf_dir, "contact_customer"), "email")


@check("SELECT md5(text) AS text_md5, count(*) AS occurrences FROM documents GROUP BY text HAVING count(*) > 1")
def unique_rule(spark, sf_dir):
    repeated = b.unique_rule(table(spark, sf_dir, "documents"), "text")
    return repeated.select(F.md5("text").alias("text_md5"), "occurrences")


@check("""SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def expire_rows(spark, sf_dir):
    return b.expire_rows(table(spark, sf_dir, "events"), "ts", "2024-01-10 00:00:00")


@check("""SELECT CAST(event_id AS VARCHAR) AS id, concat(event_type, '.csv') AS filename, ts AS upload_date,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
        user_id AS rows_processed, length(props) AS file_size
    FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 10""")
def recent_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS id",
        "concat(event_type, '.csv') AS filename",
        "ts AS upload_date",
        "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status",
        "user_id AS rows_processed",
        "CAST(length(props) AS BIGINT) AS file_size",
    )
    return b.recent_runs(runs)
