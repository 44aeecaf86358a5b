"""Tables made dirty by the same SQL text in Spark and in the other engine.

The given tables have no gaps, padding or copies, so each view adds some by rules on integer keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Gaps in numbers and texts; many row copies once the keys are left out.
    "gappy_lineitem": """
        SELECT l_orderkey, l_partkey, l_suppkey,
               CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber,
               CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
               CASE WHEN l_suppkey % 9 = 4 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
               l_discount, l_tax,
               CASE WHEN l_orderkey % 3 = 0 AND l_linenumber < 4 THEN NULL ELSE l_returnflag END AS l_returnflag,
               l_linestatus
        FROM {lineitem}""",
    "flag_lineitem": """
        SELECT CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber,
               l_quantity, l_discount, l_returnflag, l_linestatus
        FROM {lineitem}""",
    # Dense row number o_orderkey, gaps and missing-value tokens.
    "gappy_orders": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS o_custkey,
               CASE WHEN o_orderkey < 1500 OR o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' WHEN o_orderkey % 17 = 0 THEN ''
                    WHEN o_orderkey % 19 = 0 THEN '-1.#IND' WHEN o_orderkey % 23 = 0 THEN ' NA'
                    ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    # Natural copies: few distinct rows, in the order of a dense row number.
    "copied_orders": """
        SELECT o_orderkey AS row_idx, o_custkey % 40 AS bucket, o_orderstatus,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    # Every event twice, and as many copies of one row again: a third of the table.
    "copied_events": """
        SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id, event_type,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value
        FROM {events}
        UNION ALL
        SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id, event_type,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value
        FROM {events}
        UNION ALL
        SELECT -1 AS event_id, NULL AS user_id, 'hot' AS event_type, 1.5 AS value
        FROM {events}""",
    # Padded texts and odd column names.
    "padded_part": """
        SELECT p_partkey AS " P Key ",
               CASE WHEN p_partkey % 3 = 0 THEN concat('  ', p_name, '   ')
                    WHEN p_partkey % 5 = 0 THEN concat(p_name, '	')
                    WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS "P  Name",
               CASE WHEN p_partkey % 4 = 0 THEN concat(' ', p_brand) ELSE p_brand END AS p_brand,
               concat(' ', CAST(p_size AS STRING), ' ') AS "Size"
        FROM {part}""",
    # Numbers written as text: whole, with fractions, with one bad value, with gaps, none at all.
    "text_customer": """
        SELECT c_custkey,
               CAST(c_nationkey AS STRING) AS whole,
               concat(CAST(c_nationkey AS STRING), '.5') AS fraction,
               CASE WHEN c_custkey % 2 = 0 THEN concat(CAST(c_nationkey AS STRING), 'e1')
                    ELSE concat(' +', CAST(c_nationkey AS STRING), ' ') END AS exponent,
               CASE WHEN c_custkey = 140 THEN '12d' ELSE CAST(c_nationkey AS STRING) END AS one_bad,
               CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE concat('00', CAST(c_nationkey AS STRING)) END AS gaps,
               CAST(NULL AS STRING) AS nothing,
               CASE WHEN c_custkey = 77 THEN '9223372036854775808' ELSE '1' END AS too_long,
               c_mktsegment
        FROM {customer}""",
    "contact_customer": """
        SELECT c_custkey,
               CASE WHEN c_custkey % 9 = 0 THEN NULL
                    WHEN c_custkey % 5 = 0 THEN concat('user ', CAST(c_custkey AS STRING))
                    WHEN c_custkey % 7 = 0 THEN concat('u', CAST(c_custkey AS STRING), '@host')
                    ELSE concat('u.', CAST(c_custkey AS STRING), '@mail.example') END AS email
        FROM {customer}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {part.split("}")[0] for part in text.split("{")[1:]}
    return spark.sql(text.replace('"', "`"), **{t: table(spark, sf_dir, t) for t in tables})


def view_sql(name: str) -> str:
    return VIEWS[name].replace("{", "").replace("}", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
