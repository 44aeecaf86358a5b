import json
import random
import statistics

import pytest

import burnish as b
from burnish.operators.distinct import plentiful
from burnish.operators.probe import probe


def test_empty_table(frame):
    df = frame("k bigint, s string, n double", [])
    t = b.table_profile(df).first().asDict()
    assert t["total_rows"] == 0 and t["missing_percentage"] == 0.0 and t["duplicate_rows"] == 0
    profile = {r["column"]: r for r in b.column_profile(df, "k").collect()}
    assert profile["s"]["unique_values"] == "0" and profile["s"]["dtype"] == "object"
    assert profile["n"]["missing_percentage"] == 0.0 and profile["n"]["sample_values"] == []
    stats = b.describe_numeric(df).collect()
    assert [r["mean"] for r in stats] == [None, None]


def test_one_row_has_no_deviation(frame):
    row = b.describe_numeric(frame("n double", [(2.5,)])).first()
    assert (row["mean"], row["median"], row["std"], row["min"], row["max"]) == (2.5, 2.5, None, 2.5, 2.5)


def test_no_numeric_column(frame):
    assert b.describe_numeric(frame("s string, f boolean", [("x", True)])).count() == 0


def test_missing_cells_add_up(frame):
    df = frame("a bigint, n double, s string", [(1, float("nan"), None), (None, None, "x"), (3, 1.0, "y")])
    assert sum(r["missing_count"] for r in b.column_missing(df).collect()) == b.table_counts(df).first()["missing_cells"] == 4


def test_very_wide_table(spark):
    df = spark.range(3).selectExpr(*[f"CASE WHEN id = 0 THEN NULL ELSE id END AS c{i}" for i in range(1_500)])
    assert b.table_counts(df).first()["missing_cells"] == 1_500
    assert b.clean_summary(df, handle_missing="drop").first()["rows_out"] == 2


def test_inferred_types(frame):
    df = frame(
        "i string, f string, t string, g string, x string, e string, b boolean, n int",
        [("1", "1.5", "True", "true", "a", None, True, 1), ("2", "2", "false", None, "2", None, False, 2)],
    )
    got = {r["column"]: r["dtype"] for r in b.column_profile(df).collect()}
    assert got == {"i": "int64", "f": "float64", "t": "bool", "g": "object", "x": "object", "e": "float64",
                   "b": "bool", "n": "int64"}


def test_distinct_labels_around_the_cap(spark):
    df = spark.range(0, 50_000, 1, 4).selectExpr("id % 999 AS a", "id % 1000 AS b", "id AS c", "id DIV 100 AS d",
                                                 "CAST(NULL AS STRING) AS e")
    got = {r["column"]: r["unique_values"] for r in b.distinct_labels(df).collect()}
    assert got == {"a": "999", "b": "1000+", "c": "1000+", "d": "500", "e": "0"}


def test_sorted_column_is_found_by_the_sample(spark):
    df = spark.range(0, 2_000_000, 1, 4).selectExpr("id DIV 1000 AS v", "id % 7 AS w")
    assert probe(df, ["v", "w"]).many(1000) == []
    assert plentiful(df, ["v", "w"], 2_000_000) == ["v"]


def test_distinct_counts_by_type(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1.5D, 'a', true, DATE'2024-01-01', array(1)), "
                   "(2, CAST('NaN' AS DOUBLE), 'b', true, NULL, array(1)), (NULL, NULL, 'a', NULL, NULL, NULL) "
                   "AS t(i, n, s, f, d, a)")
    got = {r["column"]: r["unique_values"] for r in b.distinct_counts(df).collect()}
    assert got == {"i": 2, "n": 1, "s": 2, "f": 1, "d": 1, "a": 1}
    approx = {r["column"]: r["unique_values"] for r in b.distinct_counts(df, exact=False).collect()}
    assert approx == got


def test_samples_spill_over_and_reach_the_end(spark):
    """Values beyond the first rows are found, however far behind they are."""
    df = spark.range(0, 5_000, 1, 4).selectExpr(
        "id AS k", "CASE WHEN id >= 4998 THEN id END AS late", "CASE WHEN id % 2 = 1 THEN id END AS odd",
        "CAST(NULL AS STRING) AS never")
    got = {r["column"]: r["sample_values"] for r in b.sample_values(df, "k").collect()}
    assert got == {"k": ["0", "1", "2"], "late": ["4998", "4999"], "odd": ["1", "3", "5"], "never": []}
    assert {r["column"]: r["sample_values"] for r in b.column_profile(df, "k").collect()}["late"] == ["4998", "4999"]


def test_samples_far_apart_in_several_columns(spark):
    df = spark.range(0, 5_000, 1, 4).selectExpr(
        "named_struct('f', 'x', 'n', id) AS k", "CASE WHEN id % 1000 = 7 AND id > 500 THEN id END AS a",
        "CASE WHEN id IN (700, 1007, 4000, 4001) THEN id END AS b")
    got = {r["column"]: r["sample_values"] for r in b.sample_values(df, "k").collect()}
    assert got["a"] == ["1007", "2007", "3007"] and got["b"] == ["700", "1007", "4000"]


def test_first_rows(spark):
    df = spark.range(0, 30_000, 1, 8).selectExpr("(id * 7919) % 30000 AS k", "id AS v")
    for n in (1, 100, 101, 5_000, 30_000, 40_000):
        keys = [r["k"] for r in b.first_n(df, n, "k").collect()]
        assert keys == list(range(min(n, 30_000)))
    assert b.first_n(df, 0, "k").count() == 0
    assert b.preview(df).count() == 10


def test_duplicate_estimate_scales_the_sample(spark):
    df = spark.range(0, 1_000, 1, 4).selectExpr("id AS k", "CASE WHEN id < 100 THEN id DIV 2 ELSE id END AS v")
    assert b.duplicate_estimate(df, "k", sample_rows=100).first()[0] == 500
    assert b.duplicate_estimate(df, "k").first()[0] == 50


@pytest.mark.parametrize("limit", [10, 1_000, 100_000])
def test_exact_medians_on_hard_data(spark, limit):
    chance = random.Random(3)
    hot = [5.0 if chance.random() < 0.5 else chance.random() * 10 for _ in range(4_001)]
    wide = [chance.choice([-1, 1]) * 10 ** chance.uniform(-300, 300) for _ in range(4_001)]
    two = [1.0] * 2_000 + [2.0] * 2_000 + [None]
    rare = [0.0] * 2_001 + [chance.random() for _ in range(2_000)]
    ends = [float("inf"), float("-inf"), float("nan")] + [chance.gauss(0, 1) for _ in range(3_998)]
    empty = [None] * 4_001
    data = list(zip(hot, wide, two, rare, ends, empty, strict=True))
    df = spark.createDataFrame(data, "hot double, wide double, two double, rare double, ends double, empty double")
    got = b.exact_medians(df.repartition(5), df.columns, one_task_rows=limit)
    want = {
        n: statistics.median([v for v in values if v is not None and v == v])
        for n, values in zip(df.columns[:5], (hot, wide, two, rare, ends), strict=True)
    }
    assert got == {**want, "empty": None}


def test_approximate_medians(spark):
    df = spark.range(0, 3_000_000, 1, 4).selectExpr("id AS v", "CASE WHEN id % 2 = 0 THEN 7 END AS w")
    rows = {r["column"]: r for r in b.describe_numeric(df, approximate=True).collect()}
    assert rows["v"]["median"] == pytest.approx(1_500_000, rel=0.01) and rows["w"]["median"] == 7.0
    assert rows["v"]["max"] == 2_999_999


def test_report_json(frame):
    df = frame("k bigint, a.b string, n double".replace("a.b", "`a.b`"), [(0, "x", 1.0), (1, None, 2.0), (2, "x", None)])
    report = json.loads(b.quality_report_json(df, "k").first()[0])
    assert report["total_cells"] == 6 and report["missing_cells"] == 2 and report["is_large_file"] is False
    assert list(report["column_analysis"]) == ["a.b", "n"]
    assert report["column_analysis"]["a.b"] == {
        "dtype": "object", "missing_count": 1, "missing_percentage": 33.33, "unique_values": 1,
        "sample_values": ["x", "x"]}
    assert report["column_analysis"]["n"] == {
        "dtype": "float64", "missing_count": 1, "missing_percentage": 33.33, "unique_values": 2,
        "sample_values": ["1.0", "2.0"], "mean": 1.5, "median": 1.5, "std": pytest.approx(0.7071, abs=1e-4), "min": 1.0, "max": 2.0}


def test_report_of_many_values(spark):
    df = spark.range(3000).selectExpr("id AS k", "id AS many", "'a\"b' AS `qu\"ote`")
    report = json.loads(b.quality_report_json(df, "k", statistics=False).first()[0])
    assert report["column_analysis"]["many"]["unique_values"] == "1000+" and "mean" not in report["column_analysis"]["many"]
    assert report["column_analysis"]['qu"ote']["sample_values"] == ['a"b'] * 3


def test_medians_beside_a_frequent_value(spark):
    """Half the rows are zero and the rest distinct: no interval is left to one task."""
    df = spark.range(0, 400_001, 1, 4).selectExpr("CASE WHEN id % 2 = 0 THEN 0D ELSE -1D - id END AS v", "CASE WHEN id < 200000 THEN -5D - id ELSE 0D END AS w",
                                                 "CASE WHEN id < 200001 THEN 1D ELSE 2D + id END AS x")
    assert b.exact_medians(df, df.columns, one_task_rows=1_000) == {"v": 0.0, "w": 0.0, "x": 1.0}
    even = spark.range(0, 400_000, 1, 4).selectExpr("CASE WHEN id % 2 = 0 THEN 0D ELSE -1D - id END AS v")
    assert b.exact_medians(even, ["v"], one_task_rows=1_000) == {"v": -1.0}


def test_json_records(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS n, true AS f, 'x' AS s, CAST(NULL AS STRING) AS z, array(1, 2) AS a, "
                   "DATE'2024-01-01' AS d, CAST('NaN' AS DOUBLE) AS q")
    assert json.loads(b.to_json_records(df).first()[0]) == {
        "i": 1, "n": 1.5, "f": True, "s": "x", "z": None, "a": [1, 2], "d": "2024-01-01", "q": None}


def test_report_tables(frame):
    columns = frame(
        "ordinal int, column string, dtype string, missing_percentage double",
        [(0, "a_long_column_name", "object", 5.0), (1, "b", "int64", 0.0), (2, "c", "object", 10.0)],
    )
    assert sorted(tuple(r) for r in b.dtype_distribution(columns).collect()) == [("int64", 1), ("object", 2)]
    assert [r["name"] for r in b.missing_by_column(columns).collect()] == ["a_long_colum...", "c"]
    assert [r["name"] for r in b.missing_by_column(columns, order="missing").collect()] == ["c", "a_long_colum..."]
    assert [r["status"] for r in b.missing_heat_bucket(columns).collect()] == ["partial", "complete", "missing"]


def test_rules(frame):
    df = frame("e string, t string", [("a@b.co", "2024-01-01"), ("a@b", "2023-01-01"), (None, None), ("a@b.co", "2025-01-01")])
    assert tuple(b.regex_rule(df, "e").first()) == (2, 1, 1, 66.67)
    assert [tuple(r) for r in b.unique_rule(df, "e").collect()] == [("a@b.co", 2)]
    kept = b.expire_rows(df.withColumn("t", df["t"].cast("date")), "t", "2024-01-01")
    assert kept.count() == 3
