import pytest
from pyspark.sql import functions as F

import burnish as b


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def gappy(frame):
    return frame(
        "n double, i bigint, s string, z double",
        [(1.0, 1, "a", None), (None, None, "b", None), (4.0, 3, None, None), (4.0, None, "b", None)],
    )


def test_duplicates_treat_nulls_as_equal(frame):
    df = frame("a bigint, b string", [(1, "x"), (1, "x"), (2, None), (2, None), (3, "y")])
    kept = [(1, "x"), (2, None), (3, "y")]
    assert rows(b.remove_duplicates(df)) == sorted(kept, key=repr)
    assert rows(b.remove_duplicates(df, strategy="hash")) == sorted(kept, key=repr)
    assert rows(b.remove_duplicates(df, strategy="hash", max_lookup=1)) == sorted(kept, key=repr)
    assert b.duplicate_rows(df).first()[0] == b.duplicate_rows(df, strategy="hash").first()[0] == 2


def test_hash_duplicates_agree_on_signed_zero_nan_and_moved_nulls(frame):
    nan, null = float("nan"), None
    df = frame("a double, b double", [(0.0, null), (-0.0, null), (null, 0.0), (nan, 1.0), (nan, 1.0), (1.0, nan)])
    assert b.remove_duplicates(df, strategy="hash").count() == b.remove_duplicates(df).count() == 4


def test_hash_duplicates_with_nested_columns(spark):
    df = spark.sql("SELECT array(1, null) AS a, named_struct('x', 1.5D) AS s UNION ALL SELECT array(1, null), "
                   "named_struct('x', 1.5D) UNION ALL SELECT array(null, 1), named_struct('x', 1.5D)")
    assert b.remove_duplicates(df, strategy="hash").count() == 2


def test_drop_missing_takes_nan_for_missing(frame):
    df = frame("a double, s string", [(1.0, "x"), (float("nan"), "x"), (None, "x"), (2.0, None)])
    assert rows(b.drop_missing(df)) == [(1.0, "x")]


def test_fill_mean(gappy):
    out = b.fill_mean(gappy)
    assert dict(out.dtypes) == {"n": "double", "i": "double", "s": "string", "z": "double"}
    assert rows(out.select("n", "i")) == [(1.0, 1.0), (3.0, 2.0), (4.0, 2.0), (4.0, 3.0)]
    assert out.filter("z IS NOT NULL").count() == 0 and out.filter("s IS NULL").count() == 1


def test_fill_leaves_full_columns_alone(frame):
    df = frame("i bigint, n double", [(1, 1.0), (2, None)])
    assert dict(b.fill_mean(df).dtypes)["i"] == "bigint"


def test_fill_median(gappy):
    assert rows(b.fill_median(gappy).select("n", "i")) == [(1.0, 1.0), (4.0, 2.0), (4.0, 2.0), (4.0, 3.0)]
    assert b.fill_median(gappy, approximate=True).filter("n IS NULL").count() == 0


def test_fill_mode_takes_smallest_on_ties(frame):
    df = frame("s string, i int", [("b", 9), ("a", 10), ("a", None), ("b", 10), (None, 9)])
    filled = b.fill_mode(df)
    assert rows(filled) == sorted([("b", 9), ("a", 10), ("a", 9), ("b", 10), ("a", 9)], key=repr)
    assert dict(filled.dtypes)["i"] == "int"


def test_fill_mode_of_other_types(spark):
    df = spark.sql("SELECT * FROM VALUES (true, DATE'2024-01-01', array(1)), (NULL, NULL, NULL), "
                   "(true, DATE'2024-01-01', array(1)), (false, DATE'2023-01-01', array(2)) AS t(f, d, a)")
    filled = b.fill_mode(df)
    assert filled.na.drop().count() == 4
    assert filled.schema == df.schema


def test_fill_mode_of_empty_column_and_map(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS s, map('k', 1) AS m")
    assert rows(b.fill_mode(df)) == [(None, {"k": 1})]


def test_nan_is_filled(frame):
    df = frame("n double", [(1.0,), (float("nan"),), (3.0,)])
    for fill in (b.fill_mean, b.fill_median):
        assert rows(fill(df)) == [(1.0,), (2.0,), (3.0,)]


def test_fill_by_chunk(frame):
    df = frame("row_idx bigint, v double", [(0, 1.0), (1, None), (2, 10.0), (3, 30.0), (4, None), (5, None)])
    chunked = b.with_chunk(df, chunk_rows=2)
    out = b.fill_by_chunk(chunked, "fill_mean").orderBy("row_idx").select("v").collect()
    assert [r[0] for r in out] == [1.0, 1.0, 10.0, 30.0, None, None]
    with pytest.raises(ValueError):
        b.fill_by_chunk(chunked, "drop")


def test_trim_null_as_text(frame):
    df = frame("s string", [("  ",), (None,), (" x",)])
    assert rows(b.trim_whitespace(df)) == [("",), ("x",), (None,)]
    assert rows(b.trim_whitespace(df, null_as="nan")) == [("",), ("nan",), ("x",)]


def test_standardize_columns(spark):
    df = spark.range(1).selectExpr("id AS ` First Name `", "id AS `Last  Name`", "id AS `last  name `")
    assert b.standardize_columns(df).columns == ["first_name", "last__name", "last__name_1"]
    with pytest.raises(ValueError, match="equal"):
        b.standardize_columns(df, on_clash="error")


def test_convert_types(frame):
    df = frame(
        "w string, f string, bad string, none string, n double",
        [("1", "1.5", "1", None, 1.0), ("", "2", "x", None, None), (" 3 ", None, "2", None, 2.0)],
    )
    out = b.convert_types(df)
    assert dict(out.dtypes) == {"w": "bigint", "f": "double", "bad": "string", "none": "double", "n": "double"}
    assert rows(out.select("w")) == [(1,), (3,), (None,)]


def test_convert_types_sees_the_last_row(spark):
    """The first rows cannot prove a column numeric."""
    df = spark.range(0, 20_000, 1, 4).selectExpr("CASE WHEN id = 19999 THEN 'x' ELSE CAST(id AS STRING) END AS s")
    assert dict(b.convert_types(df).dtypes) == {"s": "string"}
    assert dict(b.convert_types(df.filter("s <> 'x'")).dtypes) == {"s": "bigint"}


def test_odd_column_names(frame):
    df = frame("`a.b` double, ` c ` string, `d``e` bigint", [(1.0, " x ", 1), (None, None, None), (1.0, " x ", 1)])
    out = b.clean(df, remove_duplicates=True, handle_missing="fill_mode", trim_whitespace=True, convert_types=True)
    assert rows(out) == [(1.0, "x", 1), (1.0, "x", 1)]
    for chosen in ({"handle_missing": "drop"}, {"handle_missing": "drop", "order_by": "a.b"}):
        assert b.clean(df, remove_duplicates=True, **chosen).count() == 1
    assert b.clean_summary(df, remove_duplicates=True, handle_missing="drop").first()["rows_out"] == 1
    assert b.clean(df, remove_duplicates=True, handle_missing="fill_median").filter("`a.b` = 1").count() == 2
    assert b.fill_median(df).count() == 3 and b.normalize_na(df).count() == 3
    assert b.column_profile(df).count() == 3 and b.table_profile(df).first()["duplicate_rows"] == 1
    assert b.describe_numeric(df).count() == 2


def test_clean_order_and_unknown_method(frame):
    df = frame("a string, b bigint", [(" 1 ", 1), (" 1 ", 1), (" 2", None), ("3", 5)])
    out = b.clean(df, b.CleanOptions(remove_duplicates=True, handle_missing="drop", trim_whitespace=True, convert_types=True))
    assert rows(out) == [(1, 1), (3, 5)]
    assert rows(b.clean(df, handle_missing="sideways")) == rows(df)
    assert rows(b.clean(df, handle_missing="fill_mean", remove_duplicates=True).select("b")) == [(1.0,), (3.0,), (5.0,)]


def test_first_of_equal_rows_stays(frame):
    df = frame("at bigint, v string", [(3, "x"), (1, "x"), (2, None), (5, None), (4, "y")])
    for strategy in ("rows", "hash"):
        out = b.clean(df, remove_duplicates=True, dedup_strategy=strategy, order_by="at")
        assert out.columns == ["at", "v"] and rows(out) == [(1, "x"), (2, None), (4, "y")]


def test_clean_with_hash_dedup(frame):
    df = frame("a string, b double", [("x", 1.0), ("x", 1.0), ("y", None), ("z", 4.0)])
    out = b.clean(df, remove_duplicates=True, dedup_strategy="hash", handle_missing="fill_mean")
    assert rows(out) == [("x", 1.0), ("y", 2.5), ("z", 4.0)]


def test_drop_decides_types(frame):
    """A bad value in a row that is dropped does not keep a column from becoming numeric."""
    df = frame("a string, b bigint", [("1", 1), ("x", None)])
    assert dict(b.clean(df, handle_missing="drop", convert_types=True).dtypes)["a"] == "bigint"
    assert dict(b.clean(df, convert_types=True).dtypes)["a"] == "string"


def test_trim_decides_types(frame):
    df = frame("a string", [(" 1\xa0",), ("2",)])
    assert dict(b.clean(df, convert_types=True).dtypes)["a"] == "string"
    assert rows(b.clean(df, trim_whitespace=True, convert_types=True)) == [(1,), (2,)]


def test_clean_by_chunk_in_scan_order(spark):
    df = spark.range(0, 100, 1, 4).selectExpr("CASE WHEN id % 10 = 9 THEN NULL ELSE id DIV 10 END AS v", "id")
    out = b.clean(df, handle_missing="fill_mean", scope="chunk", chunk_rows=10)
    assert out.columns == ["v", "id"]
    assert out.filter("v = id DIV 10").count() == 100
    with pytest.raises(ValueError):
        b.clean(df, handle_missing="fill_mean", scope="chunk", remove_duplicates=True)


def test_cleaning_twice_changes_nothing(gappy):
    for method in ("drop", "fill_mode"):
        once = b.clean(gappy, remove_duplicates=True, standardize_columns=True, handle_missing=method,
                       trim_whitespace=True, convert_types=True)
        twice = b.clean(once, remove_duplicates=True, standardize_columns=True, handle_missing=method,
                        trim_whitespace=True, convert_types=True)
        assert rows(once.distinct()) == rows(twice)


def test_summary_adds_up(frame):
    df = frame("a bigint, b string", [(1, "x"), (1, "x"), (2, None), (2, None), (3, "y")])
    got = b.clean_summary(df, remove_duplicates=True, handle_missing="drop").first().asDict()
    assert got == {"rows_in": 5, "rows_after_dedup": 3, "rows_out": 2, "duplicates_removed": 2, "missing_removed": 1}
    assert b.clean_summary(df).first()["rows_out"] == 5
    assert b.clean_summary(df.limit(0), remove_duplicates=True).first()["rows_in"] == 0


def test_options():
    assert b.CleanOptions.from_dict({"trim_whitespace": True, "other": 1, "handle_missing": None}).trim_whitespace
    with pytest.raises(ValueError):
        b.CleanOptions(scope="row")


def test_result_does_not_depend_on_partitions(gappy):
    for n in (1, 3, 7):
        shuffled = gappy.repartition(n)
        assert rows(b.fill_mode(shuffled)) == rows(b.fill_mode(gappy))
        assert rows(b.fill_median(shuffled)) == rows(b.fill_median(gappy))
    assert gappy.agg(F.count("*")).first()[0] == 4


def test_heavy_modes_are_proven(spark):
    from burnish.operators.heavy import heavy_modes, share_error

    assert share_error(10_000) == 3.5 / 16_384
    df = spark.range(60_000, numPartitions=6).selectExpr(
        "id AS a_key", "CASE WHEN id % 3 = 0 THEN 'ä' WHEN id % 3 = 1 THEN 'z' ELSE CAST(id AS STRING) END AS tied",
        "CASE WHEN id % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 4 = 1 THEN -0.0D WHEN id % 4 = 2 THEN 0.0D ELSE id END AS zeros",
        "CASE WHEN id % 50 = 0 THEN 7 ELSE id + 100 END AS two_percent", "id % 2 = 0 AS flag",
        "CASE WHEN id < 0 THEN 1 END AS none", "array(id % 2) AS listed", "DATE'2024-01-01' + CAST(id % 3 AS INT) AS day")
    found = heavy_modes(df, df.columns)
    day = found.pop("day")
    assert found == {"tied": "z", "zeros": 0.0, "two_percent": 7, "flag": False} and str(day) == "2024-01-01"
    # A summary of few values cannot prove a value of two percent, and says so.
    assert "two_percent" not in heavy_modes(df, ["two_percent"], tracked=100)
    same = b.fill_mode(df, ["tied", "zeros", "two_percent", "a_key"], heavy=False)
    assert b.fill_mode(df, ["tied", "zeros", "two_percent", "a_key"]).exceptAll(same).count() == 0


def test_heavy_modes_shuffle_summaries_only(spark):
    """One row a task leaves the scan, whatever the number of distinct values."""
    from burnish.operators import heavy

    df = spark.range(50_000, numPartitions=5).selectExpr("CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS v")
    sketch = df.agg(F.expr(f"approx_top_k(v, {heavy.CANDIDATES}, {heavy.TRACKED})"))
    assert sketch._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert heavy.heavy_modes(df, ["v"]) == {"v": -1}
