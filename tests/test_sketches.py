import math
from pathlib import Path

import pytest

from burnish import streaming as s

SCHEMA = "`a b` string, x double, n int, tags array<string>"
ROWS = [("u", 1.0, 1, ["p"]), ("v", float("nan"), None, None), ("u", -0.0, 3, ["p"]), (None, 0.0, 3, []), ("u", 1.0, 1, ["p"])]


def profile(spark, store):
    return {r["column"]: r for r in s.sketched_profile(spark, store).collect()}


def test_counts_and_statistics(spark, frame, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    frame(SCHEMA, ROWS).repartition(3).write.parquet(folder)
    s.sketch_files(spark, folder, store)
    got = profile(spark, store)
    counts = {c: (r.ordinal, r.rows, r.missing_count, r.unique_values) for c, r in got.items()}
    assert counts == {"a b": (0, 5, 1, 2), "x": (1, 5, 1, 2), "n": (2, 5, 1, 2), "tags": (3, 5, 1, 2)}
    x = got["x"]
    assert (x.mean, x.min, x.max, x.missing_count, x.unique_values) == (0.5, 0.0, 1.0, 1, 2)
    assert math.isclose(x.std, (1 / 3) ** 0.5) and x.median in (0.0, 1.0)
    assert got["a b"].median is None and got["a b"].std is None
    row = s.sketched_duplicates(spark, store).first()
    assert (row.rows, row.duplicate_rows) == (5, 1)


def test_only_new_files_are_read(spark, frame, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    frame(SCHEMA, ROWS).coalesce(1).write.parquet(folder)
    s.sketch_files(spark, folder, store)
    # Whoever reads the old file again fails.
    for f in Path(folder).glob("*.parquet"):
        f.write_bytes(b"no parquet")
    frame(SCHEMA, ROWS[:2] + [("w", 9.0, 9, None)]).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema
    s.sketch_files(spark, folder, store, schema=schema)
    got = profile(spark, store)
    assert (got["x"].rows, got["x"].max, got["a b"].unique_values, got["n"].missing_count) == (8, 9.0, 3, 2)
    assert s.read_sketches(spark, store).select("file").distinct().count() == 2
    assert s.sketched_duplicates(spark, store).first().duplicate_rows == 3
    before = s.read_sketches(spark, store).count()
    s.sketch_files(spark, folder, store, schema=schema)
    assert s.read_sketches(spark, store).count() == before


def test_deviations_of_files_do_not_cancel(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.range(0, 1000, 1, 4).selectExpr("id % 2 + 1e9 AS v").write.parquet(folder)
    s.sketch_files(spark, folder, store)
    assert math.isclose(profile(spark, store)["v"].std, (250 / 999) ** 0.5, rel_tol=1e-6)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3, [(None, float("nan"), None, None)]])
def test_without_values(spark, frame, tmp_path, rows):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    frame(SCHEMA, rows).coalesce(1).write.parquet(folder)
    s.sketch_files(spark, folder, store)
    for r in s.sketched_profile(spark, store).collect():
        assert (r.rows, r.missing_count, r.unique_values, r.mean, r.median, r.std, r.min) == (len(rows), len(rows), 0, None, None, None, None)
    total = s.sketched_duplicates(spark, store).collect()
    assert [(r.rows, r.duplicate_rows) for r in total] == [(len(rows), max(len(rows) - 1, 0))]


def test_nothing_sketched_yet(spark, tmp_path):
    assert s.sketched_profile(spark, str(tmp_path)).count() == 0
    assert tuple(s.sketched_duplicates(spark, str(tmp_path)).first()) == (0, 0)


def test_a_table_with_maps_has_no_sketch_of_rows(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.range(4).selectExpr("id", "map('k', id) AS m").write.parquet(folder)
    s.sketch_files(spark, folder, store)
    got = profile(spark, store)
    assert (got["id"].unique_values, got["m"].unique_values, got["m"].missing_count) == (4, None, 0)
    assert s.sketched_duplicates(spark, store).first().duplicate_rows is None


def test_statistics_of_a_stream(spark, frame, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame("x double, t string", [(1e9 + i % 2, "a") for i in range(100)] + [(None, "b"), (float("nan"), "c")]).repartition(5).write.parquet(folder)
    stream = s.stream_scan(spark, folder, "x double, t string", file_format="parquet", max_files_per_trigger=1)
    s.stream_totals(s.stream_statistics(stream), out + "/t", out + "/s").awaitTermination()
    row = s.read_totals(spark, out + "/t").first()
    assert (row.column, row.filled, row.mean, row.min, row.max) == ("x", 100, 1e9 + 0.5, 1e9, 1e9 + 1)
    assert math.isclose(row.std, (25 / 99) ** 0.5, rel_tol=1e-6)
    with pytest.raises(ValueError, match="no numeric"):
        s.stream_statistics(stream.select("t"))
