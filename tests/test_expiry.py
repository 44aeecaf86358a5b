from pathlib import Path

import pytest

import burnish as b

SCHEMA = "t date, v string"


def days(spark, folder, spans):
    """A file for each span of days."""
    for first, last in spans:
        rows = [(d, f"v{d}") for d in range(first, last)]
        spark.createDataFrame(rows, "d int, v string").selectExpr("date_add(DATE'2024-01-01', d) AS t", "v").coalesce(1).write.mode("append").parquet(folder)


def kept(spark, target):
    return sorted(r.v for r in b.read_kept(spark, target).collect())


def test_only_files_with_expired_rows_are_written_again(spark, tmp_path):
    folder, first, second = (str(tmp_path / n) for n in ("in put", "first", "second"))
    days(spark, folder, [(0, 5), (5, 15), (15, 20), (20, 25)])
    before = {f: f.read_bytes() for f in Path(folder).glob("*")}
    b.expire_rewrite(spark, folder, first, "t", "2024-01-11")
    assert kept(spark, first) == sorted(f"v{d}" for d in range(10, 25))
    listed = b.read_manifest(spark, first).collect()
    # The first file has expired as a whole, the second in part.
    assert sorted(r.carried for r in listed) == [False, True, True]
    assert all(("in put" in r.path) == r.carried for r in listed)
    b.expire_rewrite(spark, first, second, "t", "2024-01-18", files_at_once=1)
    assert kept(spark, second) == sorted(f"v{d}" for d in range(17, 25))
    assert [("in put" in r.path) for r in b.read_manifest(spark, second).filter("carried").collect()] == [True]
    assert before == {f: f.read_bytes() for f in Path(folder).glob("*")}


def test_files_without_expired_rows_are_not_read(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    days(spark, folder, [(0, 5), (100, 2000)])
    young = max(Path(folder).glob("*.parquet"), key=lambda f: f.stat().st_size)
    data = bytearray(young.read_bytes())
    data[4:200] = b"\0" * 196  # its pages cannot be read any more; its footer can
    young.write_bytes(bytes(data))
    Path(folder, f".{young.name}.crc").unlink()
    b.expire_rewrite(spark, folder, target, "t", "2024-01-04")
    with pytest.raises(Exception):
        b.read_kept(spark, target).collect()
    assert sorted(r.carried for r in b.read_manifest(spark, target).collect()) == [False, True]


def test_missing_times_empty_and_unfinished_tables(spark, frame, tmp_path):
    folder, target, nothing, left = (str(tmp_path / n) for n in ("in", "out", "nothing", "left"))
    frame(SCHEMA, [(None, "a"), (None, "b")]).write.parquet(folder)
    with pytest.raises(ValueError, match="no finished table"):
        b.read_kept(spark, target)
    b.expire_rewrite(spark, folder, target, "t", "2024-01-04")
    assert kept(spark, target) == ["a", "b"]
    with pytest.raises(ValueError, match="there is a table"):
        b.expire_rewrite(spark, folder, target, "t", "2024-01-04")
    frame(SCHEMA, []).write.parquet(nothing)
    b.expire_rewrite(spark, nothing, left, "t", "2024-01-04")
    assert kept(spark, left) == [] and b.read_kept(spark, left).columns == ["t", "v"]


def test_partitioned_folders_are_refused(spark, frame, tmp_path):
    folder = str(tmp_path / "in")
    frame("t string, v string", [("2024", "a")]).write.partitionBy("v").parquet(folder)
    with pytest.raises(ValueError, match="partitioned"):
        b.expire_rewrite(spark, folder, str(tmp_path / "out"), "t", "2025")
