import signal
import subprocess
import sys
from pathlib import Path

import pytest

import burnish as b

ROOT = Path(__file__).resolve().parents[1]
ROWS = [(i, None if i % 5 == 0 else i % 7, f" {i} " if i % 2 else str(i), None if i % 4 == 0 else "xy"[i % 2]) for i in range(60)]
SCHEMA = "id bigint, n int, `a text` string, kind string"


@pytest.fixture
def folder(spark, frame, tmp_path):
    path = str(tmp_path / "in")
    frame(SCHEMA, ROWS + ROWS[:20]).repartition(6).write.parquet(path)
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("chosen", [
    {"handle_missing": "drop", "trim_whitespace": True},
    {"handle_missing": "fill_mean", "convert_types": True, "trim_whitespace": True},
    {"handle_missing": "fill_mode", "standardize_columns": True},
    {"remove_duplicates": True, "handle_missing": "fill_median", "standardize_columns": True, "convert_types": True},
    {"remove_duplicates": True},
    {},
])
def test_same_rows_as_at_once(spark, folder, tmp_path, chosen):
    out = b.clean_in_ranges(spark, folder, str(tmp_path / "out"), bytes_per_range=1, **chosen)
    want = b.clean(spark.read.parquet(folder), **chosen)
    assert (out.columns, [t for _, t in out.dtypes]) == (want.columns, [t for _, t in want.dtypes])
    assert rows_of(out) == rows_of(want)


def test_goes_on_after_a_failure(spark, folder, tmp_path):
    path, seen = str(tmp_path / "out"), []

    def stop(number, read, written):
        seen.append(number)
        if number == 2:
            raise RuntimeError("broken off")

    chosen = {"handle_missing": "fill_mean", "bytes_per_range": 1}
    with pytest.raises(Exception, match="broken off"):
        b.clean_in_ranges(spark, folder, path, report=stop, **chosen)
    assert [r.range for r in b.clean_progress(spark, path).orderBy("range").collect()] == [0, 1, 2]
    first = {f: f.stat().st_mtime_ns for i in (0, 1) for f in Path(f"{path}/rows/burnish_range={i}").glob("*.parquet")}
    again = []
    out = b.clean_in_ranges(spark, folder, path, report=lambda *r: again.append(r[0]), **chosen)
    assert (seen, again) == ([0, 1, 2], [2, 3, 4, 5])
    assert first == {f: f.stat().st_mtime_ns for f in first}
    assert rows_of(out) == rows_of(b.clean(spark.read.parquet(folder), handle_missing="fill_mean"))
    last = b.clean_progress(spark, path).orderBy("range").collect()[-1]
    assert last.rows_out_so_far == last.rows_processed_so_far == 80
    # Finished: nothing is left to do.
    assert rows_of(b.clean_in_ranges(spark, folder, path, report=stop, **chosen)) == rows_of(out)


KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession
import burnish as b
folder, path = sys.argv[1:]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
def stop(number, read, written):
    if number == 3:
        os.kill(os.getpid(), signal.SIGKILL)
b.clean_in_ranges(spark, folder, path, bytes_per_range=1, handle_missing="fill_median", report=stop)
"""


def test_goes_on_after_the_driver_was_killed(spark, folder, tmp_path):
    path = str(tmp_path / "out")
    parts = str(tmp_path / "parts")
    for i in range(6):
        spark.read.parquet(folder).filter(f"id % 6 = {i}").coalesce(1).write.mode("append").parquet(parts)
    done = subprocess.run([sys.executable, "-c", KILLED, parts, path], cwd=ROOT, capture_output=True, timeout=120)
    assert done.returncode == -signal.SIGKILL, done.stderr.decode()[-2000:]
    assert b.clean_progress(spark, path).count() == 4
    again = []
    out = b.clean_in_ranges(spark, parts, path, bytes_per_range=1, handle_missing="fill_median", report=lambda *r: again.append(r[0]))
    assert again == [3, 4, 5]
    assert rows_of(out) == rows_of(b.clean(spark.read.parquet(parts), handle_missing="fill_median"))


def test_other_files_or_options_are_refused(spark, frame, folder, tmp_path):
    path = str(tmp_path / "out")
    b.clean_in_ranges(spark, folder, path, handle_missing="drop")
    with pytest.raises(ValueError, match="other options or other files"):
        b.clean_in_ranges(spark, folder, path, handle_missing="fill_mean")
    frame(SCHEMA, ROWS[:1]).write.mode("append").parquet(folder)
    with pytest.raises(ValueError, match="other options or other files"):
        b.clean_in_ranges(spark, folder, path, handle_missing="drop")


def test_csv(spark, folder, tmp_path):
    files = str(tmp_path / "csv")
    b.write_csv(spark.read.parquet(folder), files)
    chosen = {"convert_types": True, "trim_whitespace": True, "handle_missing": "drop"}
    out = b.clean_in_ranges(spark, files, str(tmp_path / "out"), file_format="csv", bytes_per_range=1, **chosen)
    want = b.clean(b.scan_csv(spark, files), **chosen)
    assert out.dtypes == want.dtypes and rows_of(out) == rows_of(want)


def test_empty_table(spark, frame, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    frame(SCHEMA, []).write.parquet(folder)
    assert b.clean_progress(spark, path).count() == 0
    out = b.clean_in_ranges(spark, folder, path, handle_missing="fill_mean", trim_whitespace=True)
    assert out.count() == 0 and out.columns == ["id", "n", "a text", "kind"]
    assert b.clean_progress(spark, path).filter("rows_out > 0").count() == 0


def test_chunks_are_refused(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="no chunks"):
        b.clean_in_ranges(spark, folder, str(tmp_path / "out"), handle_missing="fill_mean", scope="chunk")
