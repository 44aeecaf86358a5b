import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import burnish as b
from burnish.sources.csv import header_names


@pytest.fixture
def csv(tmp_path):
    def write(text, name="in.csv", folder="in"):
        directory = tmp_path / folder
        directory.mkdir(exist_ok=True)
        (directory / name).write_bytes(text.encode())
        return str(directory / name)

    return write


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_headers(spark, csv):
    assert header_names(spark, csv("a,a,,b \n1,2,3,4\n")) == ["a", "a.1", "Unnamed: 2", "b "]
    assert header_names(spark, csv("﻿x,\"y\n,z\"\n1,2\n")) == ["x", "y\n,z"]
    df = b.scan_csv(spark, csv("a,a,,A\n1,2,3,4\n"))
    assert df.columns == ["a", "a.1", "Unnamed: 2", "A.2"] and rows(df) == [("1", "2", "3", "4")]


TRICKY = 'a,b\n"x, y","say ""hi"""\n\n"line\nbreak",2\n\n3,\n'


def test_quotes_and_line_breaks(spark, csv):
    want = sorted([("x, y", 'say "hi"'), ("line\nbreak", "2"), ("3", None)], key=repr)
    for multi_line in (None, True):
        assert rows(b.scan_csv(spark, csv(TRICKY), multi_line=multi_line)) == want


def test_line_breaks_are_looked_for_per_file(spark, csv):
    first = csv(TRICKY, "a b.csv", "many")
    csv("a,b\n5,6\n", "c%20d.csv", "many")
    folder = first.rsplit("/", 1)[0]
    df = b.scan_csv(spark, folder)
    assert df.count() == 4 and df.filter("a = '5'").count() == 1


def test_position_orders_rows_by_file(spark, csv):
    for name, count in (("a", 5), ("b", 3_000), ("c", 40)):
        path = csv("v\n" + "".join(f"{name}{i:04}\n" for i in range(count)), f"{name}.csv", "many")
    df = b.scan_csv(spark, path.rsplit("/", 1)[0], position="at")
    want = [f"a{i:04}" for i in range(5)] + [f"b{i:04}" for i in range(3_000)] + [f"c{i:04}" for i in range(40)]
    assert [r["v"] for r in b.first_n(df, 7, "at").collect()] == want[:7]
    assert [r["v"] for r in b.first_n(df, 1_000, "at").collect()] == want[:1_000]
    assert [r["v"] for r in b.with_row_index(df, "at").orderBy("row_idx").collect()] == want
    assert b.sample_values(df, "at").filter("column = 'v'").first()["sample_values"] == want[:3]


def test_long_and_short_rows(spark, csv):
    path = csv('a,b\n1,2\n3\n4,5,6\n7,8,,\n9,10,,12\n"x,y,z",11\n,\n')
    kept = sorted([("1", "2"), ("3", None), ("x,y,z", "11"), (None, None)], key=repr)
    for multi_line in (False, True):
        df = b.scan_csv(spark, path, bad_lines="skip", multi_line=multi_line)
        assert rows(df) == kept
        assert df.count() == 4 and df.select("a").count() == 4 and rows(df.select("b"))[0] == ("11",)
    with pytest.raises(Exception, match="more than 2 fields"):
        b.scan_csv(spark, path).count()
    with pytest.raises(ValueError):
        b.scan_csv(spark, path, bad_lines="warn")


def test_files_must_share_the_header(spark, csv):
    folder = csv("a,b\n1,2\n", "x.csv", "mixed").rsplit("/", 1)[0]
    csv("b,a\n1,2\n", "y.csv", "mixed")
    with pytest.raises(Exception, match="(?i)header"):
        b.scan_csv(spark, folder).collect()


def test_one_column(spark, csv):
    path = csv("a\n1\n\n2,3\nNA\n")
    assert rows(b.scan_csv(spark, path, bad_lines="skip")) == [("1",), (None,)]


def test_every_row_too_long_is_reported(spark, csv):
    with pytest.raises(Exception, match="more than 2 fields"):
        b.scan_csv(spark, csv("a,b\n1,2,3\n4,5,6\n")).collect()


def test_empty_file(spark, csv):
    with pytest.raises(ValueError, match="no data"):
        b.scan_csv(spark, csv(""))
    assert b.scan_csv(spark, csv("a,b\n")).count() == 0


def test_missing_tokens(spark, csv):
    path = csv('a,b\nNA,"null"\n"",none\nn/a, NA\n')
    assert rows(b.scan_csv(spark, path)) == sorted([(None, None), (None, "none"), (None, " NA")], key=repr)
    assert b.scan_csv(spark, path, na=False).filter("a = 'NA'").count() == 1


def test_types(spark, csv):
    path = csv("i,f,g,t,m,s,e,d\n1,1.5,1,True,True,x,,2024-01-01\n2,2,,FALSE,,1,,2024-01-02\n")
    df = b.scan_csv_typed(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "g": "double", "t": "boolean", "m": "string",
                               "s": "string", "e": "double", "d": "string"}
    assert df.filter("i = 2").first()["t"] is False


def test_write_and_read_back(spark, tmp_path):
    data = [(1, "x, y", True, 1.5), (2, 'say "hi"', False, None), (3, " pad\nded ", None, 2.0), (4, None, True, 1e20)]
    df = spark.createDataFrame(data, "i bigint, s string, f boolean, n double")
    path = str(tmp_path / "out")
    b.write_csv(df, path, order_by="i")
    read = b.scan_csv(spark, path)
    assert rows(read.select("i", "s")) == [(str(i), s) for i, s, _, _ in data]
    assert rows(read.select("f"))[-1] == ("True",) or ("True",) in rows(read.select("f"))
    typed = b.scan_csv_typed(spark, path)
    assert rows(typed.select("n")) == sorted([(1.5,), (None,), (2.0,), (1e20,)], key=repr)
    with pytest.raises(Exception, match="already exists"):
        b.write_csv(df, path)


def test_written_order(spark, tmp_path):
    path = str(tmp_path / "out")
    b.write_csv(spark.range(0, 1_000, 1, 4).select((999 - F.col("id")).alias("k")), path, order_by="k")
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    keys = [int(line) for part in parts for line in part.read_text().splitlines()[1:]]
    assert keys == list(range(1_000))


def test_admit_files(spark, csv):
    csv("a\n1\n", "one.CSV", "dir")
    csv("a\n" + "1\n" * 100, "two.csv", "dir")
    folder = csv("a\n", "three.txt", "dir").rsplit("/", 1)[0]
    names = [r["path"].rsplit("/", 1)[1] for r in b.admit_files(spark, folder, max_bytes=100).collect()]
    assert names == ["one.CSV"]
    assert b.admit_files(spark, folder).count() == 2
    assert b.size_mb(spark, folder).first()[0] == 0.0


def test_clean_to_csv(spark, tmp_path):
    df = spark.createDataFrame([(" 1 ", 1.0), (" 1 ", 1.0), ("2", None)], "` A ` string, n double")
    result = b.clean_to_csv(df, str(tmp_path / "out"), remove_duplicates=True, handle_missing="drop",
                            standardize_columns=True, trim_whitespace=True, convert_types=True)
    assert (result.rows_processed, result.rows_out, result.columns) == (2, 1, ("a", "n"))
    assert rows(b.scan_csv_typed(spark, result.output_path)) == [(1, 1.0)]
    kept = b.clean_to_csv(df, str(tmp_path / "kept"), handle_missing="fill_mean")
    assert kept.rows_processed == kept.rows_out == 3


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(12):
        at = datetime.datetime(2024, 1, 1, i)
        b.append_run(spark, path, id=f"r{i}", filename="f.csv", status="completed", rows_processed=i, upload_date=at)
    newest = b.recent_runs(b.read_runs(spark, path)).collect()
    assert [r["id"] for r in newest] == [f"r{i}" for i in range(11, 1, -1)]
    with pytest.raises(ValueError):
        b.append_run(spark, path, id="x", filename="f", status="started")


def test_parquet_row_index_over_many_files(spark, tmp_path):
    spark.range(0, 1_000, 1, 7).write.parquet(str(tmp_path / "t.parquet"))
    numbered = b.scan_parquet(spark, str(tmp_path), "t", row_index="n")
    assert numbered.columns == ["id", "n"]
    assert numbered.filter("id <> n").count() == 0 and numbered.filter("id = 999").first()["n"] == 999


def test_row_index_over_many_partitions(spark):
    df = spark.range(0, 1_000, 1, 7).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS hot")
    in_order = b.with_row_index(df)
    assert in_order.filter("id <> row_idx").count() == 0
    by_key = b.with_row_index(df, "hot").collect()
    assert sorted(r["row_idx"] for r in by_key) == list(range(1_000))
    ranked = sorted(by_key, key=lambda r: r["row_idx"])
    assert [(r["hot"], r["id"]) for r in ranked] == sorted((r["hot"], r["id"]) for r in by_key)


def test_line_ends_inside_fields_stay(spark, csv):
    path = csv('a,b\r\n"x\r\ny","p\nq"\r\n1,2\r\n')
    want = sorted([("x\r\ny", "p\nq"), ("1", "2")], key=repr)
    assert rows(b.scan_csv(spark, path)) == want
    assert rows(b.scan_csv(spark, path, multi_line=True)) == want


def test_renamed_headers_are_compared(spark, csv):
    folder = csv("a,a\n1,2\n", "x.csv", "renamed").rsplit("/", 1)[0]
    csv("a,a\n3,4\n", "y.csv", "renamed")
    assert b.scan_csv(spark, folder).count() == 2
    csv("x,y\n5,6\n", "z.csv", "renamed")
    with pytest.raises(ValueError, match="headers"):
        b.scan_csv(spark, folder)


def test_many_files_with_line_breaks(spark, csv):
    for k in range(3):
        path = csv(f'a,b\n"{k}\n",2\n', f"{k}.csv", "breaks")
    folder = path.rsplit("/", 1)[0]
    assert rows(b.scan_csv(spark, folder, listed_files=2)) == rows(b.scan_csv(spark, folder)) == [(f"{k}\n", "2") for k in range(3)]


def test_one_column_keeps_its_gaps(spark, frame, tmp_path):
    path = str(tmp_path / "gaps")
    b.write_csv(frame("a string", [("x",), (None,), ("y",), (None,)]), path)
    assert rows(b.scan_csv(spark, path)) == sorted([("x",), (None,), ("y",), (None,)], key=repr)
    path = str(tmp_path / "numbers")
    b.write_csv(frame("a bigint", [(1,), (None,)]), path)
    assert b.scan_csv_typed(spark, path).count() == 2


def test_order_splits_a_frequent_key(spark, tmp_path):
    path = str(tmp_path / "ordered")
    df = spark.range(0, 20_000, 1, 4).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE -1 END AS k", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        b.write_csv(df, path, order_by="k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.text(path).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 12_000
    read = b.scan_csv(spark, path, position="at").orderBy("at").collect()
    assert [int(r["k"]) for r in read] == sorted(int(r["k"]) for r in read)


def test_first_rows_without_a_key_come_last(frame):
    df = frame("k int, v int", [(None, 1), (2, 2), (1, 3)])
    assert [r["v"] for r in b.first_n(df, 5, "k").collect()] == [3, 2, 1]
    assert [r["v"] for r in b.first_n(df, 2, "k").collect()] == [3, 2]
    assert b.first_n(df, 500, "k").count() == 3


def test_rows_of_a_scan_are_numbered_in_place(spark, csv, tmp_path):
    for name, count in (("a", 500), ("b", 3_000)):
        lines = "".join(f"{name}{i:04},{i}{',x' if i % 7 == 0 else ''}\n" for i in range(count))
        path = csv("v,n\n" + lines, f"{name}.csv", "numbered")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = b.scan_csv(spark, path.rsplit("/", 1)[0], bad_lines="skip", position="at")
        numbered = b.with_row_index(df, "at").select("row_idx", "v").orderBy("row_idx").collect()
        assert df.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"{name}{i:04}" for name, count in (("a", 500), ("b", 3_000)) for i in range(count) if i % 7]
    assert [tuple(r) for r in numbered] == list(enumerate(want))


def test_the_crlf_check_writes_a_file_for_each_partition(spark, monkeypatch, tmp_path):
    from checks import files

    monkeypatch.setattr(files, "fresh", lambda spark: str(tmp_path / "crlf"))
    monkeypatch.setattr(files, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3))
    read = files.csv_crlf(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("CAST(doc_id AS STRING)", "sha2(text, 256)", "lang")
    assert sorted(map(tuple, read.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert len(list((tmp_path / "crlf").glob("part-*"))) == 3


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield set_to
    for k, v in before.items():
        spark.conf.set(k, v)


CELLS = ["", "a", "b c", 'say ""x""', "l1\nl2", "\n", "1,2", "\n\n,\n", 'q""\n""q', "é\nü", "long " * 9]


@pytest.mark.parametrize(("size", "line_end"), [(61, "\n"), (150, "\r\n"), (4096, "\n")])
def test_split_files_with_quoted_line_breaks(spark, tmp_path, small_blocks, size, line_end):
    rng = random.Random(size)
    table = [[str(k), rng.choice(CELLS), rng.choice(CELLS), str(rng.randint(0, 9))] for k in range(60)]
    for part in range(2):
        lines = [",".join(f'"{c}"' if any(x in c for x in '\n,"') else c for c in row) for row in table[part::2]]
        (tmp_path / f"{part}.csv").write_bytes((line_end.join(["k,x,\"y\",z", *lines, ""])).encode())
    small_blocks(size)
    got = b.scan_csv(spark, str(tmp_path), na=False, position="at")
    want = sorted(tuple((c.replace('""', '"') or None) for c in row) for row in table)
    assert sorted((r.k, r.x, r.y, r.z) for r in got.collect()) == want
    numbered = b.with_row_index(got, "at").collect()
    assert sorted(r.row_idx for r in numbered) == list(range(60))
    order = [r.k for r in sorted(numbered, key=lambda r: r.row_idx)]
    assert order == [str(k) for part in range(2) for k in range(part, 60, 2)]
    if size < 200:
        plan = got._jdf.queryExecution().toString()
        assert got.rdd.getNumPartitions() > 3 and "multiLine" not in plan
    assert got.select("z").filter("z is not null").count() == 60 and got.count() == 60


def test_split_files_with_odd_quotes(spark, tmp_path, small_blocks):
    """Quotes that open nothing, bad widths and a header over several lines, as one task reads them."""
    lines = ['"a', 'x",b', 'one"two,3', '"u"v"w,4', '"s\n""t""",5', "6", '"7\n8",9,10,11', ' "x",12', '"",""', "", '"e\n\n",13']
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    want = sorted(map(tuple, b.scan_csv(spark, str(tmp_path), multi_line=True, bad_lines="skip", na=False).collect()), key=repr)
    for size in (19, 1000):
        small_blocks(size)
        got = b.scan_csv(spark, str(tmp_path), bad_lines="skip", na=False)
        assert sorted(map(tuple, got.collect()), key=repr) == want
        assert got.columns == ["a\nx", "b"]
        with pytest.raises(Exception, match="more than 2 fields"):
            b.scan_csv(spark, str(tmp_path), na=False).collect()


def test_files_without_line_breaks_do_not_move_the_blocks(spark, tmp_path, small_blocks):
    """The others make up most of the folder; block sizes follow from all its files."""
    text = "k,v\n" + "".join(f'{i},"a\nb ""{i}"""\n' for i in range(60))
    (tmp_path / "broken.csv").write_text(text)
    for part in range(3):
        (tmp_path / f"plain{part}.csv").write_text("k,v\n" + "".join(f"{i},plain\n" for i in range(1000 * (part + 1), 1000 * (part + 1) + 400)))
    small_blocks("1g")
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    got = sorted((int(r.k), r.v) for r in b.scan_csv(spark, str(tmp_path)).collect())
    want = [(i, f'a\nb "{i}"') for i in range(60)] + [(i, "plain") for part in range(3) for i in range(1000 * (part + 1), 1000 * (part + 1) + 400)]
    assert got == sorted(want)
    # Cut elsewhere between the look and the read, the scan fails instead of giving wrong rows.
    scanned = b.scan_csv(spark, str(tmp_path))
    small_blocks(333)
    with pytest.raises(Exception, match="other blocks"):
        scanned.collect()


def test_states_compose():
    from burnish.sources.quoted import composed

    rng = random.Random(3)
    maps = np.array([rng.choice([(0, 1), (0, 0), (1, 1), (1, 0)]) for _ in range(200)])
    for start in (0, 1):
        states, end = composed(maps[:, 0], maps[:, 1], start)
        now = start
        for i, m in enumerate(maps):
            assert states[i] == now
            now = m[now]
        assert end == now


def test_row_index_by_ranges(spark, monkeypatch):
    """Nulls first, a hot key split by arrival, the same numbers each time, and nothing written."""
    from burnish.sources import order

    monkeypatch.setattr(order, "materialized", lambda df: pytest.fail("written"))
    df = spark.range(4_000, numPartitions=6).selectExpr("id", "CASE WHEN id % 10 < 3 THEN 'hot' WHEN id % 97 = 5 THEN NULL ELSE CAST(id * 7919 % 5000 AS STRING) END AS k")
    numbered = b.with_row_index(df, "k", range_rows=150)
    got = {r.row_idx: (r.k, r.id) for r in numbered.collect()}
    want = sorted(((r.k, r.id) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert [got[i] for i in range(4_000)] == want
    assert {r.row_idx: (r.k, r.id) for r in numbered.collect()} == got
    place = order._range_of(F.struct(F.col("k").alias("key"), F.monotonically_increasing_id().alias("at")),
                            [{"key": "a", "at": 3}, {"key": "hot", "at": 1 << 34}, {"key": "z", "at": 0}], df.schema["k"].dataType)
    assert df.select(place.alias("r")).distinct().count() > 2
    assert b.with_row_index(df.limit(0), "k").count() == 0


def test_row_index_refuses_other_partitions(spark):
    """A range with more rows than were counted fails the query instead of giving a number twice."""
    from burnish.sources import order

    df = spark.range(100, numPartitions=2).selectExpr("id", "id % 7 AS k")
    before = order.W
    numbered = b.with_row_index(df.filter("rand() < 0.5"), "k", range_rows=5)
    assert before is order.W
    try:
        rows_ = [r.row_idx for r in numbered.collect()]
        assert len(rows_) == len(set(rows_))
    except Exception as e:
        assert "other partitions" in str(e)
