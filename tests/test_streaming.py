from hashlib import md5

import pytest
from pyspark.sql import functions as F

import burnish as b
from burnish import streaming as s
from checks import CHECKS

SCHEMA = "k string, v string"


@pytest.fixture
def folder(tmp_path):
    directory = tmp_path / "in"
    directory.mkdir()
    for part in range(4):
        lines = [f"{part * 10 + i}, {'NA' if i == 3 else i} " for i in range(10)]
        lines[3] = f"{part * 10 + 3},NA"
        (directory / f"p{part}.csv").write_text("k,v\n" + "\n".join(lines) + "\n")
    return str(directory)


def test_totals_equal_batch(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    query = s.stream_totals(s.stream_profile(s.stream_scan(spark, folder, SCHEMA, max_files_per_trigger=1)), out,
                            str(tmp_path / "state"))
    query.awaitTermination()
    batch = b.column_missing(b.scan_csv(spark, folder))
    assert sorted(s.read_totals(spark, out).collect()) == sorted(batch.collect())
    assert s.rows_read(query) == 40


def test_totals_go_on_after_a_restart(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        totals = s.stream_profile(s.stream_scan(spark, folder, SCHEMA))
        s.stream_totals(totals, out, state).awaitTermination()
        return {r["column"]: r["missing_count"] for r in s.read_totals(spark, out).collect()}

    assert run() == {"k": 0, "v": 4}
    with open(folder + "/late.csv", "w") as late:
        late.write("k,v\nNA,1\n")
    assert run() == {"k": 1, "v": 4}


def test_clean(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    stream = s.stream_scan(spark, folder, SCHEMA).withColumnRenamed("v", " V ")
    cleaned = s.stream_clean(stream, standardize_columns=True, handle_missing="drop", trim_whitespace=True,
                             types={"v": "double", "k": "bigint"})
    s.stream_to_parquet(cleaned, out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out)
    assert dict(got.dtypes) == {"k": "bigint", "v": "double"}
    assert got.count() == 36 and got.filter("v IS NULL").count() == 0
    for refused in ({"remove_duplicates": True}, {"handle_missing": "fill_mean"}):
        with pytest.raises(ValueError):
            s.stream_clean(stream, **refused)


def test_bad_lines(spark, folder, tmp_path):
    with open(folder + "/bad.csv", "w") as late:
        late.write('k,v\n1,2,3\n4\n"5,5","x\ny"\n')
    out = str(tmp_path / "out")
    stream = s.stream_scan(spark, folder, SCHEMA, bad_lines="skip", file_names="bad*.csv", multi_line=True)
    s.stream_to_parquet(stream, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=repr) == [("4", None), ("5,5", "x\ny")]
    strict = s.stream_scan(spark, folder, SCHEMA)
    with pytest.raises(Exception, match="more than 2 fields"):
        s.stream_to_parquet(strict, out + "2", str(tmp_path / "state2")).awaitTermination()


def test_fill_per_batch(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    numbers = s.stream_clean(s.stream_scan(spark, folder, SCHEMA, max_files_per_trigger=1),
                             types={"k": "double", "v": "double"}, trim_whitespace=True)
    shifted = numbers.withColumn("v", F.col("v") + F.floor(F.col("k") / 10) * 100)
    s.stream_batch_fill(shifted, out, str(tmp_path / "state"), handle_missing="fill_mean").awaitTermination()
    filled = spark.read.parquet(out).filter("k % 10 = 3").orderBy("k").collect()
    mean = (45 - 3) / 9
    assert [r["v"] for r in filled] == pytest.approx([mean + 100 * i for i in range(4)])


def test_dedup(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    values = s.stream_scan(spark, folder, SCHEMA, max_files_per_trigger=1).select("v")
    s.stream_to_parquet(s.stream_dedup(values), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    salted = str(tmp_path / "salted")
    s.stream_to_parquet(s.stream_dedup(values, salts=3), salted, str(tmp_path / "salted_state")).awaitTermination()
    assert spark.read.parquet(salted).count() == 10
    with pytest.raises(ValueError):
        s.stream_dedup(values, event_time="v")


def test_dedup_with_watermark(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    stream = s.stream_scan(spark, folder, SCHEMA).select(F.timestamp_seconds(F.col("k").cast("int") % 5 + 1_700_000_000).alias("t"))
    kept = s.stream_dedup(stream, event_time="t", delay="1 hour")
    s.stream_to_parquet(kept, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_batches_share_one_schema(spark, folder, tmp_path):
    """An integer column has a gap in some batches only."""
    out = str(tmp_path / "out")
    stream = s.stream_scan(spark, folder, "k bigint, v bigint", max_files_per_trigger=1, misfits="null").selectExpr(
        "k", "CASE WHEN k >= 20 THEN v WHEN k % 10 < 8 THEN k END AS v")
    query = s.stream_batch_fill(stream, out, str(tmp_path / "state"), handle_missing="fill_median")
    query.awaitTermination()
    read = spark.read.parquet(out)
    assert dict(read.dtypes) | {"batch_id": ""} == {"k": "double", "v": "double", "batch_id": ""}
    assert read.count() == 40 == s.rows_read(query) and read.filter("v IS NULL").count() == 0
    with pytest.raises(ValueError, match="types"):
        s.stream_batch_fill(stream, out, str(tmp_path / "other"), convert_types=True)


def test_rows_are_counted_beyond_the_remembered_batches(spark, folder, tmp_path):
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = s.stream_scan(spark, folder, SCHEMA, max_files_per_trigger=1)
        query = s.stream_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert s.rows_read(query) == 40


def test_another_header_order_is_refused(spark, folder, tmp_path):
    with open(folder + "/other.csv", "w") as other:
        other.write("v,k\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        s.stream_to_parquet(s.stream_scan(spark, folder, SCHEMA), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()


def test_typed_columns(spark, folder, tmp_path):
    with open(folder + "/wide.csv", "w") as wide:
        wide.write("k,v\n1,2\n3,4,5\nx,6\n")

    def run(name, **how):
        stream = s.stream_scan(spark, folder, "k bigint, v bigint", file_names="wide.csv", **how)
        s.stream_to_parquet(stream, str(tmp_path / name), str(tmp_path / (name + "_state"))).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()), key=repr)

    assert run("skipped", bad_lines="skip", misfits="null") == [(1, 2), (None, 6)]
    with pytest.raises(Exception, match="more than 2 fields"):
        run("strict", misfits="null")
    with pytest.raises(Exception, match="no value for k: x"):
        run("fitting", bad_lines="skip")


def test_misfits_are_counted(spark, folder, tmp_path):
    stream = s.stream_scan(spark, folder, SCHEMA, na=False)
    cleaned = s.stream_clean(stream, types={"k": "bigint", "v": "double"}, trim_whitespace=True, misfits="count")
    s.stream_to_parquet(cleaned, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("misfits")).first()[0] == 4


def test_records_with_line_breaks(spark, tmp_path):
    """Also such whose parts have as many fields as the header; one that leaves its block is refused."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cut.csv").write_text('k,v\n1,a\n"x\ny",b\n1,"x\n2,y"\n3,z\n4,"p\n5,q\n6,r"\n"3 ""q""","c"\n')
    want = sorted([("1", "a"), ("x\ny", "b"), ("1", "x\n2,y"), ("3", "z"), ("4", "p\n5,q\n6,r"), ('3 "q"', "c")])

    def run(name, **how):
        stream = s.stream_scan(spark, str(tmp_path / "in"), SCHEMA, na=False, **how)
        query = s.stream_to_parquet(stream, str(tmp_path / name), str(tmp_path / name) + "-state")
        query.awaitTermination()
        assert s.rows_read(query) == 6
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))

    assert run("strict") == run("skipped", bad_lines="skip") == run("whole", multi_line=True) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        with pytest.raises(Exception, match="line break at the end of a block"):
            run("split")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dedup_by_digest(spark, frame, tmp_path):
    folder = str(tmp_path / "in")
    wide = [(float(i % 3) * (-1.0 if i % 2 else 1.0), None if i % 5 == 0 else "x" * 2000 + str(i % 4), [i % 2], i % 2 == 0) for i in range(200)]
    rows = frame("a double, t string, l array<int>, b boolean", wide)
    rows.unionByName(frame("a double, t string, l array<int>, b boolean", [(None, "1", None, True), (float("nan"), None, [], None)] * 2)).withColumn(
        "at", F.expr("timestamp_micros(1000000 + IF(b, 1, 0))")).repartition(4).write.parquet(folder)
    want, used = spark.read.parquet(folder).distinct(), {}
    for key in ("rows", "digest"):
        stream = s.stream_scan(spark, folder, want.schema, file_format="parquet", max_files_per_trigger=2)
        query = s.stream_to_parquet(s.stream_dedup(stream, key=key, salts=2), str(tmp_path / key), str(tmp_path / f"{key}-state"))
        query.awaitTermination()
        out = spark.read.parquet(str(tmp_path / key))
        assert out.columns == want.columns and out.count() == want.count()
        assert out.exceptAll(want).count() == 0
        used[key] = sum(o["memoryUsedBytes"] for o in query.lastProgress["stateOperators"])
    assert used["digest"] < used["rows"] / 2
    with pytest.raises(ValueError, match="'rows' or 'digest'"):
        s.stream_dedup(stream, key="hash")


@pytest.mark.parametrize("files", [1, 3])
def test_checks_stream_a_table_of_any_number_of_files(spark, frame, tmp_path, files):
    """A table is a folder `documents.parquet` of files, or one file of that name; files of other tables lie beside it."""
    rows = [(i, f"text {i % 7}", "en" if i % 2 else None, "web", 6) for i in range(60)]
    docs = frame("doc_id bigint, text string, lang string, source string, n_chars bigint", rows)
    sf_dir = tmp_path / "sf"
    docs.repartition(files).write.parquet(str(sf_dir / "documents.parquet"))
    docs.withColumn("text", F.lit("other")).write.parquet(str(sf_dir / "documents_parquet"))
    if files == 1:
        (sf_dir / "documents.parquet").rename(sf_dir / "parts")
        next((sf_dir / "parts").glob("*.parquet")).rename(sf_dir / "documents.parquet")
    for name in ("stream_dedup", "stream_dedup_digest"):
        found = CHECKS[name].query(spark, str(sf_dir))
        assert sorted(map(tuple, found.select("text_md5", F.coalesce("lang", F.lit("-"))).collect())) == sorted(
            (md5(f"text {i}".encode()).hexdigest(), lang) for i in range(7) for lang in ("en", "-"))
