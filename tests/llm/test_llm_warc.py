import hashlib

import pytest

from burnish.llm import warc
from burnish.llm.common import new_path

LONG = "<p>é日</p>" * 20
PAGES = [(3, "http://a/x y\r\nEvil: 1", LONG), (1, None, LONG), (2, "http://b", LONG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "v", "short"),
         (8, "big", "0123456789" * 30_000), (9, "big", "0123456789" * 30_000), (None, "n", LONG), (None, "m", "only" * 50), (1, "again", LONG),
         (10, "crlf", "\r\n\r\nWARC/1.1\r\n\r\n" * 30)]


def expected(pages):
    first = {}
    for i, _, html in pages:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        to = first.get(html) if len(data) >= 100 else None
        again = to is not None and i != to
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def rows_of(spark, path):
    rows = warc.read(spark, path, rows_at_once=5).collect()
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r.page), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows), key=repr)


def parsed(data):
    """Records of a WARC file, read plainly: fields and payload."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("ascii").split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4 :]
    return out


@pytest.mark.parametrize("chunk, broadcast_rows", [(1 << 16, 500_000), (400, 0), (64, 500_000)])
def test_round_trip(spark, frame, chunk, broadcast_rows):
    path = new_path(spark, "test-warc")
    pages = frame("page_id bigint, url string, html string, first int", [(*p, 1) for p in PAGES])
    warc.write(pages, path, chunk_bytes=chunk, broadcast_rows=broadcast_rows)
    assert rows_of(spark, path) == expected(PAGES)
    table = spark.read.parquet(path)
    assert max([len(r.data) for r in table.filter("chunk > 0").collect()], default=0) <= chunk + 4


def test_a_long_payload_comes_to_python_in_chunks(spark, frame):
    path, most = new_path(spark, "test-warc"), 1000
    pages = [(1, "u", "é" * 200_001), (2, "u", ""), (3, "v", "x" * most), (4, "v", "x" * (most + 1)), (5, "w", "é" * 200_001)]
    warc.write(frame("page_id bigint, url string, html string", pages).coalesce(1), path, chunk_bytes=most, rows_at_once=7)
    table = spark.read.parquet(path)
    assert {(r.page, r.n) for r in table.groupBy("record").agg({"chunk": "count"}).toDF("page", "n").collect()} >= {(0, 401), (1, 1), (2, 1), (3, 2), (4, 1)}
    assert max(len(r.data) for r in table.collect()) < most + 600
    assert rows_of(spark, path) == expected(pages)


def test_archives_are_warc_files(spark, frame):
    path = new_path(spark, "test-warc")
    warc.write(frame("page_id bigint, url string, html string", PAGES), path, chunk_bytes=1000)
    archives = [r.archive for r in spark.read.parquet(path).select("archive").distinct().collect()]
    records = [r for a in archives for r in parsed(b"".join(warc.export(spark, path, a)))]
    assert len(records) == len(PAGES)
    for fields, payload in records:
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        else:
            assert payload == b"" and fields["WARC-Refers-To"]
    assert not any("Evil" in fields for fields, _ in records)


@pytest.mark.parametrize("change", ["data = concat(data, X'00')", "digest = X'00'", "chunk = 7"])
def test_damage_is_noticed(spark, frame, change):
    path, other = new_path(spark, "test-warc"), new_path(spark, "test-warc")
    warc.write(frame("page_id bigint, url string, html string", [(1, "u", "some payload")]), path)
    name, value = change.split(" = ")
    spark.read.parquet(path).selectExpr(*(f"CAST({value} AS {'INT' if name == 'chunk' else 'BINARY'}) AS {c}" if c == name else c for c in
                                          ("archive", "record", "chunk", "last", "data", "digest"))).write.parquet(other)
    with pytest.raises(Exception, match="ValueError|was due|record"):
        warc.read(spark, other).collect()


def test_empty_table(spark, frame):
    path = new_path(spark, "test-warc")
    warc.write(frame("page_id bigint, url string, html string", []), path)
    assert warc.read(spark, path).count() == 0
