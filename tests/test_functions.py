import pytest
from pyspark.sql import functions as F

from burnish.functions import (
    NA_TOKENS,
    csv_header_names,
    is_integer_text,
    is_number_text,
    literal_rows,
    normalize_na,
    percent,
    short_name,
    standard_name,
    strip,
    to_double,
    to_long,
)

ACCEPTED = {
    "12": 12.0, " 12 ": 12.0, "+5": 5.0, "-5": -5.0, ".5": 0.5, "5.": 5.0, "007": 7.0, "1e3": 1000.0,
    "1E-2": 0.01, "inf": float("inf"), "-Infinity": float("-inf"), "12\n": 12.0, "\t3": 3.0,
    "9223372036854775808": 9223372036854775808.0, "18446744073709551615": 18446744073709551615.0,
    "0" * 60 + "1": 1.0, "1" * 25 + ".": 1111111111111111111111111.0, "1e308": 1e308, "1e-400": 0.0,
}
REFUSED = ["12d", "12f", "0x1f", "1_000", "1,000", "True", "NaN", "nan", "  ", "-", ".", "1 2", "٣", "\xa012",
           "12\x85", "e5", "1e", "--1", "1.2.3", " inf", "inf ", "1e310", "-1e400", "1" * 25, "-9223372036854775809",
           "18446744073709551616"]


@pytest.mark.parametrize("text", [*ACCEPTED, *REFUSED, ""])
def test_number_grammar(frame, text):
    row = frame("s string", [(text,)]).select(is_number_text(F.col("s")).alias("ok"), to_double(F.col("s")).alias("v"))
    ok, value = row.first()
    assert ok == (text not in REFUSED)
    if text in ACCEPTED:
        assert value == ACCEPTED[text]


def test_integers_must_fit(frame):
    rows = ["1", " -7 ", "+007", "1.0", "9223372036854775807", "9223372036854775808", ""]
    df = frame("i int, s string", list(enumerate(rows)))
    got = [tuple(r) for r in df.orderBy("i").select(is_integer_text(F.col("s")), to_long(F.col("s"))).collect()]
    assert got == [(True, 1), (True, -7), (True, 7), (False, got[3][1]), (True, 2**63 - 1), (False, None), (True, None)]


def test_missing_tokens(frame):
    kept = ["none", "Na", " NA", "x"]
    df = frame("s string, i int", [(t, 1) for t in [*NA_TOKENS, *kept]])
    assert len(NA_TOKENS) == 19
    values = normalize_na(df).filter("s IS NOT NULL").collect()
    assert sorted(r["s"] for r in values) == sorted(kept)
    assert normalize_na(df).filter("i IS NULL").count() == 0


def test_strip_matches_python(frame):
    blanks = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    texts = [f"{b}a{b}b{b}" for b in blanks] + [blanks, "", "plain", blanks + "x" + blanks]
    df = frame("i int, s string", list(enumerate(texts)))
    got = [r[0] for r in df.orderBy("i").select(strip(F.col("s"))).collect()]
    assert got == [t.strip() for t in texts]
    assert frame("s string", [(None,)]).select(strip(F.col("s"))).first()[0] is None


def test_percent(frame):
    df = frame("a bigint, b bigint", [(1, 3), (0, 0), (2, 2), (1, 8)])
    got = [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()]
    assert sorted(got) == [0.0, 12.5, 33.33, 100.0]


def test_names():
    assert [standard_name(n) for n in (" First Name ", "Last  Name", "ÀB")] == ["first_name", "last__name", "àb"]
    assert csv_header_names(["a", "a", None, "b ", "a.1"]) == ["a", "a.2", "Unnamed: 2", "b ", "a.1"]
    assert csv_header_names(["A", "a"]) == ["A", "a.1"]


def test_short_name(frame):
    df = frame("s string", [("twelve_chars",), ("thirteen_char",)])
    assert sorted(r[0] for r in df.select(short_name(F.col("s"))).collect()) == ["thirteen_cha...", "twelve_chars"]


def test_literal_rows_keep_odd_texts(spark):
    odd = ["it's", "back\\slash", "${HOME}", "line\nbreak", "%", "é"]
    got = literal_rows(spark, "i int, s string", list(enumerate(odd))).orderBy("i").collect()
    assert [r["s"] for r in got] == odd
    assert literal_rows(spark, "i int, s string", []).count() == 0
