"""Random small tables against pandas, row by row and column by column."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import burnish as b
from burnish.functions import is_number_text, to_double


def test_number_grammar_against_pandas(frame):
    chance = random.Random(1)
    pieces = ["0", "1", "9", "12", "+", "-", ".", "e", "E", "d", "inf", "INFINITY", "nan", " ", "\t", "_", ",", "x", "True"]
    texts = sorted({"".join(chance.choices(pieces, k=chance.randint(1, 5))) for _ in range(6_000)})
    df = frame("s string", [(t,) for t in texts])
    got = {r["s"]: (r["ok"], r["v"]) for r in df.select("s", is_number_text(F.col("s")).alias("ok"), to_double(F.col("s")).alias("v")).collect()}
    differ = []
    for text in texts:
        if re.match(r"\s*[+-]?[0.]+[eE]", text):
            continue  # zero with a huge exponent: pandas gives up on some, Spark reads zero
        try:
            want = (True, float(pd.to_numeric(pd.Series([text], dtype=object))[0]))
        except (ValueError, TypeError):
            want = (False, None)
        if got[text][0] != want[0] or (want[0] and got[text][1] != want[1]):
            differ.append((text, got[text], want))
    assert differ == [], differ


@pytest.fixture(scope="module")
def random_tables():
    chance = np.random.default_rng(5)
    tables = []
    for rows in (1, 60):
        table = pd.DataFrame({
            "i": pd.array(chance.integers(0, 5, rows), dtype="Int64"),
            "n": np.round(chance.normal(size=rows), 1) + 0.0,  # no negative zero
            "s": chance.choice(["a", "b", "c", " d "], rows),
            "z": np.full(rows, np.nan),
        }).astype({"s": object})
        for c in ("i", "n", "s"):
            table.loc[chance.random(rows) < 0.3, c] = None
        tables.append(table)
    return tables


def as_spark(spark, table):
    rows = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in table.itertuples(index=False)]
    return spark.createDataFrame(rows, "i bigint, n double, s string, z double").repartition(3)


def sorted_rows(rows):
    cells = [tuple(None if pd.isna(v) else round(float(v), 9) if not isinstance(v, str) else v for v in r) for r in rows]
    return sorted(cells, key=repr)


def test_fills_and_dedup_against_pandas(spark, random_tables):
    for table in random_tables:
        df = as_spark(spark, table)
        floats = table.assign(i=table["i"].astype(float), n=table["n"].astype(float))
        numbers = ["i", "n", "z"]
        wanted = {
            "fill_mean": floats.fillna(floats[numbers].mean()),
            "fill_median": floats.fillna(floats[numbers].median()),
            "fill_mode": floats.fillna({c: floats[c].mode()[0] for c in floats if len(floats[c].mode())}),
            "drop": floats.dropna(),
        }
        for method, want in wanted.items():
            got = b.clean(df, handle_missing=method)
            assert sorted_rows(got.collect()) == sorted_rows(want.itertuples(index=False)), method
        for strategy in ("rows", "hash"):
            got = b.remove_duplicates(df, strategy=strategy)
            assert sorted_rows(got.collect()) == sorted_rows(floats.drop_duplicates().itertuples(index=False))
        assert b.duplicate_rows(df).first()[0] == floats.duplicated().sum()


def test_profile_against_pandas(spark, random_tables):
    for table in random_tables:
        df = as_spark(spark, table)
        profile = {r["column"]: r for r in b.column_profile(df).collect()}
        for c in table:
            assert profile[c]["missing_count"] == table[c].isna().sum()
            assert profile[c]["unique_values"] == str(table[c].nunique())
        stats = {r["column"]: r for r in b.describe_numeric(df).collect()}
        for c in ("i", "n"):
            values = table[c].astype(float)
            for name in ("mean", "median", "std", "min", "max"):
                want = getattr(values, name)()
                assert stats[c][name] == (None if pd.isna(want) else pytest.approx(want))
