import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from burnish.llm import spiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MACHINE = spiece.compiled(Path(PATH).read_bytes())


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n▁aethins.,"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_and_text_as_the_library(text):
    ids = spiece.encode_text(MACHINE, text).tolist()
    assert ids == LIBRARY.encode(text)
    assert spiece.decode_ids(MACHINE, ids) == LIBRARY.decode(ids)
    if "▁" not in text:
        assert spiece.decode_ids(MACHINE, ids) == text


def test_runs_of_spaces_and_of_letters():
    rng = random.Random(1)
    texts = [" " * n for n in range(40)] + ["x" + " " * n + "y" for n in range(40)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    assert [spiece.encode_text(MACHINE, t).tolist() for t in texts] == LIBRARY.encode(texts)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    coded = spiece.encode(docs, PATH)
    rows = spiece.decode(coded, PATH).collect()
    assert coded.columns == ["doc_id", "text", "token_ids"]
    assert [list(r.token_ids) for r in rows] == LIBRARY.encode([r.text for r in rows])
    assert all(r.decoded == r.text for r in rows)


def test_edge_rows(frame):
    rows = [(1, None), (2, ""), (3, "long " * 60_000), (3, "long " * 60_000), (None, "x"), (5, "e" * 5_000)]
    docs = frame("doc_id bigint, text string, `a.b` int", [(*r, 1) for r in rows]).withColumn("token_ids", F.lit("old"))
    coded = spiece.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "a.b", "token_ids"]
    got = sorted(((r.doc_id, r.text, list(r.token_ids)) for r in coded.collect()), key=repr)
    assert got == sorted(((i, t, LIBRARY.encode(t or "")) for i, t in rows), key=repr)
    back = spiece.decode(coded.select("text", "token_ids").unionByName(coded.limit(1).select("text", F.lit(None).cast("array<int>").alias("token_ids"))), PATH)
    assert back.filter("decoded != coalesce(text, '') and token_ids is not null").count() == 0
    assert back.filter("token_ids is null").first().decoded == ""
    assert spiece.encode(docs.limit(0), PATH).count() == 0


def changed(**how):
    spec = model_format.ModelProto()
    spec.ParseFromString(Path(PATH).read_bytes())
    for name, value in how.items():
        setattr(spec.trainer_spec, name, value)
    return spec


def test_unigrams_take_the_least_weight():
    """Pieces of the same file with weights that differ; the library reads the same model."""
    spec, rng = changed(model_type=1), random.Random(4)
    for piece in spec.pieces:
        if piece.type == type(piece).NORMAL:
            piece.score = -rng.uniform(3, 14)
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    machine = spiece.compiled(spec.SerializeToString())
    texts = ["", " ", "the of and  ", "x" * 700, "日本 \U0001d518 é\x00"]
    texts += ["".join(rng.choice("etaoinshr  ▁é日\n.𝔘") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    assert [spiece.encode_text(machine, t).tolist() for t in texts] == library.encode(texts)


def test_a_small_memory_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(spiece, "MEMORY_SLOTS", 7)
    monkeypatch.setattr(spiece, "BORDER_SLOTS", 5)
    monkeypatch.setattr(spiece, "SOLVE_CHARS", 50)
    monkeypatch.setattr(spiece, "LONG_RUN", 12)
    machine, rng = spiece.compiled(Path(PATH).read_bytes()), random.Random(8)
    texts = [" ".join("".join(rng.choice("etaoin😀\x00,") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    assert [spiece.encode_text(machine, t).tolist() for t in texts] == LIBRARY.encode(texts)
    assert machine["memory"].runs.shape[0] == 7


def test_bytes_that_are_no_text():
    ids = [[MACHINE["bytes"][0xF0]], [MACHINE["bytes"][0x9F], 300], [], [1, 2]]
    flat = [int(i) for x in ids for i in x]
    got = spiece.decoded(MACHINE, np.array(flat, np.int32), np.cumsum([0, *map(len, ids)])).to_pylist()
    assert got[0] == "\ufffd" and got[1].startswith("\ufffd") and got[2:] == ["", ""]


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merges or unigrams"):
        spiece.compiled(changed(model_type=3).SerializeToString())
    with pytest.raises(ValueError, match="bytes"):
        spiece.compiled(changed(byte_fallback=False).SerializeToString())


def test_odd_columns(frame):
    docs = frame("doc_id bigint, text string, Token_IDs string, s struct<`a b`: int>", [(1, "some text", "old", (3,))])
    coded = spiece.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "s", "token_ids"]
    row = spiece.decode(coded, PATH).first()
    assert row.decoded == "some text" and row.s["a b"] == 3
