"""The transducer against the library's own encoder, and exact round trips."""

import os
import random

import numpy as np
import pytest
import sentencepiece

from cityloom.llm import piece_fst
from cityloom.llm.piece_fst import PieceModel, Transducer
from cityloom.llm.sentence_pieces import decode, default_model, encode, read_model

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, ids string, n_tokens string, round_trip string"
ODD = ["", "a", " ", "  Hello \n▁x\t\x00 中文🙂 <s> <0x0A>", "a" * 50, " " * 100, "x\n\n\ny", "ÉÈ ê ø 的的的 ", "▁ ▁▁ ▁",
       "é" * 3, "́e", "\U0010ffff", "中" * 500, "http://a.b/" + "c" * 300]


@pytest.fixture(scope="module")
def fst():
    return Transducer(PieceModel(read_model(default_model())))


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n:e].tolist() for e, n in zip(ends, counts)]


def random_texts(n):
    rng = random.Random(5)
    letters = "abcdefghinorst  eeTA.,\n'\"0139é中▁-_🙂\t"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_same_ids_as_the_library(fst, reference):
    texts = ODD + random_texts(3000)
    ids, counts = fst.encode([t.encode() for t in texts])
    for t, got in zip(texts, split(ids, counts)):
        assert got == reference.encode(t), t
    back = fst.decode(ids, counts)
    assert back == [t.replace("▁", " ").encode() for t in texts]


def test_forgetting_changes_nothing(fst, reference, monkeypatch):
    monkeypatch.setattr(piece_fst.Transducer, "MEMO", 40)
    monkeypatch.setattr(piece_fst.Transducer, "PAIRS", 64)
    small = Transducer(fst.model)
    texts = random_texts(300)
    for i in range(0, 300, 20):
        part = texts[i:i + 20]
        got = split(*small.encode([t.encode() for t in part]))
        assert got == [reference.encode(t) for t in part]


def test_given_documents(spark, reference):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = read_model(default_model())
    coded = encode(docs, model, check=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = coded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == reference.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
    assert {r.doc_id: r.text for r in decode(coded, model).collect()} == texts


def test_awkward_rows(spark, reference):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "w " * 60_000), (3, "w " * 60_000)]
    docs = spark.createDataFrame([(*r, "i", "n", "t") for r in rows], SCHEMA)
    model = read_model(default_model())
    coded = encode(docs, model)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in coded.collect())
    assert got == sorted((i or 0, len(reference.encode(t or "")), 0) for i, t in rows)
    assert sorted((r.doc_id or 0, r.text) for r in decode(coded, model).collect()) == sorted((i or 0, t or "") for i, t in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert encode(empty, model).count() == 0
