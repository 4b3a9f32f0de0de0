"""Held-out accuracy of the language network, and awkward rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.llm.byte_cnn import WINDOW, windows_of
from cityloom.llm.language_id import SAMPLE_TEXTS, fit, identify, keep_known_languages, language_id, sample

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, key string, score string, fold string"


def test_windows_cover_every_byte():
    texts = [b"", b"a", bytes(range(1, 256)) * 5, b"x" * WINDOW, b"y" * (WINDOW + 1)]
    windows, owner, used = windows_of(texts)
    for i, t in enumerate(texts):
        mine = windows[owner == i]
        assert used[owner == i].sum() == len(t)
        got = b"".join(w[: (w != 0).sum()].tobytes()[-u:] for w, u in zip(mine, used[owner == i]))
        assert got == t


def test_scorer_matches_direct_convolution():
    from cityloom.llm.byte_cnn import FOLD, REACH, train

    rng = np.random.default_rng(3)
    windows = rng.integers(1, 256, (40, WINDOW)).astype(np.uint8)
    net = train(windows, np.arange(40) % 3, ["a", "b", "c"], epochs=1)
    got = net.scorer()(windows)
    for w, s in zip(windows[:4], got):
        x = np.concatenate((FOLD[w], np.zeros(REACH, np.uint8)))
        v = net.embed[x]
        conv = sum(v[j:j + WINDOW] @ net.filters[j] for j in range(REACH))
        z = np.maximum(conv.max(axis=0) + net.offset, 0) @ net.dense + net.bias
        assert np.allclose(s, z - np.log(np.exp(z - z.max()).sum()) - z.max(), atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_awkward_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... !?", "de"), (None, "the end of the day", "en"),
            (5, "der die das und ist", "de"), (5, "der die das und ist", "de"), (6, "the " * 40_000, None)]
    docs = spark.createDataFrame([(*r, "k", "s", "f") for r in rows], SCHEMA)
    net = fit(docs, F.lit(True))
    got = {(r.doc_id, r.key): r for r in identify(docs, net).collect()}
    assert [r.lang_pred for k, r in got.items() if k[0] in (1, 2, 3)] == ["und"] * 3
    assert {r.lang_pred for k, r in got.items() if k[0] == 5} == {"de"}
    assert {r.lang_pred for k, r in got.items() if k[0] == 6} <= {"en", "de"}
    kept = keep_known_languages(docs)
    assert kept.columns == docs.columns
    assert all(r.text and "the" in r.text or "der" in r.text for r in kept.collect())


@pytest.mark.parametrize("rows", [[], [(1, "text without label", None)]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame([(*r, "k", "s", "f") for r in rows], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language_id(docs).collect()] == [("und", 0.0)] * len(rows)
    assert keep_known_languages(docs).count() == 0


def test_sample_counts_distinct_texts(spark):
    rows = [("aa", f"copied words of text {i}") for i in range(5) for _ in range(4000)]
    rows += [("bb", "one text again and again")] * 20_000 + [("bb", f"words of its own {i}") for i in range(3000)]
    rows += [("cc", f"seldom written words {i}") for i in range(40)] + [("dd", "one text again and again")] * 5000
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = [tuple(r) for r in sample(docs, F.lit(True)).collect()]
    assert len(got) == len(set(got))
    number = {k: sum(label == k for label, _ in got) for k in ("aa", "bb", "cc", "dd")}
    assert number == {"aa": 5, "bb": SAMPLE_TEXTS, "cc": 40, "dd": 1}
