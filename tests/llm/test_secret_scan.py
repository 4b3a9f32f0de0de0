"""Base spans against the patterns as given, and what the field adds."""

import os
import random

import numpy as np
import pytest

from cityloom.llm.secret_scan import (BEGIN, OUTSIDE, Tokens, _suspects, base_spans, digest, expected_digest,
                                      find_secrets, has_base_span, learn, tagged_spans, training_texts)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, spans string, n_hex string"
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def model(spark):
    return learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_patterns():
    assert base_spans('Token = "abcdefgh" x') == [(0, 17, 0)]
    assert base_spans("password:short api_key='1234567'") == []
    assert base_spans(f"{HEX} AKIA{'A' * 12} AKIA{'A' * 11}") == [(0, 40, 2), (41, 57, 1)]
    assert base_spans(f"token={HEX}") == [(0, 46, 0), (6, 46, 2)]
    assert base_spans("\u017fecret=abcdefgh to\u212aen=abcdefgh") == []  # only ASCII letters have two cases here
    assert base_spans("tokentoken=passwords=abcdefghi") == [(5, 30, 0)]


def test_given_table(spark, model):
    assert model is not None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = dict(tuple(r) for r in docs.select("doc_id", "text").collect())
    got = digest(find_secrets(docs, model)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == expected_digest(texts[r.doc_id])


def test_search_misses_no_base_span():
    rng = random.Random(6)
    bits = ["token", "Secret", "API_KEY", "apikey", "=", ": ", '"', "abcdefgh", HEX, "AKIA", "ZZZZZZZZZZZZ", " ", "\n", "é", "passwd", "PASSWORD"]
    texts = ["".join(rng.choice(bits) for _ in range(12)) for _ in range(2000)]
    held = {i for i, t in enumerate(texts) if base_spans(t)}
    assert held <= _suspects(Tokens([t.encode() for t in texts]).scan)


def test_cut_decoding_is_whole_decoding(spark, model):
    texts = [r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [f"key : {HEX} then".encode(), HEX.encode(), f"secret {HEX}".encode(), b""]
    tokens = Tokens(texts)
    label = model.decode(model.scores(tokens.rows()), tokens.per_text[tokens.per_text > 0])
    want = {(int(tokens.text[i]), int(tokens.a[i])) for i in np.flatnonzero(label != OUTSIDE)}
    got = set()
    for t, spans in tagged_spans(tokens, model).items():
        for x, y in spans:
            got |= {(t, int(a)) for a in tokens.a[(tokens.a >= x) & (tokens.a < y)]}
    assert got == want and BEGIN in label


def test_field_adds_spans_beyond_the_patterns(spark, model):
    near = [(i, f"the end of it secret = \"{'%032X' % (7919 ** 9 * (i + 3) % (1 << 128))}\" and more of the same words") for i in range(20)]
    near = [(i, t.replace("secret = ", "authkey = ")) for i, t in near]
    clean = [(100 + i, "plain words of an ordinary sentence with nothing to hide. " * 5) for i in range(20)]
    got = {r.doc_id: r for r in digest(find_secrets(spark.createDataFrame(near + clean, "doc_id long, text string"), model)).collect()}
    assert sum(r.n_tagged for i, r in got.items() if i >= 100) == 0
    assert sum(r.n_tagged > 0 for i, r in got.items() if i < 100) >= 10
    assert all(r.n_assign == 0 for r in got.values())


def test_awkward_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n"), (None, f"é {HEX}"), (4, f"token = {HEX}"), (4, f"token = {HEX}"),
            (5, "w " * 60_000 + f"token: {HEX}"), (6, "x" * 100_000), (7, HEX * 3000)]
    docs = spark.createDataFrame([(*r, "s", "n") for r in rows], SCHEMA)
    for m in (model, None):
        got = sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in digest(find_secrets(docs, m)).collect())
        assert got == sorted((i or -1, *expected_digest(t)) for i, t in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert learn(empty) is None and find_secrets(empty, None).count() == 0
    assert learn(docs.where("doc_id < 4")) is None


def test_sample_is_of_texts_that_hold_a_span(spark):
    def held(rows):
        got = training_texts(spark.createDataFrame(rows, "text string").repartition(4))
        assert len(got) == len(set(got))
        return sum(bool(base_spans(t)) for t in got), len(got)

    words = [(f"the token of visitor {i} is a secret of the house",) for i in range(12_000)]
    few = [(f"note {i} token = {'%032X' % (7919 ** 9 * (i + 3) % (1 << 128))}",) for i in range(150)]
    hexes = [(f"build {i} {'%032x' % (7919 ** 9 * (i + 3) % (1 << 128))}",) for i in range(150)]
    assert held(words + few) == (150, 550)            # key words are ordinary, assignments rare
    assert held(words[:50] + hexes) == (150, 200)     # no key word beside a span
    assert held(words[:500] + few + few[:1] * 20_000) == (150, 550)  # copies of one text
    assert held(words[:1] * 20_000 + words[1:300] + few) == (150, 450)


def test_span_test_is_that_of_the_patterns(spark):
    rng = random.Random(7)
    bits = ["token", "Secret", "API_KEY", "to\u212aen", "=", ": ", '"', "abcdefgh", "abc", HEX, HEX[:20], "AKIA", "ZZZZZZ", " ", "\n", "\u00e9", "passwd"]
    texts = ["".join(rng.choice(bits) for _ in range(7)) for _ in range(3000)] + ["token=secret:abcdefgh"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", has_base_span().alias("hit"))
    assert all(r.hit == bool(base_spans(r.text)) for r in rows.collect())
