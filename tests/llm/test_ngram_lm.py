"""Counts, base scores and Kneser-Ney probabilities against a plain re-computation."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cityloom.llm import ngram_lm
from cityloom.llm.ngram_lm import Arrays, discounts, language_model_scores, learn, probabilities

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, held_out string, score string, n string, owner string"
FOLD = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def plain(rows):
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows if i is not None}
    uni, pair = Counter(), Counter()
    for i, t in rows:
        if fold.get(i, 0):
            seq = tokens(t)
            uni.update(seq)
            pair.update(zip([0, *seq[:-1]], seq))
    n, v = sum(uni.values()), len(uni)
    after = Counter(w for _, w in pair)
    total, kinds = Counter(), defaultdict(Counter)
    for (h, _), c in pair.items():
        total[h] += c
        kinds[h][min(c, 3)] += 1

    def off(counts):
        k = Counter(counts)
        return (0, *discounts(k[1], k[2], k[3], k[4]))

    d2, d1 = off(pair.values()), off(after.values())
    spare = sum(d1[min(c, 3)] for c in after.values()) / len(pair) if pair else 1

    def prob(h, w):
        p = spare / (v + 1) + (max(after[w] - d1[min(after[w], 3)], 0) / len(pair) if pair else 0)
        if h in total:
            c = pair[h, w]
            left = sum(d2[k] * m for k, m in kinds[h].items()) / total[h]
            p = max(c - d2[min(c, 3)], 0) / total[h] + left * p
        return p

    out = []
    for i, t in rows:
        seq = tokens(t)
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq)
        out.append((i, fold.get(i, 1) == 0, len(seq), sum(uni[w] > 0 for w in seq), n, base,
                    sum(math.log10(prob(h, w)) for h, w in zip([0, *seq[:-1]], seq))))
    return out


def same(got, want):
    def order(r):
        return (-1 if r[0] is None else r[0], r[2], r[5])

    got = sorted((tuple(r) for r in got), key=order)
    want = sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g[6], w[6], rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("small", [True, False])
def test_given_table(spark, monkeypatch, small):
    if small:  # many owners, shards and split contexts
        monkeypatch.setattr(ngram_lm, "OWNER_BYTES", 100_000)
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 9_000)
        monkeypatch.setattr(ngram_lm, "FLUSH_TOKENS", 5_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_model_scores(docs).collect()
    same(got, plain([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_masses_add_up_to_one(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 4} a b d a {i % 9} e") for i in range(60)], "doc_id long, text string")
    model = learn(docs)
    arrays = Arrays(model).load_pairs()
    words = np.arange(-1, model.size)
    for h in range(-1, model.size + 1):
        assert math.isclose(probabilities(model, arrays, np.full(len(words), h), words).sum(), 1, rel_tol=1e-9)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a É é"), (None, "never learned"), (4, "a b " * 40_000), (5, "a b"), (5, "a b"), (10, "x"),
            (11, "\x0b\x0c x"), (12, "ä Ä"), (17, "a"), (30, "b a")]
    same(language_model_scores(spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA).repartition(3)).collect(), plain(rows))


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (None, None)]])
def test_nothing_to_learn(spark, rows):
    got = language_model_scores(spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)).collect()
    assert [(r.base_score, r.score, r.train_tokens) for r in got] == [(0.0, 0.0, 0)] * len(rows)
