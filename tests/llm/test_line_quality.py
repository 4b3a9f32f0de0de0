"""The conditional random field, the exact counts, and the verdicts on held-out labels."""

import itertools
import os
import re

import numpy as np
import pytest

from cityloom.llm.crf import ChainCRF, fit
from cityloom.llm.line_quality import CONTENT, Lines, judge, learn, splice

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, key string, n_words string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_field(rng, labels=3):
    return ChainCRF(np.array([0, 4]), rng.normal(size=(9, labels)), rng.normal(size=(labels, labels)),
                    rng.normal(size=labels), rng.normal(size=labels))


def value(m, score, path):
    return (m.first[path[0]] + m.last[path[-1]] + sum(score[i, y] for i, y in enumerate(path))
            + sum(m.steps[a, b] for a, b in itertools.pairwise(path)))


def test_decoding_is_best_of_all_paths():
    rng = np.random.default_rng(1)
    m = random_field(rng)
    lengths = np.array([1, 5, 3, 6, 1])
    x = np.stack([rng.integers(0, 4, lengths.sum()), rng.integers(0, 5, lengths.sum())], axis=1)
    got, at = m.decode(m.scores(x), lengths), 0
    for n in lengths:
        s = m.scores(x)[at:at + n]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: value(m, s, p))
        assert tuple(got[at:at + n]) == best
        at += n


def test_cutting_at_settled_items_changes_nothing():
    rng = np.random.default_rng(2)
    m = random_field(rng)
    s = rng.normal(size=(400, 3))
    s[::3, 0] += 12
    whole = m.decode(s, np.array([400]))
    sure = m.settled(s, 0)
    assert sure.any() and (whole[sure] == 0).all()


def test_training_uses_neighbours():
    rng = np.random.default_rng(4)
    seqs = []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 2), 6)
        x = np.where(rng.random(12) < 0.8, y, 1 - y)
        seqs.append((np.stack([x, rng.integers(0, 3, 12)], axis=1), y))
    m = fit(seqs, [2, 3], 2)
    right = [np.mean(m.decode(m.scores(x), np.array([12])) == y) for x, y in seqs]
    assert np.mean(right) > 0.85 and m.steps[0, 0] > m.steps[0, 1]


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed)


def same(got, rows):
    mine = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert mine == sorted((i or -1, *counts(t)) for i, t in rows)


@pytest.mark.parametrize("learned", [True, False])
def test_given_table(spark, learned):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = judge(docs, learn(docs, labels) if learned else None).collect()
    same(got, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    if not learned:
        assert all(r.kept != r.base_failed for r in got)


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels.where("doc_id % 2 = 0"))
    got = judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert np.mean([r.content_share >= 0.5 for r in good]) > 0.99
    assert np.mean([r.kept for r in bad]) < 0.05


def test_mixed_texts(spark):
    """Content share of held-out texts spliced from a good and a bad one, in words."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").where("length(text) BETWEEN 200 AND 20000").orderBy(
        "doc_id").select("quality", "text").collect()
    good, bad = ([r.text.encode() for r in rows if r.quality == q][:300] for q in (1, 0))
    texts, marks = splice(good, bad)
    x = Lines(texts)
    label = model.decode(model.scores(x.features), x.per_text[x.per_text > 0])
    want = np.bincount(x.line_text, x.line_words * (np.concatenate(marks) == CONTENT)) / x.n_words
    got = np.bincount(x.line_text, x.line_words * (label == CONTENT), len(texts)) / x.n_words
    print(len(texts), np.abs(got - want).mean(), np.mean((got == 0) | (got == 1)))
    assert len(texts) > 100 and np.abs(got - want).mean() < 0.05


def test_awkward_rows(spark):
    lines = "one two three four five six seven eight nine\n" * 3
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, lines), (None, lines + "é ü | <x> $ 中文\r\n\x0b"), (4, lines),
            (6, "word " * 60_000), (7, "a\nb\na\n\na \nb"), (8, "x " * 8 + "x")]
    docs = spark.createDataFrame([(*r, "k", "n", "t") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, None), (None, 1)], "doc_id long, quality int")
    same(judge(docs, learn(docs, labels)).collect(), rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert judge(empty, learn(empty, labels)).count() == 0
