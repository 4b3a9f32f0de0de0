"""Exact and near duplicates against brute force, on awkward rows and on the given table."""

import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest

from cityloom.llm.exact_dedup import (decode_gaps, drop_exact_duplicates, encode_gaps,
                                      exact_duplicates)
from cityloom.llm.jaccard_join import drop_near_duplicates, similarity_classes

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, "a b c", "x"), (2, "a b c", None), (3, None, "y"), (4, "", "y"), (None, "q", "z"), (5, "q", "z"),
        (6, LONG, "s"), (7, LONG + " end", "s"), (8, LONG, "s"), (9, "dup", "s"), (9, "dup", "s"), (10, " \t", "s")]
SCHEMA = "doc_id long, text string, source string, node string, row_id string, text_sha256 string, key string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "n", "r", "t", "k") for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [1, 2, 700, 5000])
def test_gap_code_round_trip(n):
    rng = np.random.default_rng(n)
    low, span = 1 << 60, 1 << 62
    values = np.unique(rng.integers(low, low + span, n).astype(np.uint64))
    blob, r = encode_gaps(values, low, span)
    assert (decode_gaps(blob, len(values), r, low) == values).all()
    assert len(blob) * 8 < len(values) * (62 - np.log2(n) + 4) + 16


@pytest.mark.parametrize("owners", [1, 3])
def test_exact_awkward(awkward, owners):
    got = [r.asDict() for r in exact_duplicates(awkward, owners).collect()]
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for g in got:
        ids = groups[g["text_sha256"]]
        assert g["group_size"] == len(ids)
        assert g["keep_id"] == max(ids, key=lambda x: -1 if x is None else x)
    for sha in groups:
        assert sum(g["kept"] for g in got if g["text_sha256"] == sha) == 1


def test_exact_filter(awkward):
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [2, 4, 5, 7, 8, 9, 10]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(empty).count() == 0
    assert drop_exact_duplicates(empty).count() == 0
    assert similarity_classes(empty).count() == 0
    assert drop_near_duplicates(empty).count() == 0


def brute(rows):
    """(doc_id, class size, links) by comparing all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: 32 for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links = []
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += 1
        links.append({j for j, c in common.items() if j != i and c >= 0.8 * (len(s) + len(sets[j]) - c) - 1e-9})
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            m = min([root[i], *(root[j] for j in near)])
            for j in (i, *near):
                if root[j] != m:
                    root[j], changed = m, True
    return [(rows[i][0], root.count(root[i]), len(links[i])) for i in range(len(rows))]


def key(x):
    return tuple(-1 if v is None else v for v in x)


def test_similarity_awkward(awkward):
    got = [(r.doc_id, r.class_size, r.links) for r in similarity_classes(awkward).collect()]
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in ROWS]), key=key)
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [2, 3, 4, 5, 8, 9, 10]


def test_similarity_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = similarity_classes(docs).collect()
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted((r.doc_id, r.class_size, r.links) for r in got) == sorted(want)
    assert len({r.class_id for r in got}) == sum(r.is_first for r in got)


def test_blocks_of_a_large_group(spark, monkeypatch):
    from cityloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40 + i % 20] + [f"z{i}"])) for i in range(50)]
    got = similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_size, r.links) for r in got) == sorted(brute(rows))
