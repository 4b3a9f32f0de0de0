"""The pipeline's stages, each on its own input, against plain re-computation."""

import re
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from cityloom.llm.sentence_pieces import default_model

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def states(spark):
    """What goes in and comes out of every stage, over the given table and odd rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, None, None, None, None), (-1, "", "en", None, 0), (-2, "1 2 3", "en", "src0", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], DATA)))
    return [(d.columns, d.collect()) for d in out]


def test_names_and_columns(states):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "jaccard_join", "mixing", "sentencepiece"]
    assert all(columns == states[0][0] for columns, _ in states[:-1])


def test_language_stage(states):
    kept = {r.doc_id for r in states[1][1]}
    for r in states[0][1]:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.doc_id in kept) == lettered


def test_exact_stage(states):
    last = {}
    for r in states[1][1]:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in states[2][1]) == sorted(last.values())


def test_near_stage(states):
    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    rows = [(r.doc_id, shingles(r.text)) for r in states[2][1]]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = defaultdict(list)
    for i, s in rows:
        for x in s:
            holders[x].append(i)
    sets = dict(rows)
    for i, s in rows:
        common = Counter(j for x in s for j in holders[x])
        for j, c in common.items():
            if c >= 0.8 * (len(s) + len(sets[j]) - c) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[a] = b
    assert sorted(r.doc_id for r in states[3][1]) == sorted({find(i) for i, _ in rows})


def test_mixing_stage(states):
    sizes, words = Counter(), Counter()
    for r in states[3][1]:
        sizes[r.source] += len(WORD.findall(r.text))
    copies = Counter()
    for r in states[4][1]:
        words[r.source] += len(WORD.findall(r.text))
        copies[r.doc_id] += 1
    assert sum(words.values()) == int(1.5 * sum(sizes.values()))
    assert max(copies.values()) <= 2
    assert all(words[s] <= 2 * sizes[s] for s in sizes)


def test_piece_stage(states):
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = Counter((r.doc_id, tuple(lib.encode(r.text))) for r in states[4][1])
    assert Counter((r.doc_id, tuple(r.ids)) for r in states[5][1]) == want


def test_run(spark, states):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() == len(states[5][1])
