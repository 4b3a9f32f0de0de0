"""Groups, links and corpus-wide counts against a plain reading of the libraries' tokens."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cityloom.llm.token_alignment import Aligner, align, byte_alphabet, coalesce, default_models

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATHS = default_models()
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
BYTE = byte_alphabet()


def tokens(text):
    """(id, start, end) lists of A and B; empty where they do not spell the text."""
    if not text:
        return [], []
    out = []
    whole = (" " + text).encode()
    for ids, spell in ((A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(BYTE[c] for c in A.id_to_token(i))),
                       (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i)
                        else B.id_to_piece(i).replace("▁", " ").encode())):
        at, line, spelt = 0, [], b""
        for i in ids:
            spelt += spell(i)
            line.append((i, at, len(spelt)))
            at = len(spelt)
        if spelt != whole:
            return [], []
        out.append(line)
    return out


def brute(rows):
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = tokens(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)))
            low = cut
        found.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(((d, na, nb, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(s.encode()).hexdigest() if s else "") for d, na, nb, g, links, s in found), key=str)


def run(df, **more):
    return sorted((tuple(r) for r in align(df, **more).collect()), key=str)


AWKWARD = [(1, "Hello wörld, naïve café — 東京 ok"), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "<|endoftext|> <s> </s> <unk>"),
           (7, "tabs\t\tand\n\n\nlines  two   three"), (7, "other text of one id"), (None, "no id"), (None, "no id"),
           (8, "𝔘𝔫𝔦 😀😀 \x00 ​ ͸"), (9, "  lead and trail  "), (10, "x" * 5000), (11, "Русский текст и Ελληνικά")]
SCHEMA = "doc_id long, text string, book long, pair string"


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_awkward(spark, words):
    rows = AWKWARD + [(20 + i, f"{i} hello hello wörld {i}") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA).repartition(3)
    assert run(df, words=words) == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(1, None, 1, "")], SCHEMA)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_spelt_groups(spark):
    df = spark.createDataFrame([(1, "ab cd", 1, "")], SCHEMA)
    got = align(df, spelt=True).head().groups
    a, b = tokens("ab cd")
    assert [x for g in got.split(";") for x in g.split("|")[0].split(",")] == [str(x[0]) for x in a]
    assert [x for g in got.split(";") for x in g.split("|")[1].split(",")] == [str(x[0]) for x in b]


def test_fast_encoder_agrees():
    """Characters that the faster library may encode give the other library's ids."""
    with open(PATHS[0], "rb") as f, open(PATHS[1], "rb") as g:
        model = Aligner(f.read(), g.read())
    assert model.fast is not None
    rng = random.Random(2)
    pool = [chr(c) for a, b in ((0, 0x250), (0x410, 0x450), (0x2010, 0x2028), (0x2030, 0x205F), (0x3041, 0x3097),
                                (0x30A1, 0x30FB), (0x4E00, 0x4F00)) for c in range(a, b)] + list(" '\nab1") * 60
    texts = ["".join(rng.choices(pool, k=40)) for _ in range(1500)] + [chr(c) + "a" for c in range(0x250)]
    a, _ = model.encode([t.encode() for t in texts])
    want = A.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert all(not x or x == y.ids for x, y in zip(a, want, strict=True))
    assert [model.fast.encode_ordinary(" " + t) for t in texts] == [y.ids for y in want]


def test_coalesce():
    start, end = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 6, 3, 5, 6])
    assert coalesce(start, end, np.array([0, 0, 0, 1, 1, 1])).tolist() == [0, 0, 1, 0, 0, 1]
