"""Fingerprints, links and components against brute force."""

import os
import random

import numpy as np
import pytest
import xxhash

from cityloom.llm.simhash import RADIUS, fingerprint, forest, links, shingle_hashes, simhash_components

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i % 5000}" for i in range(200_000))


def plain_print(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in fold.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(prints):
    """doc_id, hexadecimal fingerprint and component_id by comparing all rows."""
    root = list(range(len(prints)))
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= RADIUS:
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((d, f"{p:016x}", least.get(top(i))) for i, (d, p) in enumerate(prints)), key=str)


def run(df, **more):
    return sorted((tuple(r) for r in simhash_components(df, **more).collect()), key=str)


def test_hash_is_sparks(spark):
    """The shingle hash is the engine's own xxhash64."""
    text = "Ünïcode A  b\tC d"
    want = [r[0] & (1 << 64) - 1 for r in spark.sql(
        "SELECT xxhash64(s) FROM VALUES ('Ünïcode a b'), ('a b c'), ('b c d') AS t(s)").collect()]
    assert sorted(shingle_hashes(text.encode()).tolist()) == sorted(want)


@pytest.mark.parametrize("text", ["", " \t", "One", "one TWO", "a b c", "a b c d", "É x y z w q", LONG[:9000], "x " * 9])
def test_fingerprint(text):
    assert fingerprint(shingle_hashes(text.encode())) == plain_print(text)


def test_awkward(spark):
    rows = [(1, "a b c", "x"), (2, "A b\tc", "x"), (3, None, "x"), (4, "", "x"), (None, "alone in here now", "x"),
            (None, "", "x"), (5, LONG, "x"), (6, LONG + " end", "x"), (6, LONG + " end", "x"), (7, "ä ö", "x"), (9, "ä ö", "x")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, tile string, print long, a string")
    assert run(df.repartition(4)) == brute([(d, plain_print(t)) for d, t, _ in rows])


def test_chains_and_split_tiles(spark, monkeypatch):
    """Planted fingerprints: chains within the radius, a dense group, neighbours across tiles and parts."""
    import cityloom.llm.simhash as module

    rng, values = random.Random(5), []
    for _ in range(150):
        at = rng.getrandbits(64)
        values.append(at)
        for _ in range(rng.choice((0, 0, 3, 9))):
            for bit in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
                at ^= 1 << bit
            values.append(at)
    core = rng.getrandbits(64)
    values += [core ^ 1 << a ^ 1 << b for a in range(9) for b in range(12)] + [0, 1, (1 << 64) - 1, (1 << 63)]
    prints = list(enumerate(values))
    rng.shuffle(prints)
    df = spark.createDataFrame([(d, p - (1 << 64) if p >> 63 else p) for d, p in prints], "doc_id long, print long")
    monkeypatch.setattr(module, "fingerprints", lambda docs: docs)
    for segments, tile in ((4, 3), (2, 50), (1, 8192)):
        assert run(df.repartition(3), segments=segments, tile=tile) == brute(prints)


def test_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r.doc_id, plain_print(r.text)) for r in docs.select("doc_id", "text").collect()])
    assert run(docs) == want


def test_forest_keeps_parts():
    values = np.array([0, 1, 3, 7, 1 << 40, 255], np.uint64)
    a, b = forest(values, None)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (3, 0), (7, 0), (1 << 40, 0)]
    assert len(links(values[:2], values[2:])[0]) == 6


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run(empty) == []
