"""The trie against a brute-force one, on awkward conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cityloom.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, length long, home string"


def brute(rows, family=None):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, tie), (role, text)))
    turns = {c: [x for _, x in sorted(xs)] for c, xs in own.items()}
    if family:
        def rebuilt(c):
            base = c - int(c / family) * family
            h = zlib.crc32(str(c).encode()) % 9
            return turns.get(c - base, [])[:h] + turns[c][h:]
        turns = {c: rebuilt(c) for c in turns}
    members = defaultdict(list)
    for c, xs in turns.items():
        for d in range(len(xs) + 1):
            members[tuple(xs[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    def total(p):
        kids = [total(k) for k in children[p]]
        size = len(p[-1][1].encode()) if p else 0
        return (sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (len(members[p]) - 1) * size)
    out = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(turns[c]) == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children[p]), *total(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "k", 7, "h") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in prefix_trie(df, **more).collect()), key=str)


AWKWARD = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, None, "user", "first"),
           (3, 0, None, None), (4, 0, "", ""), (5, 0, "user", "a"), (5, 1, "bot", "b"), (None, 0, "user", "a"),
           (6, 2, "x", "tie"), (6, 2, "x", "tie"), (6, 2, "a", "tie"), (-7, 0, "user", "a"), (-7, 1, "bot", "ü" * 50_000),
           (-5, 0, "user", "a"), (8, 0, "1:", "x"), (9, 0, "1", ":x"), (1 << 62, 0, "user", "a")]


@pytest.mark.parametrize("family", [None, 5])
def test_awkward(spark, family):
    assert run(spark, AWKWARD, family=family) == brute(AWKWARD, family)


def test_random_with_short_blocks(spark):
    """Blocks of three levels and chunks of a few ids: rows run out of keys, hot ends span chunks."""
    rng = random.Random(3)
    rows = [(c, t, "u", rng.choice("ab") if t else "a") for c in range(120) for t in range(rng.choice((1, 1, 2, 5, 7)))]
    rows += [(c, t, "u", f"long {t}") for c in (500, 501, 502) for t in range(11)]
    assert run(spark, rows, block=3, chunk=8, group=2) == brute(rows)
    assert run(spark, rows, family=5, block=2, chunk=8, group=1) == brute(rows, 5)
    assert run(spark, rows, block=4) == brute(rows)


def test_long_conversation(spark):
    rows = [(c, t, "u", f"{t}" if t < 300 else f"{c} {t}") for c in (1, 2, 3) for t in range(500)]
    rows += [(4, t, "u", f"{t}") for t in range(130)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "lost")]) == []
