"""Mixing against a plain re-computation, on awkward rows and hot sources."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cityloom.llm.mixing import mix, mixed_sizes, mixture, running, targets

SCHEMA = "doc_id long, text string, source string, row_id string, key string, size string, target string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "r", "k", "s", "t") for r in rows], SCHEMA).repartition(parts)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    budget, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = budget - sum(out.values())
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, "c": 900, None: 50}, {"x": 0, "y": 7}, {None: 5}, {"q": 0}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(table).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want)
    for s in want:
        assert math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9)


def test_running_sums_across_slices(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.t for r in running(df, [F.col("id")], {"t": F.col("v")}).collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def plain_mix(rows):
    sizes, size = defaultdict(int), []
    for _, t, s in rows:
        size.append(len(WORD.findall(t or "")))
        sizes[s] += size[-1]
    goal, taken = plain_targets(sizes), Counter()
    for s in sizes:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        mine.sort(key=lambda i: (hashlib.md5(str(rows[i][0]).encode()).hexdigest(), rows[i][0]))
        at = 0
        for turn in range(2):
            for i in mine:
                taken[i] += max(0, min(size[i], math.ceil(goal[s]) - at))
                at += size[i]
    return size, goal, taken


def test_taken_words(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 50)), f"s{i % 7 if i % 3 else 0}") for i in range(300)]
    size, goal, taken = plain_mix(rows)
    got = {r.doc_id: r for r in mixed_sizes(docs_of(spark, rows)).collect()}
    off = 0
    for i, r in enumerate(rows):
        assert got[i].size == size[i] and math.isclose(got[i].target, goal[r[2]], rel_tol=1e-9)
        assert got[i].taken <= 2 * size[i]
        off += taken[i] - got[i].taken
    assert 0 <= off <= 8  # ceilings of the targets less the budget
    assert sum(r.taken for r in got.values()) == int(1.5 * sum(size))
    again = {r.doc_id: r.taken for r in mixed_sizes(docs_of(spark, rows, 7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", "b"), (3, "a b\x0bc  d", None), (None, "x y", "b"), (4, "p q", "b"),
            (4, "p q", "b"), (5, "w " * 50_000, "b")]
    docs = docs_of(spark, rows)
    got = mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.taken for r in got) == int(1.5 * sum(r.size for r in got))
    out = mixture(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
    plan = Counter()
    for r in mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect():
        plan[r.source] += sum(r.served)
    assert sum(words.values()) == int(1.5 * sum(r.size for r in got))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixed_sizes(docs).count() == 0
    assert mixture(docs).count() == 0
