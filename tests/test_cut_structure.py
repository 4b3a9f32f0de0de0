"""Bridges and cut nodes against a plain depth-first search."""

import random

from pyspark.sql import functions as F

from cityloom.operators import traversal


def slow(pairs):
    nodes = {x for p in pairs for x in p}
    def parts(ns, ps):
        seen, n = set(), 0
        for s in ns:
            if s in seen:
                continue
            n, todo = n + 1, [s]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [b for a, b in ps if a == x] + [a for a, b in ps if b == x]
        return n
    base = parts(nodes, pairs)
    bridges = {p for p in pairs if parts(nodes, [q for q in pairs if q != p]) > base}
    cuts = {x for x in nodes if parts(nodes - {x}, [q for q in pairs if x not in q]) > base}
    return bridges, cuts


def run(spark, pairs):
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    b, c = traversal.cut_structure(df.unionByName(df.select(F.col("dst").alias("src"),
                                                            F.col("src").alias("dst"))))
    return {(r.u, r.v) for r in b.collect()}, {r.node for r in c.collect()}


def test_barbell(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
    assert run(spark, pairs) == ({(3, 4)}, {3, 4})


def test_random_graph(spark):
    rng = random.Random(11)
    pairs = {tuple(sorted(rng.sample(range(28), 2))) for _ in range(33)}
    pairs |= {(100, 101), (101, 102), (102, 103)}
    assert run(spark, pairs) == slow(sorted(pairs))
