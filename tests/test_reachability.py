"""Compact closures against plain search: chains, forests, cycles, dense graphs."""

import random

from pyspark.sql import functions as F

from conftest import rows
from entailer.operators import reachability as R

SCHEMA = "p string, s string, o string"


def closure(edges):
    out = {}
    for p, s, o in edges:
        out.setdefault((p, s), set()).add(o)
    found = set()
    for p, s in out:
        stack, seen = list(out[p, s]), set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get((p, x), ())
        found |= {(p, s, x) for x in seen}
    return found


def random_edges(r, p):
    n = r.randrange(2, 9)
    return {(p, f"{p}{r.randrange(n)}", f"{p}{r.randrange(n)}") for _ in range(r.randrange(1, 2 * n))}


def test_random_graphs(spark):
    """Many small graphs at once, one property each: all pairs, reachable or not."""
    r = random.Random(4)
    edges = set().union(*[random_edges(r, f"g{i}_") for i in range(150)])
    edges |= {("t", f"t{i}", f"t{i // 3}") for i in range(1, 60)}                       # a tree
    edges |= {("c", f"c{i:02}", f"c{(i + 1) % 40:02}") for i in range(40)}              # a cycle
    edges |= {("d", f"d{i}", f"d{j}") for i in range(12) for j in range(i)}             # dense
    edges |= {("l", "l0", "l0"), ("x", "same", "y"), ("y", "y", "same")}
    nodes = {}
    for p, s, o in edges:
        nodes.setdefault(p, set()).update((s, o))
    pairs = {(p, a, b) for p, ns in nodes.items() for a in ns for b in ns} | {("t", "t3", "none")}
    found = R.compact_closure(spark.createDataFrame(sorted(edges), SCHEMA).unionByName(
        spark.createDataFrame([("t", None, "t1"), (None, "t1", "t2")], SCHEMA)))
    assert rows(found.reachable(spark.createDataFrame(sorted(pairs), SCHEMA))) == closure(edges)
    dense = found.links.where("p = 'd'").count()
    assert dense == 0  # every other edge of a total order repeats a path


def test_long_chain_has_linear_rows(spark):
    n = 100_000
    name = lambda c: F.format_string("n%06d", c)
    edges = spark.range(n, numPartitions=8).select(
        F.lit("p").alias("p"), name(F.col("id")).alias("s"), name(F.col("id") + 1).alias("o"))
    found = R.compact_closure(edges)
    assert found.nodes.count() == n + 1 and found.chains.count() == 0 and found.links is None
    i, j = F.col("id") * 7919 % n, F.col("id") * 104729 % n
    pairs = spark.range(3000).select(F.lit("p").alias("p"), name(i).alias("s"), name(j).alias("o"))
    want = {("p", f"n{a:06}", f"n{b:06}") for a, b in (
        (k * 7919 % n, k * 104729 % n) for k in range(3000)) if a < b}
    assert rows(found.reachable(pairs)) == want


def test_empty(spark):
    found = R.compact_closure(spark.createDataFrame([], SCHEMA))
    assert found.rows() == 0
    assert rows(found.reachable(spark.createDataFrame([("p", "a", "b")], SCHEMA))) == set()
