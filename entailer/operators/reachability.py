"""Transitive properties in compact form (C1, C4): chain labels instead of all pairs.

The closure of a chain of n terms has n(n-1)/2 pairs. Here a term has one label, its
(chain, depth), and a pair is answered by a join on labels:

* Every term points to one of its successors (the one with most successors of its own:
  paths grow long, and shortcuts repeat them). Where these pointers form a cycle, the cycle's smallest term lets go; the rest is a forest, and a term reaches
  its ancestors.
* The forest falls into *chains*: a term continues the chain of its parent if its
  subtree is the largest among the parent's children. A path to the root therefore
  changes its chain at most ``log2(n)`` times. ``chains`` lists for every chain the
  chains above it and the depth at which its path enters them.
* All other edges are *links*. A link reaches, on every chain, all terms up to some
  depth: one row for each link and chain is its closure, whatever the path.

All steps are joins of whole tables with pointer doubling, so a chain of 100,000 terms
takes 17 rounds. Cycles need no condensation: they are links like any other edge.
Forests (such as replies) give as many rows as terms and chains; many links between
many chains give more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.operators.fixpoint import fresh, is_empty, pin
from entailer.operators.joins import measure

KEY = "p"


def _double(state: DataFrame) -> DataFrame:
    """One round of pointer doubling.

    ``state(p, node, ptr, dist, low, size)``: ``ptr`` is ``dist`` steps up (null past a
    root), ``low`` the smallest term on the way, ``size`` the terms at most that many
    steps below.
    """
    up = state.select(KEY, F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"),
                      F.col("dist").alias("dist2"), F.col("low").alias("low2"))
    moving = fresh(state).where(F.col("ptr").isNotNull())
    moved = moving.join(up, [KEY, "ptr"]).select(
        KEY, "node", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"),
        F.least("low", "low2").alias("low"), "size")
    below = fresh(state).where(F.col("ptr").isNotNull()).groupBy(KEY, F.col("ptr").alias("node")).agg(
        F.sum("size").alias("more"))
    grown = moved.unionByName(fresh(state).where(F.col("ptr").isNull()))
    return grown.join(below, [KEY, "node"], "left").select(
        KEY, "node", "ptr", "dist", "low", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))


def _start(parents: DataFrame) -> DataFrame:
    return pin(parents.select(
        KEY, "node", F.col("parent").alias("ptr"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("node").alias("low"), F.lit(1).cast("long").alias("size")))


def _jump_to_roots(parents: DataFrame, n: int) -> DataFrame:
    """Doubles until every pointer is past a root, or certainly on a cycle."""
    state, steps = _start(parents), 1
    while steps <= n and not is_empty(state.where(F.col("ptr").isNotNull())):
        state, steps = pin(_double(state)), steps * 2
    return state


def _chain_tops(heavy: DataFrame) -> DataFrame:
    """``heavy(p, node, ptr)``: the term above on the same chain, null at its top."""
    state = pin(heavy.select(KEY, "node", F.coalesce("ptr", "node").alias("top"), F.col("ptr").isNull().alias("done")))
    while not is_empty(state.where(~F.col("done"))):
        up = state.select(KEY, F.col("node").alias("top"), F.col("top").alias("top2"), F.col("done").alias("done2"))
        rows = fresh(state)
        moved = rows.where(~F.col("done")).join(up, [KEY, "top"]).select(
            KEY, "node", F.col("top2").alias("top"), F.col("done2").alias("done"))
        state = pin(moved.unionByName(fresh(state).where("done")))
    return state.select(KEY, "node", F.col("top").alias("chain"))


@dataclass(frozen=True)
class CompactClosure:
    """``nodes(p, node, chain, depth)``, ``chains(p, chain, above, entry)``,
    ``links(p, link, chain, depth)`` by their tails, and ``reach(p, link, chain, depth)``.

    ``links`` and ``reach`` are None for a forest.
    """

    nodes: DataFrame
    chains: DataFrame
    links: DataFrame | None
    reach: DataFrame | None

    def rows(self) -> int:
        return sum(t.count() for t in (self.nodes, self.chains, self.links, self.reach) if t is not None)

    def on_chains(self, nodes: DataFrame) -> DataFrame:
        """``nodes(p, ..., chain, depth)`` with every chain that they reach by the forest."""
        above = self.chains.select(KEY, "chain", "above", "entry")
        rest = [c for c in nodes.columns if c not in ("chain", "depth")]
        up = nodes.join(above, [KEY, "chain"]).select(
            *rest, F.col("above").alias("chain"), F.col("entry").alias("depth"))
        return nodes.select(*rest, "chain", "depth").unionByName(up)

    def reachable(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(p, s, o)`` that the transitive closure contains, distinct."""
        pairs = pairs.select(KEY, "s", "o").distinct()
        label = lambda c: self.nodes.select(
            KEY, F.col("node").alias(c), F.col("chain").alias(f"c{c}"), F.col("depth").alias(f"d{c}"))
        known = pin(pairs.join(label("s"), [KEY, "s"]).join(label("o"), [KEY, "o"]))
        same = known.where((F.col("cs") == F.col("co")) & (F.col("do") < F.col("ds"))).select(KEY, "s", "o")
        above = self.chains.select(KEY, F.col("chain").alias("cs"), F.col("above").alias("co"), "entry")
        higher = fresh(known).join(above, [KEY, "cs", "co"]).where(F.col("do") <= F.col("entry")).select(KEY, "s", "o")
        found = same.unionByName(higher)
        if self.links is not None:
            starts = fresh(known).select(KEY, "s", F.col("cs").alias("chain"), F.col("ds").alias("depth")).distinct()
            tails = self.links.select(KEY, "chain", "link", F.col("depth").alias("tail"))
            by_link = self.on_chains(starts).join(tails, [KEY, "chain"]).where(
                F.col("tail") <= F.col("depth")).select(KEY, "s", "link").distinct()
            ends = fresh(self.reach, KEY, "link", "co", "most")
            deepest = by_link.join(ends, [KEY, "link"]).groupBy(KEY, "s", "co").agg(F.max("most").alias("most"))
            found = found.unionByName(fresh(known).join(deepest, [KEY, "s", "co"]).where(
                F.col("do") <= F.col("most")).select(KEY, "s", "o"))
        return found.distinct()


def _above(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``(p, chain, above, entry)`` for every chain above another."""
    tops = nodes.where(F.col("node") == F.col("chain")).select(KEY, "chain").join(
        parents.select(KEY, F.col("node").alias("chain"), F.col("parent").alias("node")), [KEY, "chain"])
    at = nodes.select(KEY, "node", F.col("chain").alias("above"), F.col("depth").alias("entry"))
    step = pin(tops.where(F.col("node").isNotNull()).join(at, [KEY, "node"]).select(KEY, "chain", "above", "entry"))
    found, delta = step, step
    while not is_empty(delta):  # a path changes its chain log2(n) times at most
        up = fresh(step, KEY, "above", "above2", "entry2")
        delta = pin(fresh(delta).join(up, [KEY, "above"]).select(
            KEY, "chain", F.col("above2").alias("above"), F.col("entry2").alias("entry")))
        found = found.unionByName(delta)
    return pin(found)


def _link_reach(closure: CompactClosure, heads: DataFrame) -> DataFrame:
    """``(p, link, chain, depth)``: how deep every link reaches into every chain.

    Semi-naive: a row that got deeper passes on what the links on its way reach,
    which doubles the links on a path each round. Only the deepest row counts.
    """
    deepest = lambda df: df.groupBy(KEY, "link", "chain").agg(F.max("depth").alias("depth"))
    reach = pin(deepest(closure.on_chains(heads)))
    delta = reach
    tails = closure.links.select(KEY, "chain", F.col("link").alias("via"), F.col("depth").alias("tail"))
    while not is_empty(delta):
        met = pin(fresh(reach).join(tails, [KEY, "chain"]).where(F.col("tail") <= F.col("depth"))
                  .select(KEY, "link", "via").distinct())
        onward = fresh(reach, KEY, "via", "chain", "depth")
        new = deepest(met.join(onward, [KEY, "via"]).select(KEY, "link", "chain", "depth"))
        old = fresh(reach).withColumnRenamed("depth", "old")
        delta = pin(new.join(old, [KEY, "link", "chain"], "left")
                    .where(F.col("old").isNull() | (F.col("depth") > F.col("old")))
                    .select(KEY, "link", "chain", "depth"))
        reach = pin(deepest(fresh(reach).unionByName(fresh(delta))))
    return reach


def compact_closure(edges: DataFrame) -> CompactClosure:
    """Labels of the transitive closure of ``edges(p, s, o)``, each ``p`` on its own.

    Edges with a null are dropped; repeated edges count once.
    """
    edges = pin(edges.select(KEY, "s", "o").dropna().distinct())
    nodes = edges.select(KEY, F.col("s").alias("node")).unionByName(
        edges.select(KEY, F.col("o").alias("node"))).distinct()
    degree = edges.groupBy(KEY, F.col("s").alias("o")).agg(F.count(F.lit(1)).alias("degree"))
    first = fresh(edges).where(F.col("s") != F.col("o")).join(fresh(degree), [KEY, "o"], "left").groupBy(
        KEY, F.col("s").alias("node")).agg(F.max_by("o", F.struct("degree", "o")).alias("parent"))
    parents = pin(nodes.join(first, [KEY, "node"], "left"))
    n = parents.count()
    state = _jump_to_roots(parents, n)
    circling = state.where(F.col("ptr").isNotNull()).select(KEY, F.col("ptr").alias("node")).distinct()
    if not is_empty(circling):
        # Past n steps a pointer is on a cycle, and the next n steps saw all of it.
        loose = pin(circling.join(fresh(state), [KEY, "node"]).select(KEY, F.col("low").alias("node")).distinct())
        freed = fresh(loose).withColumn("free", F.lit(True))
        parents = pin(fresh(parents).join(freed, [KEY, "node"], "left").select(
            KEY, "node", F.when(F.col("free").isNull(), F.col("parent")).alias("parent")))
        state = _jump_to_roots(parents, n)
    sized = fresh(state).select(KEY, "node", F.col("dist").alias("depth"), "size")
    children = pin(fresh(parents).join(sized, [KEY, "node"]))
    largest = children.where(F.col("parent").isNotNull()).groupBy(KEY, "parent").agg(
        F.max_by("node", F.struct("size", "node")).alias("heir"))
    heavy = fresh(children).join(fresh(largest), [KEY, "parent"], "left").select(
        KEY, "node", F.when(F.col("node") == F.col("heir"), F.col("parent")).alias("ptr"))
    tops = _chain_tops(heavy)
    labels = pin(fresh(children).select(KEY, "node", "depth").join(tops, [KEY, "node"]).select(
        KEY, "node", "chain", "depth"))
    found = CompactClosure(labels, _above(labels, parents), None, None)
    # Edges beside the forest, but for those that only repeat a path up.
    beside = pin(fresh(edges).join(fresh(parents, KEY, "s", "parent"), [KEY, "s"]).where(
        F.col("parent").isNull() | (F.col("o") != F.col("parent"))).select(KEY, "s", "o"))
    if not is_empty(beside):
        beside = pin(beside.join(fresh(found.reachable(beside)), [KEY, "s", "o"], "left_anti")
                     .withColumn("link", F.monotonically_increasing_id()))
    if is_empty(beside):
        return found
    at = lambda c: labels.select(KEY, F.col("node").alias(c), "chain", "depth")
    tails = pin(fresh(beside).join(at("s"), [KEY, "s"]).select(KEY, "link", "chain", "depth"))
    heads = fresh(beside).join(at("o"), [KEY, "o"]).select(KEY, "link", "chain", "depth")
    found = CompactClosure(found.nodes, found.chains, tails, None)
    return CompactClosure(found.nodes, found.chains, tails, _link_reach(found, heads))


def owl4_compact(facts: DataFrame, transitive_props: DataFrame) -> CompactClosure:
    """C4 in compact form: the closure of every transitive property at once."""
    from entailer.operators.rules_owl import prune

    return compact_closure(prune(facts, measure(transitive_props)))
