"""owl:sameAs clusters (C5-C7) and substitution (J14, OWL 11).

Clusters are the connected components of the undirected sameAs graph, each
named by its smallest member. They are found with the alternating
large-star / small-star algorithm (Kiveris et al., "Connected Components in
MapReduce and Beyond", SoCC 2014): every step is a partial ``min``
aggregation plus a join back on the node that lets AQE split the centre of a
giant component over tasks; the number of rounds is logarithmic in practice.

The sameAs closure is kept in *canonical* form -- one ``(member, id)`` row per
member -- rather than as all pairs of a cluster, which is quadratic. OWL 11
in canonical form rewrites every term to its cluster id: the rewritten graph plus the
member table entail exactly the substituted triples, at linear size. ``substituted``
spells those triples out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailer.functions import vocab as V
from entailer.operators.fixpoint import fresh, is_empty, new_facts, pin
from entailer.operators.joins import join_back, measure
from entailer.operators.ranks import ranked


def _oriented(pairs: DataFrame) -> DataFrame:
    """Undirected edges as ``(u, v)`` with ``u > v``; self loops dropped."""
    a, b = F.col("a"), F.col("b")
    return (pairs.dropna().where(a != b)
            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node of its neighbourhood."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("mn"))
    low = low.select("x", F.least("mn", "x").alias("mn"))
    return (join_back(both, low, ["x"]).where(F.col("y") > F.col("x"))
            .select(F.col("y").alias("u"), F.col("mn").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("mn"))
    linked = join_back(e, low, ["u"]).select(F.col("v").alias("x"), F.col("mn"))
    centre = low.select(F.col("u").alias("x"), F.col("mn"))
    return (linked.unionByName(centre).where(F.col("x") != F.col("mn"))
            .select(F.col("x").alias("u"), F.col("mn").alias("v")).distinct())


def same_as_clusters(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` -> ``(member, id)`` for every member other than the id.

    Converges when a large-star + small-star round leaves the edge set
    unchanged; at that point every component is a star around its minimum.
    """
    e = pin(_oriented(pairs))
    n = e.count()
    while True:
        nxt = pin(_small_star(_large_star(e)))
        m = nxt.count()
        if m == n and is_empty(nxt.join(fresh(e), ["u", "v"], "left_anti")):
            return nxt.select(F.col("u").alias("member"), F.col("v").alias("id"))
        e, n = nxt, m


def same_as_pairs(facts: DataFrame) -> DataFrame:
    """Asserted sameAs triples as ``(a, b)``."""
    return facts.where(F.col("p") == V.OWL_SAME_AS).select(
        F.col("s").alias("a"), F.col("o").alias("b"))


def with_ids(clusters: DataFrame) -> DataFrame:
    """C6 (flat form): ``(member, id)`` including ``(id, id)`` for every cluster."""
    ids = clusters.select(F.col("id").alias("member"), "id").distinct()
    return clusters.unionByName(ids)


def cluster_members(clusters: DataFrame, size: int = 1000) -> DataFrame:
    """All members of every cluster (incl. the id), its size and its largest member.

    ``id, page, n_members, max_member, members``: one row for each cluster of at most
    ``size`` members, one row a page for a larger one (:func:`cluster_pages`). Counts and
    maxima are partial aggregates, joined back so that a cluster of many pages is split.
    """
    sizes = with_ids(clusters).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_members"), F.max("member").alias("max_member"))
    return join_back(cluster_pages(clusters, size), sizes, ["id"]).select(
        "id", "page", "n_members", "max_member", "members")


def cluster_pages(clusters: DataFrame, size: int = 1000) -> DataFrame:
    """The member lists, in pages ``(id, page, members)`` of at most ``size`` members.

    Members ascend over the pages of a cluster (from page 0; the id comes first). They
    are numbered by ranges, not by a window, so a cluster that holds a third of all
    members spreads over tasks, and no list is longer than a page.
    """
    if size < 1:
        raise ValueError("a page holds at least one member")
    numbered = ranked(with_ids(clusters), ["member"], within=["id"])
    return numbered.groupBy("id", F.floor(F.col("rank") / size).alias("page")).agg(
        F.sort_array(F.collect_list("member")).alias("members"))


def cluster_links(clusters: DataFrame) -> DataFrame:
    """C7 (canonical form): ``member owl:sameAs id`` triples."""
    return clusters.select(F.col("member").alias("s"), F.lit(V.OWL_SAME_AS).alias("p"),
                           F.col("id").alias("o"))


def rewritten(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """J14 (OWL 11, canonical form): triples whose subject or object is a cluster
    member, with every term replaced by its cluster id.

    Triples without a member stand for themselves and are not repeated. The
    member table is joined twice (left joins on the term, broadcast when its
    measured size allows), never expanded per cluster.
    """
    sized = measure(clusters)
    cs = sized.map(lambda c: fresh(c, "s", "sid")).side()
    co = sized.map(lambda c: fresh(c, "o", "oid")).side()
    t = facts.where(F.col("p") != V.OWL_SAME_AS)
    touched = t.join(cs, "s", "left").join(co, "o", "left").where(
        F.col("sid").isNotNull() | F.col("oid").isNotNull())
    return touched.select(F.coalesce("sid", "s").alias("s"), "p", F.coalesce("oid", "o").alias("o"))


def owl11(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Non-sameAs triples of the set ``facts`` plus their canonical rewrite.

    Only rewritten triples are deduplicated and checked against the facts.
    """
    t = facts.where(F.col("p") != V.OWL_SAME_AS).select("s", "p", "o")
    return t.unionByName(new_facts(rewritten(facts, clusters), t))


EXPANSION_BLOCK = 1000  # members of a cluster that one row meets at once


def members_back(facts: DataFrame, members: DataFrame, sizes: DataFrame, block: int = EXPANSION_BLOCK) -> DataFrame:
    """J14's second joins: canonical ``facts(s, p, o)`` over all members of each id.

    ``members(member, id)`` with the ids, ``sizes(id, n)``. Clusters are cut into blocks
    of about ``block`` members, so that no row meets a whole cluster: a pair of large
    clusters becomes many small products.
    """
    blocks = lambda n: F.ceil(F.col(n) / block)
    placed = pin(join_back(members, fresh(sizes), ["id"]).select(
        "id", "member", F.pmod(F.xxhash64("member"), blocks("n")).alias("block")))
    out = facts
    for c in ("s", "o"):
        mine = fresh(placed, c, f"m{c}", "block")
        n = F.coalesce(f"n{c}", F.lit(1))
        out = out.join(measure(sizes).map(lambda d: fresh(d, c, f"n{c}")).side(), c, "left").withColumn(f"n{c}", n)
        out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks(f"n{c}") - 1)))
        # A block may be empty for a term in a cluster; a term without one is its own member.
        # The blocks' rows outgrow any estimate: never broadcast by a guess.
        out = out.join(mine.hint("merge"), [c, "block"], "left").where(
            F.col(f"m{c}").isNotNull() | (F.col(f"n{c}") == 1)).drop("block")
    return out.select(F.coalesce("ms", "s").alias("s"), "p", F.coalesce("mo", "o").alias("o"))


def substituted(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """J14 (OWL 11) in full: ``s p o, s same s', o same o' => s' p o'`` over the set ``facts``.

    Every triple that holds a term of a cluster is rewritten to ids, deduplicated and
    joined back with the members on both sides; the others stand for themselves. sameAs
    triples are left out. The result holds as many triples as the rule derives.
    """
    members = pin(with_ids(clusters.select("member", "id")))
    sizes = pin(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    sized = measure(members)
    cs = sized.map(lambda c: fresh(c, "s", "sid")).side()
    co = sized.map(lambda c: fresh(c, "o", "oid")).side()
    marked = facts.where(F.col("p") != V.OWL_SAME_AS).join(cs, "s", "left").join(co, "o", "left")
    inside = F.col("sid").isNotNull() | F.col("oid").isNotNull()
    canonical = marked.where(inside).select(
        F.coalesce("sid", "s").alias("s"), "p", F.coalesce("oid", "o").alias("o")).distinct()
    return marked.where(~inside).select("s", "p", "o").unionByName(members_back(canonical, members, sizes))
