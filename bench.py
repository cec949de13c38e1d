"""Benchmark: headline reasoning operators on the derived graph.

The derived graph of ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) is built
once and stored as parquet triples (timed as ``derive_graph``); every operator
then reads that triple table, as a user of the reasoner would. Each result is
fully computed with the ``noop`` sink. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from entailer.functions import vocab as V  # noqa: E402
from entailer.operators import closure, rules_owl as O, rules_rdfs as R, sameas as S  # noqa: E402
from entailer.operators.fixpoint import state_scope  # noqa: E402
from entailer.operators.graph import (  # noqa: E402
    Graph,
    properties_of_kind,
    relation,
    restrictions,
    types_of,
)
from entailer.plans.materialize import materialize_owl, materialize_rdfs  # noqa: E402
from entailer.plans.testgraph import derived_graph  # noqa: E402
from entailer.sources.triples import read_triples, write_graph  # noqa: E402


def session(cpus: str, scratch: str) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]")
         .appName("entailer-bench")
         .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.driver.memory", "16g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    spark = b.getOrCreate()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ops(g: Graph):
    tb, ab = g.tbox, g.abox
    fp = lambda c: properties_of_kind(tb, c)

    def clusters():
        links = O.owl1(ab, fp(V.OWL_FUNCTIONAL_PROPERTY), distinct=False).unionByName(
            O.owl2(ab, fp(V.OWL_INVERSE_FUNCTIONAL_PROPERTY), distinct=False))
        return S.same_as_clusters(S.same_as_pairs(ab).unionByName(S.same_as_pairs(links)))

    return {
        "rdfs7": lambda: R.rdfs7(ab, closure.transitive_closure(
            relation(tb, V.RDFS_SUBPROPERTY_OF))),
        "rdfs9": lambda: R.rdfs9(types_of(ab), closure.transitive_closure(
            relation(tb, V.RDFS_SUBCLASS_OF))),
        "owl1": lambda: O.owl1(ab, fp(V.OWL_FUNCTIONAL_PROPERTY)),
        "owl2": lambda: O.owl2(ab, fp(V.OWL_INVERSE_FUNCTIONAL_PROPERTY)),
        "owl3": lambda: O.owl3(ab, fp(V.OWL_SYMMETRIC_PROPERTY)),
        "owl15": lambda: O.owl15(ab, types_of(ab), restrictions(tb, "someValuesFrom")),
        "owl4": lambda: closure.owl4(ab, fp(V.OWL_TRANSITIVE_PROPERTY)),
        "owl7_clusters": clusters,
        "owl11": lambda: S.owl11(ab, clusters()),
        "materialize_rdfs": lambda: materialize_rdfs(g).abox,
        "materialize_owl": lambda: materialize_owl(g).abox,
        "materialize_owl_transitive": lambda: materialize_owl(g, transitive=True).abox,
        "materialize_owl_clusters": lambda: materialize_owl(g, same_as="clusters").abox,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="entailer-bench-")
    spark = session(cpus, scratch)

    t0 = time.time()
    graph_dir = os.path.join(scratch, "graph")
    write_graph(derived_graph(spark, sf_dir), graph_dir, fmt="parquet")
    times = {"derive_graph": round(time.time() - t0, 3)}
    g = Graph(abox=read_triples(spark, graph_dir + "/instance", "parquet"),
              tbox=read_triples(spark, graph_dir + "/schema", "parquet"))
    derived_rows = {}
    for name, op in ops(g).items():
        with state_scope(spark):
            t = time.time()
            df = op()
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
            if name.startswith("materialize"):
                derived_rows[name] = df.count()
    total = round(sum(times.values()), 3)
    facts = derived_rows.get("materialize_owl", 0)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "rows": derived_rows,
        "owl_facts_per_sec": round(facts / times["materialize_owl"], 1) if facts else None,
    }))


if __name__ == "__main__":
    main()
