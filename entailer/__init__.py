"""entailer: RDFS and OWL-Horst forward-chaining materialisation on Spark.

Every rule is a DataFrame operator; recursive parts run as semi-naive loops
of Spark joins with reliable checkpoints between rounds.
"""

from entailer.operators.graph import Graph, split_graph  # noqa: F401
from entailer.plans.materialize import materialize_owl, materialize_owl_encoded, materialize_rdfs  # noqa: F401
from entailer.sources.triples import load_graph, read_triples, write_graph  # noqa: F401
