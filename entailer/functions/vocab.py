"""RDF / RDFS / OWL vocabulary and CURIE expansion as Column expressions.

Terms are plain strings: IRIs in angle brackets (N-Triples spelling), CURIEs,
blank nodes and literals are all just tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# The standard W3C vocabulary IRIs the rules are written against, spelled in
# angle brackets as in N-Triples. They must be exactly these strings.
RDFS_SUBPROPERTY_OF = "<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>"
RDFS_SUBCLASS_OF = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
RDFS_DOMAIN = "<http://www.w3.org/2000/01/rdf-schema#domain>"
RDFS_RANGE = "<http://www.w3.org/2000/01/rdf-schema#range>"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
OWL_FUNCTIONAL_PROPERTY = "<http://www.w3.org/2002/07/owl#FunctionalProperty>"
OWL_INVERSE_FUNCTIONAL_PROPERTY = "<http://www.w3.org/2002/07/owl#InverseFunctionalProperty>"
OWL_TRANSITIVE_PROPERTY = "<http://www.w3.org/2002/07/owl#TransitiveProperty>"
OWL_INVERSE_OF = "<http://www.w3.org/2002/07/owl#inverseOf>"
OWL_SYMMETRIC_PROPERTY = "<http://www.w3.org/2002/07/owl#SymmetricProperty>"
OWL_HAS_VALUE = "<http://www.w3.org/2002/07/owl#hasValue>"
OWL_ON_PROPERTY = "<http://www.w3.org/2002/07/owl#onProperty>"
OWL_SOME_VALUES_FROM = "<http://www.w3.org/2002/07/owl#someValuesFrom>"
OWL_ALL_VALUES_FROM = "<http://www.w3.org/2002/07/owl#allValuesFrom>"
OWL_SAME_AS = "<http://www.w3.org/2002/07/owl#sameAs>"

# The three CURIE prefixes and their namespaces.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
}
# ---------------------------------------------------------------------------

# Schema (TBox) triples are those with one of these predicates ...
SCHEMA_PREDICATES = (
    RDFS_SUBCLASS_OF,
    RDFS_SUBPROPERTY_OF,
    RDFS_DOMAIN,
    RDFS_RANGE,
    OWL_INVERSE_OF,
    OWL_HAS_VALUE,
    OWL_ON_PROPERTY,
    OWL_SOME_VALUES_FROM,
    OWL_ALL_VALUES_FROM,
)
# ... or `x rdf:type C` with C one of these property classes.
PROPERTY_CLASSES = (
    OWL_FUNCTIONAL_PROPERTY,
    OWL_INVERSE_FUNCTIONAL_PROPERTY,
    OWL_SYMMETRIC_PROPERTY,
    OWL_TRANSITIVE_PROPERTY,
)

VOCABULARY = (*SCHEMA_PREDICATES, *PROPERTY_CLASSES, RDF_TYPE, OWL_SAME_AS)

RESTRICTION_KINDS = {
    "hasValue": OWL_HAS_VALUE,
    "someValuesFrom": OWL_SOME_VALUES_FROM,
    "allValuesFrom": OWL_ALL_VALUES_FROM,
}


def expand_curie(c: Column) -> Column:
    """`rdf:type` -> `<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>`.

    Only the rdf/rdfs/owl prefixes are expanded; every other token passes
    through unchanged. Pure expression: no join, no shuffle, codegen'd.
    """
    out = c
    for prefix, ns in PREFIXES.items():
        head = prefix + ":"
        out = F.when(
            c.startswith(head),
            F.concat(F.lit("<" + ns), F.substr(c, F.lit(len(head) + 1)), F.lit(">")),
        ).otherwise(out)
    return out


def expand_curie_sql(x: str) -> str:
    """The same expansion as a SQL expression (used by the DuckDB oracle)."""
    arms = " ".join(
        f"WHEN starts_with({x}, '{p}:') THEN '<{ns}' || substr({x}, {len(p) + 2}) || '>'"
        for p, ns in PREFIXES.items()
    )
    return f"CASE {arms} ELSE {x} END"
