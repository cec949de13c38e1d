"""Triple sources and sinks."""

from entailer.sources.triples import (  # noqa: F401
    load_graph,
    normalise_vocab,
    parse_lines,
    prepare,
    read_graph,
    read_triples,
    write_graph,
)
