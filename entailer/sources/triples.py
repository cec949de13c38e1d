"""Triple sources and sinks.

* ``tokens``: one triple per line, tokens separated by single spaces, the
  first three tokens are ``s p o`` (anything after them is ignored).
* ``nt``: N-Triples-like lines ``s p <object up to the final ' .'>``; the
  object keeps its inner spaces, so literals survive whole.
* ``parquet``: a table with string columns ``s, p, o``.

Lines that do not yield three non-empty parts are returned as *rejects*
instead of failing the job; a loaded graph carries them.

Terms are written to ``nt`` lines with N-Triples escapes (backslash, line
breaks, tabs, and spaces where they would end a term). Reading decodes every escape of
N-Triples and gives equal literals one spelling (:mod:`entailer.functions.terms`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entailer.functions.terms import bound, read_term
from entailer.functions.vocab import expand_curie
from entailer.operators.graph import TRIPLE_COLS, Graph, split_graph

# The object may hold any character; a closing dot alone is none. No pattern reads on into
# the object: it may be long.
NT_SUBJECT, NT_PREDICATE = r"^\s*(\S+)", r"^\s*\S+\s+(\S+)"
NT_HEAD = r"^\s*\S+\s+\S+\s+"
NT_LINE = NT_HEAD + r"(?!\.\s*\z)\S"
BLANKS = " \t\n\x0b\f\r"  # what ``\s`` matches


# Characters that a line or a term may not hold, and their escapes.
ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"),
           ("\x0b", "\\u000B"), ("\x85", "\\u0085"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]
SPACE, HASH = "\\u0020", "\\u0023"


def escape_term(c, inner_spaces: bool):
    """A term for an ``nt`` line; ``inner_spaces`` may stay in objects only."""
    for raw, mark in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(mark))
    if not inner_spaces:
        c = F.replace(c, F.lit(" "), F.lit(SPACE))
    c = F.when(F.startswith(c, F.lit(" ")), F.concat(F.lit(SPACE), F.substr(c, F.lit(2)))).otherwise(c)
    c = F.when(F.endswith(c, F.lit(" ")), F.concat(
        F.substr(c, F.lit(1), F.length(c) - 1), F.lit(SPACE))).otherwise(c)
    return F.when(F.startswith(c, F.lit("#")), F.concat(F.lit(HASH), F.substr(c, F.lit(2)))).otherwise(c)


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _nt_object(v):
    """What follows subject and predicate, without a closing dot and the blanks around it."""
    blanks = F.lit(BLANKS)
    rest = F.rtrim(F.substr(v, F.length(F.regexp_extract(v, NT_HEAD, 0)) + 1), blanks)
    return bound(rest, lambda x: F.when(F.endswith(x, F.lit(".")), F.rtrim(
        F.substr(x, F.lit(1), F.length(x) - 1), blanks)).otherwise(x))


def parse_lines(lines: DataFrame, fmt: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """``lines(value)`` -> (triples ``(s,p,o)``, rejects ``(value)``)."""
    v = F.col("value")
    if fmt == "tokens":
        parts = F.split(v, " ")
        parsed = lines.select(v, F.get(parts, 0).alias("s"), F.get(parts, 1).alias("p"),
                              F.get(parts, 2).alias("o"))
    elif fmt == "nt":
        lines = lines.where(~F.ltrim(v).startswith("#"))  # N-Triples comments
        parsed = lines.select(v, F.regexp_extract(v, NT_SUBJECT, 1).alias("s"),
                              F.regexp_extract(v, NT_PREDICATE, 1).alias("p"), _nt_object(v).alias("o"))
    else:
        raise ValueError(f"unknown line format {fmt!r}")
    # A filter repeats what it reads: for ``nt`` the line's start tells.
    ok = v.rlike(NT_LINE) if fmt == "nt" else (F.length("s") > 0) & (F.length("p") > 0) & (F.length("o") > 0)
    ok = F.coalesce(ok, F.lit(False))
    triples, rejects = parsed.where(ok).select(*TRIPLE_COLS), parsed.where(~ok).select("value")
    if fmt == "nt":
        triples = triples.select(*[read_term(F.col(c)).alias(c) for c in TRIPLE_COLS])
    return triples, rejects


def read_triples(spark: SparkSession, paths: str | Sequence[str], fmt: str = "tokens",
                 with_rejects: bool = False):
    """Read triples from text (``tokens``/``nt``) or ``parquet``."""
    paths = _paths(paths)
    if fmt == "parquet":
        triples = spark.read.parquet(*paths).select(*TRIPLE_COLS).dropna()
        rejects = spark.createDataFrame([], "value string")
    else:
        triples, rejects = parse_lines(spark.read.text(paths), fmt)
    return (triples, rejects) if with_rejects else triples


def normalise_vocab(triples: DataFrame) -> DataFrame:
    """Expand rdf:/rdfs:/owl: CURIEs to full IRIs in all three positions."""
    return triples.select(*[expand_curie(F.col(c)).alias(c) for c in TRIPLE_COLS])


def prepare(triples: DataFrame, normalise: bool = True, distinct: bool = True) -> DataFrame:
    """Ingest: expand CURIEs, drop incomplete (null) triples, deduplicate."""
    out = normalise_vocab(triples) if normalise else triples
    out = out.dropna()
    return out.dropDuplicates() if distinct else out


def load_graph(spark: SparkSession, abox_path: str | Sequence[str],
               tbox_path: str | Sequence[str] | None = None, fmt: str = "tokens",
               normalise: bool = True, fail_on_rejects: bool = False) -> Graph:
    """S3: instances and schema from separate paths, or one input split by P1.

    Graphs are sets: duplicates are removed once, at ingest. Lines that are no
    triples come back as ``Graph.rejects``; ``fail_on_rejects`` raises if there
    are any (it reads the input for that).
    """
    abox, rejects = read_triples(spark, abox_path, fmt, with_rejects=True)
    if tbox_path is None:
        graph = split_graph(prepare(abox, normalise))
    else:
        tbox, more = read_triples(spark, tbox_path, fmt, with_rejects=True)
        graph = Graph(abox=prepare(abox, normalise), tbox=prepare(tbox, normalise))
        rejects = rejects.unionByName(more)
    if fail_on_rejects and (bad := rejects.take(1)):
        raise ValueError(f"input holds lines that are no triples, such as {bad[0]['value']!r}")
    return replace(graph, rejects=rejects)


def _write(df: DataFrame, path: str, fmt: str, n: int | None, mode: str) -> None:
    if n is not None:
        df = df.repartition(n)
    if fmt == "nt":
        line = F.concat_ws(" ", escape_term(F.col("s"), False), escape_term(F.col("p"), False),
                           escape_term(F.col("o"), True), F.lit("."))
        df.select(line.alias("value")).write.mode(mode).text(path)
    elif fmt == "parquet":
        df.select(*TRIPLE_COLS).write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown sink format {fmt!r}")


def write_graph(graph: Graph, path: str, fmt: str = "nt", n: int | None = None,
                mode: str = "errorifexists") -> None:
    """Write ``path/instance`` and ``path/schema``.

    ``nt`` lines are ``s p o .`` and read back with ``fmt="nt"``; ``n`` sets
    the number of output files (a repartition). An earlier result at ``path``
    is an error unless ``mode="overwrite"`` asks to replace it.
    """
    _write(graph.abox, path.rstrip("/") + "/instance", fmt, n, mode)
    _write(graph.tbox, path.rstrip("/") + "/schema", fmt, n, mode)


def read_graph(spark: SparkSession, path: str, fmt: str = "nt") -> Graph:
    """Read back what :func:`write_graph` wrote; ``rejects`` as in :func:`load_graph`.

    A triple with an empty object is written as a line that is no triple.
    """
    root = path.rstrip("/")
    abox, rejects = read_triples(spark, root + "/instance", fmt, with_rejects=True)
    tbox, more = read_triples(spark, root + "/schema", fmt, with_rejects=True)
    return Graph(abox=abox, tbox=tbox, rejects=rejects.unionByName(more))
