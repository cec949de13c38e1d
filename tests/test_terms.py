"""N-Triples escapes and terms against a plain decoder."""

import re

from pyspark.sql import functions as F

from entailer.functions.terms import canonical_term, decode_escapes, term_parts
from entailer.sources.triples import parse_lines

PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def decode(text):
    def one(m):
        x = m[0]
        if x[1:2] in ("u", "U") and len(x) > 2:
            raw = bytes.fromhex(x.replace("\\u", "").replace("\\U", ""))
            return raw.decode("utf-16-be" if x[1] == "u" else "utf-32-be")
        return PLAIN.get(x[1:], x)

    return re.sub(r"\\u[dD][89abAB]..\\u[dD][c-fC-F]..|\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}"
                  r"|\\U(?:0000(?![dD][89a-fA-F])|000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4}|\\[^uU]", one, text)


TEXTS = ["", "plain é 日本", r"é é \U000000E9", r"\\u00E9 \\é", r"😀 \U0001F600",
         r"\uD83D alone \uDE00", r"\UFFFFFFFF \U0010FFFF \U00110000 \U0000D800", r"\t\b\n\r\f\"\'\\", r"\q \u12 \U123", "\\",
         "x" * 100_000 + r"A" * 2000, r"\u0000", "new\nline \\u0009"]


def test_escapes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["d"] for r in df.select("i", decode_escapes(F.col("t")).alias("d")).collect()}
    assert got.pop(99) is None
    assert got == {i: decode(t) for i, t in enumerate(TEXTS)}


def test_parts(spark):
    string, tagged = "<http://www.w3.org/2001/XMLSchema#string>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>"
    cases = {
        "<ex:a>": ("iri", "ex:a", None, None), "_:b1": ("blank", "b1", None, None),
        '"x"': ("literal", "x", None, string), '""': ("literal", "", None, string),
        '"a "b" c"@EN-gb': ("literal", 'a "b" c', "en-gb", tagged), f'"5"^^{string}': ("literal", "5", None, string),
        '"5"^^<ex:int>': ("literal", "5", None, "<ex:int>"), '"': ("other", '"', None, None),
        '"open': ("other", '"open', None, None), '"x"@': ("other", '"x"@', None, None), "token": ("other", "token", None, None),
        '"x"^^<a b>': ("other", '"x"^^<a b>', None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: tuple(r["p"]) for r in df.select("t", term_parts(F.col("t")).alias("p")).collect()}
    assert got == cases
    same = spark.createDataFrame([(f'"x"^^{string}',), ('"x"',), ('"x"@EN',), ("<ex:a>",)], "t string")
    assert [r[0] for r in same.select(canonical_term(F.col("t"))).collect()] == ['"x"', '"x"', '"x"@en', "<ex:a>"]


def test_spellings_meet_on_reading(spark):
    lines = [r'<ex:café> <p> "😀" .', '<ex:café> <p> "😀"^^<http://www.w3.org/2001/XMLSchema#string> .',
             '<ex:caf\\U000000e9>\t<p>\t"\\U0001F600".']
    triples, rejects = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "nt")
    assert {tuple(r) for r in triples.collect()} == {("<ex:café>", "<p>", '"😀"')}
    assert rejects.count() == 0
