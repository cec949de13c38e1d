"""N-Triples terms as Column expressions: escapes, kinds, language tags, datatypes.

A term is kept as one string. Two spellings of a term meet once their escapes are
decoded: ``\\u00E9`` and a plain ``é``, or a surrogate pair and ``\\U0001F600``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The one-letter escapes of N-Triples.
LETTER_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
XSD_STRING = "<http://www.w3.org/2001/XMLSchema#string>"
LANG_STRING = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>"

HEX = "[0-9A-Fa-f]"
# Pieces of a term: a surrogate pair, a character by its number (surrogates have none) or a
# letter escape, each with the plain text after it; a lone backslash, plain text.
PIECES = (rf"(?s)(?:\\u[dD][89abAB]{HEX}{{2}}\\u[dD][c-fC-F]{HEX}{{2}}"
          rf"|\\u(?![dD][89a-fA-F]){HEX}{{4}}"
          rf"|\\U(?:0000(?![dD][89a-fA-F])|000[1-9A-Fa-f]|0010){HEX}{{4}}"
          r"|\\[^uU])[^\\]*|[^\\]+|\\")
HIGH_SURROGATES = ("d8", "d9", "da", "db")


def bound(c: Column, expr: Callable[[Column], Column]) -> Column:
    """``expr(c)`` with ``c`` written once, however often ``expr`` names it.

    Filters above are pushed through and repeat the whole expression otherwise.
    """
    return F.get(F.transform(F.array(c), expr), F.lit(0))


def read_term(c: Column) -> Column:
    """A term of an N-Triples line: escapes decoded, equal literals spelled alike."""
    return bound(bound(c, decode_escapes), canonical_term)


def decode_escapes(c: Column) -> Column:
    """Every N-Triples escape decoded; what is no escape stays as it is."""
    def piece(x: Column) -> Column:
        after = lambda n: F.substr(x, F.lit(n + 1))
        pair = F.decode(F.unhex(F.concat(F.substring(x, 3, 4), F.substring(x, 9, 4))), "UTF-16BE")
        short = F.when(F.lower(F.substring(x, 3, 2)).isin(*HIGH_SURROGATES), F.concat(pair, after(12))).otherwise(
            F.concat(F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE"), after(6)))
        long = F.concat(F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"), after(10))
        out = F.when(~x.startswith("\\"), x).when(x.startswith("\\u"), short).when(x.startswith("\\U"), long)
        for letter, plain in LETTER_ESCAPES.items():
            out = out.when(x.startswith("\\" + letter), F.concat(F.lit(plain), after(2)))
        return out.otherwise(x)

    found = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(PIECES), F.lit(0)), piece), "")
    return F.when(F.contains(c, F.lit("\\")), found).otherwise(c)


def _tail(c: Column) -> Column:
    """What follows the closing quote of a literal."""
    return F.substring_index(c, '"', -1)


def kind(c: Column) -> Column:
    """``iri``, ``blank``, ``literal`` or ``other``."""
    tail = _tail(c)
    literal = c.startswith('"') & (F.length(c) - F.length(tail) >= 2) & tail.rlike(
        r"^(?:|@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)$")
    return (F.when(c.startswith("<") & c.endswith(">"), F.lit("iri")).when(c.startswith("_:"), F.lit("blank"))
            .when(literal, F.lit("literal")).otherwise(F.lit("other")))


def term_parts(c: Column) -> Column:
    """``kind, value, lang, datatype`` of a decoded term.

    A literal's language tag is lower-cased, for tags are equal whatever their case; a
    literal without a datatype has that of plain strings, with a tag that of tagged ones.
    """
    k, tail = kind(c), _tail(c)
    value = F.when(k == "literal", F.substring(c, F.lit(2), F.length(c) - F.length(tail) - 2)).when(
        k == "iri", F.substring(c, F.lit(2), F.length(c) - 2)).when(
        k == "blank", F.substring(c, F.lit(3), F.length(c))).otherwise(c)
    tagged = tail.startswith("@")
    lang = F.when((k == "literal") & tagged, F.lower(F.substring(tail, F.lit(2), F.length(tail))))
    datatype = F.when(k == "literal", F.when(tagged, F.lit(LANG_STRING)).when(tail == "", F.lit(XSD_STRING))
                      .otherwise(F.substring(tail, F.lit(3), F.length(tail))))
    return F.struct(k.alias("kind"), value.alias("value"), lang.alias("lang"), datatype.alias("datatype"))


def canonical_term(c: Column) -> Column:
    """One spelling for equal literals: lower-case tag, no datatype for plain strings."""
    tail, plain = _tail(c), F.lit('"^^' + XSD_STRING)
    tagged = tail.rlike(r"^@[A-Za-z]+(?:-[A-Za-z0-9]+)*$") & (F.length(c) - F.length(tail) >= 2)
    return F.when(~c.startswith('"'), c).when(
        F.endswith(c, plain) & (F.length(c) > F.length(plain)),
        F.substring(c, F.lit(1), F.length(c) - F.length(plain) + 1)).when(
        tagged, F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(tail)), F.lower(tail))).otherwise(c)
