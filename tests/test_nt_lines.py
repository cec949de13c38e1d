"""Lines of N-Triples: the parts are found without patterns that read on into the object."""

import re

from conftest import rows
from entailer.sources.triples import parse_lines

WHOLE = re.compile(r"^[ \t\n\x0b\f\r]*([^ \t\n\x0b\f\r]+)[ \t\n\x0b\f\r]+([^ \t\n\x0b\f\r]+)[ \t\n\x0b\f\r]+"
                   r"(?!\.[ \t\n\x0b\f\r]*\Z)([^ \t\n\x0b\f\r].*?)[ \t\n\x0b\f\r]*\.?[ \t\n\x0b\f\r]*\Z", re.S)
LINES = ["a b c .", "a b c", " a\tb  c d . ", "a b .", "a b . ", "a b ..", "a b . .", "a b c..", "a b c. .", "a b",
         "a", "", " ", "a b c\n.\n", "a b \x85 .", 'a b "x . y" .', "a b c \x0b. \f", ". . . .", ". . ."]


def test_parts_are_those_of_the_whole_line_pattern(spark):
    triples, rejects = parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string"), "nt")
    found = [(x, WHOLE.match(x)) for x in LINES]
    assert rows(triples) == {m.groups() for _, m in found if m}
    assert rows(rejects, "value") == {(x,) for x, m in found if not m}


def test_a_part_takes_one_short_pattern(spark):
    """Each part read the whole line by a pattern, in the filter and again in the result."""
    triples = parse_lines(spark.createDataFrame([("a b c .",)], "value string"), "nt")[0]
    plan = triples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 3
