"""Op 4: phrases and license texts against a brute-force scan."""

import re

from entailer.llm import licenses
from tests.llm.helpers import DOC_SCHEMA, awkward_rows, docs, records, with_clashes

MIT = licenses.LICENSE_TEXTS[0][0]
TEXTS = [
    "Released under the MIT License. mit  LICENSE, apache-license; MİT license",
    "GNU General Public License, version 3 general public\nlicense", "mit", "license mit", None, "",
    MIT.upper().replace(" of ", ", of "), MIT.replace("free of charge ", "") + " mit license",
    "permission is hereby granted", "Licensed under CC BY-NC 4.0.",
]


def brute(text):
    words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({p[1] for p in places})))


def test_base_columns(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + awkward_rows()
    for df in (docs(spark, rows), with_clashes(docs(spark, rows))):
        got = records(licenses.scan_licenses(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


def test_license_texts_with_edits(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got[6] == ("mit", 1.0) and got[7] == ("mit", 1.0)
    assert got[8] == ("", 0.0) and got[9][0] == "cc-by-nc"
    cut = [(0, MIT.replace("free of charge ", ""), None, None, None), (1, "x " + MIT[:60], None, None, None)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs(spark, cut)).collect()}
    assert got[0][0] == "mit" and licenses.MIN_COVER <= got[0][1] < 1 and got[1] == ("", 0.0)


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_a_position_counts_once(spark):
    """Repeating a few words of a license text does not make up the others."""
    apache = licenses.LICENSE_TEXTS[1][0]
    texts = ["with the license " * n for n in (4, 5, 400)] + ["in compliance with the license " * 6, apache,
             apache + " " + "with the license " * 3, "the license " * 50 + "file " * 30 + apache]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == [("", 0.0)] * 4
    assert got[4] == ("apache", 1.0) and got[6][0] == "apache"


def test_long_templates_are_refused(spark):
    import pytest
    with pytest.raises(ValueError, match="split"):
        licenses.template_grams(spark, texts=[("word " * 70, "x")])
