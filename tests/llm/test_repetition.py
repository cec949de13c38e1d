"""Op 5: suffix arrays against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa

from entailer.llm import repetition
from tests.llm.helpers import DOC_SCHEMA, awkward_rows, docs, records, with_clashes


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = lambda k: [tuple(words[i:i + k]) for i in range(n - k + 1)]

    def repeated(k):
        count = Counter(windows(k))
        return len({j for i, w in enumerate(windows(k)) if count[w] > 1 for j in range(i, i + k)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    longest = 0
    while any(c > 1 for c in Counter(windows(longest + 1)).values()):
        longest += 1
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated(3), repeated(10), longest]


def test_counts_match_brute_force():
    r = random.Random(1)
    parts = ["a", "b", "é", "\n", " ", " ", "\t", "#", "😀 ", "\x0b", "c d e f g h i j k l m "]
    texts = [None, "", "  \n ", "a", "a a", "é ñ\né ñ\n\né ñ", "x\n", "x\nx\n\n", "\nx\nx", "w " * 300]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(80))) for _ in range(200)]
    got = repetition.measure(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [int(got[c][i]) for c in repetition.COUNTS] == brute(t), t


def test_rules_on_awkward_rows(spark):
    rows = awkward_rows()
    rows += [(20, " ".join(f"w{i}" for i in range(200)) + " x " + " ".join(f"w{i}" for i in range(200)), None, None, None),
             (21, " ".join(f"w{i}" for i in range(900)) + " x " + " ".join(f"w{i}" for i in range(110)), None, None, None)]
    want = []
    for r in rows:
        n, chars, sym, dup, rep, cov, longest = brute(r[1])
        failed = n < 50 or 100 * rep > 50 * n
        want.append((r[0], n, chars, sym, dup, rep, failed, not failed and cov <= repetition.MAX_COVERED * n
                     and longest <= repetition.MAX_REPEAT))
    for df in (docs(spark, rows), with_clashes(docs(spark, rows))):
        got = repetition.repetition_rules(df, ["doc_id"])
        assert records(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept") == sorted(want, key=repr)
    by_id = {w[0]: w for w in want}
    assert by_id[20][6] and not by_id[21][6] and not by_id[21][7]  # one by the base rule, one by the longest repeat


def test_empty_table(spark):
    assert repetition.repetition_rules(spark.createDataFrame([], DOC_SCHEMA), ["doc_id"]).count() == 0
