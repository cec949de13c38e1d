"""Op 9: fingerprints and components against brute force; the Golay keys' promise."""

import itertools

import numpy as np
import pyarrow as pa
import xxhash

from entailer.llm import simhash
from entailer.llm.queries import op9_simhash_near_copies
from entailer.operators.fixpoint import pin
from tests.llm.helpers import DOC_SCHEMA, as_table, awkward_rows, docs, prose, records, with_clashes

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, k=4):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, fps):
    """Smallest id reachable over links of at most 4 bits, by plain search."""
    distinct = sorted(set(fps))
    near = {f: [g for g in distinct if bin(f ^ g).count("1") <= 4] for f in distinct}
    label = {}
    for f in distinct:
        if f not in label:
            stack, seen = [f], {f}
            while stack:
                for g in near[stack.pop()]:
                    if g not in seen:
                        seen.add(g)
                        stack.append(g)
            ids = [r[0] for r, x in zip(rows, fps) if x in seen and r[0] is not None]
            label.update(dict.fromkeys(seen, min(ids) if ids else None))
    return [label[x] for x in fps]


def family(seed, n):
    """A chain of near copies: each changes one more word of a long text."""
    words = prose(seed, 300).split()
    out = []
    for i in range(n):
        words[i * 7 % 300] = f"changed{i}"
        out.append(" ".join(words))
    return out


def test_fingerprints():
    texts = [r[1] for r in awkward_rows()] + ["A  B\nc d", "a b", "É x y z w"]
    assert [int(x) for x in simhash.text_fingerprints(pa.array(texts, pa.string()))] == [fingerprint(t) for t in texts]


def test_golay_keys():
    golay = simhash.Golay()
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 23, 4000)
    keys = golay.keys(words)
    assert set((keys >= 0).sum(1)) <= {1, 6}
    for bits in (1, 2):
        flip = np.zeros(4000, np.int64)
        for row in range(4000):
            flip[row] = sum(1 << int(b) for b in r.choice(23, bits, replace=False))
        other = golay.keys(words ^ flip)
        shared = [set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys.tolist() and keys, other)]
        assert all(shared)
        if bits == 1:  # one's nearest codeword is a key of the other
            assert all(a[0] in b for a, b in zip(keys, other))


def test_every_pattern_of_four_bits_shares_a_guaranteed_key():
    golay = simhash.Golay()
    r = np.random.default_rng(3)
    f = r.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    flips = [0] + [sum(1 << int(b) for b in r.choice(64, n, replace=False)) for n in (1, 2, 3, 4) for _ in range(150)]
    flips += [sum(1 << b for b in c) for c in itertools.product((0, 22), (23, 45), (46, 63))]
    fps = np.array([int(f) ^ x for x in flips], np.uint64)
    rows, keys, sides = simhash.key_rows(fps, golay)
    left, right = {}, {}
    for row, key, side in zip(rows.tolist(), keys.tolist(), sides.tolist()):
        if side <= 1:
            left.setdefault(row, set()).add(key)
        if side != 1:
            right.setdefault(row, set()).add(key)
    for i in range(1, len(fps)):
        if fps[i] != fps[0]:
            assert left[0] & right[i] and left[i] & right[0]


def test_components(spark, tmp_path):
    rows = awkward_rows()
    rows += [(100 + i, t, None, None, None) for i, t in enumerate(family(21, 40))]
    rows += [(300 + i, t, None, None, None) for i, t in enumerate(family(22, 25))]
    rows += [(400 + i, prose(50 + i, 80), None, None, None) for i in range(40)]
    fps = [fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, components(rows, fps))), key=repr)
    for df in (docs(spark, rows), with_clashes(docs(spark, rows))):
        sf = as_table(str(tmp_path), documents=df)
        assert records(op9_simhash_near_copies(spark, sf)) == want
    assert len({w[2] for w in want}) < len(set(fps))


def test_random_fingerprints(spark):
    """Links with up to 4 differing bits, also across segments, and dense groups."""
    r = np.random.default_rng(7)
    base = [int(x) for x in r.integers(0, 1 << 63, 60, dtype=np.uint64)]
    fps = list(base)
    for f in base:
        for _ in range(r.integers(0, 4)):
            fps.append(f ^ sum(1 << int(b) for b in r.choice(64, r.integers(1, 8), replace=False)))
    fps += [base[0] ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 5), 2)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, f) for f in signed], "fp long, comp long")
    got = {frozenset((a, b)) for a, b in ((x["a"], x["b"]) for x in simhash.cross_links(df).collect())}
    want = {frozenset(p) for (i, p) in ((i, (signed[i], signed[j])) for i in range(len(fps)) for j in range(i)
                                        if bin(fps[i] ^ fps[j]).count("1") <= 4)}
    assert got == want


def test_empty_table(spark):
    assert simhash.near_copies(spark.createDataFrame([], DOC_SCHEMA), ["doc_id"]).count() == 0


def test_joins_of_exploded_keys_are_never_broadcast(spark):
    """Spark sizes many keys of a row as one row: a small table must not tempt it to broadcast them."""
    fps = pin(spark.range(50).selectExpr("id as fp", "id as comp"))
    for links in (simhash.star_links(fps), simhash.cross_links(fps)):
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
