"""The Jaccard join against all pairs, and its parts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import components as cc
from chronoweave.llm import jaccard
from chronoweave.llm._store import Stage
from chronoweave.llm.components import components

from .util import clashing, copies, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(pairs, num=80, den=100):
    sets = {i: shingles(t) for i, t in pairs}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and (both := len(sets[i] & sets[j])) and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in sets}


def result(df):
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    pairs = copies(seed)
    assert result(jaccard.jaccard_components(docs(spark, pairs))) == brute(pairs)


@pytest.mark.parametrize("frequent", [2, 3])
def test_frequent_shingles_use_combinations(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)  # so that classes of two to four shingles occur
    monkeypatch.setattr(jaccard, "SMALL", 16)
    pairs = copies(3, groups=3, each=14, words=60, edits=6)
    assert result(jaccard.jaccard_components(docs(spark, pairs))) == brute(pairs)


@pytest.mark.parametrize("together", [1, 16])
def test_copies_around_a_pivot(spark, monkeypatch, together):
    """Copies near and just beyond the threshold from one text and from each other, linked only in part."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    r, pairs = random.Random(11), []
    base = [f"w{i}" for i in range(150)]
    for i in range(60):
        t = list(base)
        for k in r.sample(range(0, 150, 5), r.choice([1, 2, 3, 4, 5])):
            t[k] = f"e{r.randrange(3)}" if r.random() < 0.5 else f"x{r.randrange(10**6)}"
        pairs.append((i + 1, " ".join(t)))
    for i in range(20):  # second generation: copies of copies
        t = pairs[r.randrange(60)][1].split()
        for k in r.sample(range(150), 2):
            t[k] = f"y{r.randrange(10**6)}"
        pairs.append((100 + i, " ".join(t)))
    assert result(jaccard.jaccard_components(docs(spark, pairs))) == brute(pairs)


def test_signatures_never_miss_a_link(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 60)
    r = random.Random(5)
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(200):
        n = r.randrange(2, 400)
        pool = np.unique(rng.integers(0, 2**63, 3 * n, dtype=np.uint64))
        x = np.sort(rng.choice(pool, n, replace=False))
        drop = r.randrange(0, max(1, n // 9) + 1)
        y = np.unique(np.concatenate([rng.choice(x, n - drop, replace=False), rng.choice(pool, drop)]))
        same = len(np.intersect1d(x, y))
        keys = np.unique(rng.choice(pool, r.randrange(0, len(pool)), replace=False) >> np.uint64(64 - jaccard.KEY_BITS)).astype(np.int64)
        often = [(keys | (rng.integers(1, 4, len(keys)) << jaccard.KEY_BITS)).tobytes()]
        b = pa.RecordBatch.from_arrays([pa.array([x.tobytes(), y.tobytes()], pa.binary()), pa.array([b"1", b"2"], pa.binary()), pa.array([n, n], pa.int32()), pa.array([often, often], pa.list_(pa.binary()))], names=["toks", "id", "shared", "often"])
        sig = {b"1": set(), b"2": set()}
        for o in jaccard._signatures(80, 100)([b]):
            for s, i in zip(o.column("s").to_pylist(), o.column("id").to_pylist(), strict=True):
                sig[i].add(s)
        if 100 * same >= 80 * (len(x) + len(y) - same):
            linked += 1
            assert sig[b"1"] & sig[b"2"]
    assert linked > 50


def test_words_of_one_polynomial_value_differ(spark):
    """Thue-Morse words over a and b: equal under any polynomial hash modulo a power of two."""
    x = "ab"
    for _ in range(10):
        x += x.translate({97: 98, 98: 97})
    y = x.translate({97: 98, 98: 97})
    assert result(jaccard.jaccard_components(docs(spark, [(1, x), (2, y), (3, y)]))) == {(1, 1, 1), (2, 1, 2), (3, 1, 2)}


def test_unlike_texts_of_one_document(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (3, b)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 36, 1), (3, 37, 1)]


def test_edges(spark):
    assert jaccard.jaccard_components(docs(spark, [(1, "a b")]).limit(0)).count() == 0
    rows = [(3, "a b c"), (3, "a b c"), (None, "a b c"), (9, "a b c"), (10, None)]
    got = sorted(jaccard.jaccard_components(clashing(docs(spark, rows))).collect(), key=str)
    assert sorted(map(str, got)) == sorted(["Row(doc_id=3, n_shingles=1, component_id=3)"] * 2 + ["Row(doc_id=None, n_shingles=1, component_id=3)", "Row(doc_id=9, n_shingles=1, component_id=3)", "Row(doc_id=10, n_shingles=0, component_id=10)"])
    long = " ".join(f"v{i}" for i in range(30000))
    assert result(jaccard.jaccard_components(docs(spark, [(1, long), (2, long + " end"), (3, "x")]))) == {(1, 29996, 1), (2, 29997, 1), (3, 1, 3)}


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 240), r.randrange(200, 240)) for _ in range(20)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "t")).collect()}
    comp = {}
    for a, b in edges:
        if a != b:
            comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    assert components(spark.createDataFrame([], "a long, b long"), Stage(spark, "t")).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_both_ways(spark, monkeypatch, few):
    """Merged in one task and step by step: the same components, of numbers and of bytes."""
    monkeypatch.setattr(cc, "FEW", few)
    r = random.Random(9)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)]
    comp = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(frame, Stage(spark, "t")).collect()} == comp
    wide = frame.selectExpr("unhex(lpad(hex(a), 4, '0')) a", "unhex(lpad(hex(b), 4, '0')) b")
    assert {int.from_bytes(r["node"]): int.from_bytes(r["component"]) for r in components(wide, Stage(spark, "t")).collect()} == comp


def _around(spark, diffs, n=60):
    """``_across`` on sets of no component around one pivot: (id, entries of the difference)."""
    rows = []
    for i, d in diffs:
        m = len(d)
        half, far = (m + 1) // 2, m - n * 20 // 80  # the pivot has n entries too
        rows.append((b"r", bytes([i]), False, n, m, m - max(1, half, far) + 1, m - max(1, far) + 1, np.array(sorted(d), np.int64).tobytes(), bytes([i])))
    kinds = "r binary, id binary, link boolean, n int, m int, short int, long int, diff binary, c binary"
    hubs = spark.createDataFrame([], "c binary, hub binary, size long")
    return jaccard._across(spark.createDataFrame(rows, kinds), hubs, lambda df: df.withColumn("c", F.col("id")), Stage(spark, "t"), 80, 100)


def test_differences_meet_at_their_rarest_entries(spark):
    """Sets that share under half of their differences, the first ones by number, are no candidates; one pair that shares more is."""
    common = list(range(1, 9))
    diffs = [(i, common + [100 * i + k for k in range(12)]) for i in range(1, 41)]
    diffs += [(50, common + [9000 + k for k in range(12)]), (51, common + [9000 + k for k in range(11)] + [9999])]
    assert {(r["a"], r["b"]) for r in _around(spark, diffs).collect()} == {(bytes([50]), bytes([51]))}


@pytest.mark.parametrize("seed", range(3))
def test_no_pair_of_differences_is_missed(spark, seed):
    r, n = random.Random(seed), 40  # no set is linked with the pivot
    bases = [r.sample(range(30), 14) for _ in range(6)]
    diffs = [(i, set(r.sample(r.choice(bases), r.randrange(9, 15))) | {1000 * i + k for k in range(r.randrange(2, 5))}) for i in range(1, 60)]
    got = {(x["a"], x["b"]) for x in _around(spark, diffs, n).collect()}
    for i, x in diffs:
        for j, y in diffs:
            if i < j and 360 * len(x & y) >= 180 * (len(x) + len(y)) - 20 * 2 * n and x & y:
                assert (bytes([i]), bytes([j])) in got
