"""Suffix dedup against a scan of all 50-byte strings, and the merge against sorting."""

import hashlib
import random

import numpy as np
import pytest

from chronoweave.llm import suffix_dedup as S

from .util import clashing, docs


def brute(pairs):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        b = (t or "").encode()
        gone, own = np.zeros(len(b) + 1, bool), []
        for j in range(len(b) - 49):
            own.append(b[j: j + 50])
            if own[-1] in seen:
                gone[j: j + 50] = True
        seen.update(own)
        g = gone[:-1]
        out[i] = len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(r.randrange(8, 40))) for _ in range(5)]
    texts = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(r.randrange(0, 30)))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            i = r.randrange(0, len(p) // 3)
            parts += [p[i: len(p) - r.randrange(0, len(p) // 3)], word()]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[3], "", None, "short", "short", "a" * 300, "a" * 120, "ab" * 200, texts[5] + texts[6]]
    r.shuffle(texts)
    return list(enumerate(texts))


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 500)
    pairs = corpus(seed)
    df = S.suffix_dedup(docs(spark, pairs))
    assert result(df) == brute(pairs)
    for r in df.where("kept IS NOT NULL").collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_edges(spark):
    assert S.suffix_dedup(docs(spark, [(1, "x")]).limit(0)).count() == 0
    t = "the same text of more than fifty bytes, word for word, again"
    rows = [(2, t), (2, t), (None, t), (5, t + "!"), (6, None)]
    got = sorted(((r["doc_id"] or -1, r["n_removed"]) for r in S.suffix_dedup(clashing(docs(spark, rows))).collect()))
    assert got == [(-1, 0), (2, 0), (2, 0), (5, len(t)), (6, 0)]


def test_long_text(spark):
    r = random.Random(4)
    a = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    pairs = [(1, a), (2, "zz" + a[1000:399_000] + "yy")]
    assert result(S.suffix_dedup(docs(spark, pairs)))[2][1] == 398_000


def transforms(r, width=40):
    """Random windows that share much, the suffixes of two shards of them in order, and the shards' transforms."""
    n = int(r.integers(4, 40))
    base = r.integers(97, 99, 100).astype(np.uint8)
    rows = np.full((n, width), S.STOP, np.uint8)
    for i in range(n):
        size, o = int(r.integers(9, width)), int(r.integers(0, 60))
        rows[i, :size] = base[o: o + size]
    places, shards = [], []
    for a, z in ((0, n // 2), (n // 2, n)):
        part = np.arange(a, z)[np.argsort(np.ascontiguousarray(rows[a:z]).view(f"S{width}").ravel(), kind="stable")]
        at, before = S.shard_bwt(rows[part])
        places.append(part[at // width] * width + at % width)
        shards.append(before)
        col = at % width
        assert (before[col > 0] == rows[part].ravel()[at[col > 0] - 1]).all()
    return rows, np.concatenate(places), shards


def test_merge_orders_and_prefixes():
    r = np.random.default_rng(0)
    for _ in range(40):
        rows, places, shards = transforms(r)
        rank, common = S.merge_bwt(shards, 20)
        w = rows.shape[1]
        text = [rows[p // w, p % w:].tobytes()[:20].ljust(20, b"\xff") for p in places]
        want = sorted(text)
        for t, k in zip(text, rank, strict=True):
            assert want.index(t) == k
        for i in range(1, len(want)):
            assert common[i] == next((j for j in range(20) if want[i][j] != want[i - 1][j]), 20)


def test_the_merge_reads_the_transforms():
    """Two symbols of a transform exchanged, or a shard's order, change what comes out."""
    r, changed = np.random.default_rng(1), 0
    for _ in range(10):
        _, _, shards = transforms(r)
        rank, common = S.merge_bwt(shards, 20)
        a, b = (int(np.flatnonzero(shards[0] == c)[0]) for c in (97, 98))
        shards[0] = shards[0].copy()
        shards[0][[a, b]] = shards[0][[b, a]]
        other = S.merge_bwt(shards, 20)
        changed += not (np.array_equal(rank, other[0]) and np.array_equal(common, other[1]))
    assert changed == 10


def test_unlike_texts_of_one_document(spark):
    a, b = "first text of far more than fifty bytes, all of its own words", "second text, also of more than fifty bytes, again with its own"
    rows = [(1, a), (2, b), (2, "x" + a), (3, b), (3, "quite another text that nobody else has, of fifty bytes or more")]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in S.suffix_dedup(docs(spark, rows)).collect())
    assert got == sorted([(1, len(a), 0), (2, len(b), 0), (2, len(a) + 1, len(a)), (3, len(b), len(b)), (3, len(rows[4][1]), 0)])


@pytest.mark.parametrize("limit", [1, 3])
def test_grams_of_many_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "HOT_TEXTS", limit)
    pairs = corpus(5)
    assert result(S.suffix_dedup(docs(spark, pairs))) == brute(pairs)
