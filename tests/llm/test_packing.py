"""Packing: exact cover, the tokenizer's ids, little padding, and the linear program's parts."""

import random
import zlib

import numpy as np
import pytest

from chronoweave.llm import packing

from .util import clashing, docs, prose

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


def check(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 1024
    for i, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at: at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    return len(by_seq), sum(n for s in by_seq.values() for _, n in s)


def test_pieces(spark):
    r = random.Random(2)
    texts = [(i, prose(r, r.choice([1, 40, 150, 400, 2500]))) for i in range(120)] + [(900, ""), (901, None), (902, "<|endoftext|> 日本語 ünïcode   \n\n x"), (903, "é" * 5000), (904, " " * 3000)]
    sequences, tokens = check(packing.pack(docs(spark, texts), VOCABULARY).collect(), texts)
    assert 1024 * sequences - tokens <= 0.02 * tokens + 1024


def test_edges(spark):
    assert packing.pack(docs(spark, [(1, "x")]).limit(0), VOCABULARY).count() == 0
    got = packing.pack(clashing(docs(spark, [(1, "same"), (1, "same"), (None, None)])), VOCABULARY).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3


def test_pricing():
    r = np.random.default_rng(1)
    for _ in range(100):
        cap = int(r.integers(5, 40))
        s = np.unique(r.integers(1, cap + 1, 6))
        w = r.random(len(s))
        value, counts = packing.best_pattern(s, w, cap)
        best = np.zeros(cap + 1)
        for c in range(1, cap + 1):
            best[c] = max([best[c - 1], *(best[c - x] + y for x, y in zip(s, w, strict=True) if x <= c)])
        assert abs(best[cap] - value) < 1e-9 and abs((counts * w).sum() - value) < 1e-9 and (counts * s).sum() <= cap


def test_column_generation_reaches_the_optimum():
    sizes, counts = np.array([3, 5, 7]), np.array([30.0, 20.0, 40.0])
    use, x = packing.patterns(sizes, counts, 10)
    assert (use.T @ x >= counts - 1e-6).all() and abs(x.sum() - 50) < 1e-6  # 7+3 thirty times, 7 ten times, 5+5 ten times
