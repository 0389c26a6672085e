"""Benchmark decontamination by greedy string tiling.

Documents and test items are words (case-folded, ASCII punctuation separates).  Seeds are the hashes of
MATCH consecutive words; a scan finds documents that share seeds with an item (the benchmark travels in
blocks of bounded size, one scan a block).  Where the shared seeds could cover enough of the item, tiles
are set: the longest unmarked common run is marked in both, again and again, down to MATCH words, runs
being found from rolling-hash seeds and their diagonals.  The share of the item's words under tiles is
its coverage, so passages that were cut up and reordered count as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import plain_docs

_U = np.uint64
MATCH = 5  # shortest tile in words; items with fewer words are matched whole
COVERAGE = 0.5
BLOCK_WORDS = 1 << 20  # words of the benchmark that travel with one scan
_FILTER = 22  # bits of the seed prefilter


def _hashes(texts: list[str]) -> list[np.ndarray]:
    buf, rows = T.texts(pa.array(texts, pa.string()))
    s, e, first = T.words(buf, rows, T.PUNCT)
    h = T.hashes(T.lower(buf), s, e)
    return [h[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]


def _gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive entries."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(m, _U(n))
    for j in range(n):
        g = (g + h[j: j + m]) * _U(0xD6E8FEB86659FD93)
        g ^= g >> _U(32)
    return T.mix(g)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length), longest first, ties to the left."""
    gd, gi = _gram(doc, least), _gram(item, least)
    order = np.argsort(gi, kind="stable")
    lo, hi = np.searchsorted(gi[order], gd, "left"), np.searchsorted(gi[order], gd, "right")
    n = hi - lo
    p = np.repeat(np.arange(len(gd)), n)
    t = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    if not len(p):
        return []
    by = np.lexsort((p, t - p))  # along diagonals
    p, t = p[by], t[by]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (t[1:] != t[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(p))) + least - 1
    runs = {}
    for a, b, k in zip(p[at].tolist(), t[at].tolist(), size.tolist(), strict=True):
        runs.setdefault(k, []).append((a, b))
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    k = max(runs)
    while k >= least:
        for a, b in sorted(runs.pop(k, ())):
            free = ~(in_doc[a: a + k] | in_item[b: b + k])
            if free.all():
                in_doc[a: a + k] = in_item[b: b + k] = True
                out.append((a, b, k))
            else:  # what is still unmarked waits for its own length
                step = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
                for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
                    if j - i >= least:
                        runs.setdefault(j - i, []).append((a + i, b + i))
        if in_item.all():
            break
        k -= 1
    return out


def _scan(items: list[tuple[int, str]], match: int, coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_tokens", pa.int64()), ("covered_tokens", pa.int64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())])

    def run(batches):
        words = _hashes([t for _, t in items])
        seeds = {}
        for n in sorted({min(match, len(w)) for w in words if len(w)}):
            own = [k for k, w in enumerate(words) if min(match, len(w)) == n]
            g = [_gram(words[k], n) for k in own]
            key, who = np.concatenate(g), np.repeat(own, [len(x) for x in g])
            at = np.concatenate([np.arange(len(x)) for x in g])
            order = np.argsort(key, kind="stable")
            table = np.zeros(1 << _FILTER, bool)
            table[(key >> _U(64 - _FILTER)).astype(np.int64)] = True
            seeds[n] = key[order], who[order], at[order], table
        for b in T.slices(batches):
            buf, rows = T.texts(b.column(b.schema.get_field_index("text")))
            s, e, first = T.words(buf, rows, T.PUNCT)
            h = T.hashes(T.lower(buf), s, e)
            ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            out, under = [], {}
            for n, (key, who, at, table) in seeds.items():
                g, row = T.grams(h, first, n)
                hit = np.flatnonzero(table[(g >> _U(64 - _FILTER)).astype(np.int64)])
                lo, hi = np.searchsorted(key, g[hit], "left"), np.searchsorted(key, g[hit], "right")
                for r, i, j in zip(row[hit].tolist(), lo.tolist(), hi.tolist(), strict=True):
                    for k in range(i, j):
                        w = int(who[k])
                        under.setdefault((r, w), np.zeros(len(words[w]), bool))[at[k]: at[k] + n] = True
            for (r, w), c in under.items():
                need = coverage * len(words[w])
                if c.sum() >= need:
                    found = tiles(h[first[r]: first[r + 1]], words[w], min(match, len(words[w])))
                    got = sum(t[2] for t in found)
                    if got >= need:
                        out.append((ids[r], items[w][0], len(words[w]), got, len(found), max(t[2] for t in found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, item_tokens, covered_tokens, n_tiles, longest_tile, coverage`` for the pairs whose
    coverage reaches the threshold.

    Null and empty texts, of documents or items, match nothing; repeated rows give repeated pairs (equal
    items once).  Other columns are ignored; an empty table gives an empty result.
    """
    fold = F.lower(F.upper("text"))  # so that capitals and sharp s agree in every script
    src = plain_docs(docs).withColumn("text", fold)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).withColumn("text", fold).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(total) // (4 * BLOCK_WORDS)
    schema = "doc_id long, item_id long, item_tokens long, covered_tokens long, n_tiles long, longest_tile long"
    out = None
    for k in range(blocks):
        part = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]  # about BLOCK_WORDS
        one = src.mapInArrow(_scan(sorted(part), match, coverage), schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("coverage", F.round(F.col("covered_tokens") / F.col("item_tokens"), 6))
