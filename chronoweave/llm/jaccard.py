"""Exact similarity join on word shingles with token-combination prefixes.

Signatures.  Shingles are ordered globally, rare before frequent, by classes of how many sets have them.
A set may miss at most ``n - ceil(t n)`` of its shingles in any partner, so two partners that end their
prefixes after more "evidence" than that share a signature.  A rare shingle is one signature and counts
one.  Each frequent class is split into cells by hash, and combinations of k shingles of one cell are
signatures: k is 2 for shingles of FREQUENT sets, 3 for those of FREQUENT squared, and so on to
MOST_TOGETHER.  A cell with m shingles of the prefix counts ``m - k + 1``, as fewer than k shared ones can
go unseen, and prefixes are extended until the evidence suffices.  Cells per set scale with its length,
so combinations stay linear in it; a length band and the next name the cells, as partners differ by 1/t.

Before that, sets that cannot have any partner are dropped: a third of the hash space is counted, and a
set with more unshared shingles there than it may miss has none.  Equal sets are one class throughout.

Verification.
1. Each set is verified against the pivot, the least set of a signature, that it shares most signatures
   with; links form components.
2. Where a signature still joins several components and has at most TOGETHER sets, those are paired.
3. Larger groups are never paired: their prefixes are extended until what meets is small.  Their sets are
   written as differences from the pivot (one intersection each, which also finds direct links).  What all have in common is gone from them,
   so prefixes of the differences, those that lead to the fewest pairs first, are short and selective: two sets
   x, y of which y is not linked with the pivot r share more than ``(|x ^ r| + k (|r| - |x|)) / 2`` differences,
   with ``k = (1 - t) / (1 + t)``, or they are no link.  Sets of different components that share a prefix
   difference, with enough of both differences after it, are verified by exact intersection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import Stage, join_checked, partitions, plain_docs, restrict
from .components import components

_U = np.uint64
SAMPLE = 0.35  # share of the hash space that the first count covers; above 1 - threshold
FREQUENT = 32  # sets that make a shingle frequent; each further power of it raises k by one
MOST_TOGETHER = 4  # shingles in a combination, at most
KEY_BITS = 40  # counts are kept by this many leading bits of a hash; clashes only weaken the filter
TOGETHER = 16  # sets of one signature that are paired; more of them are told apart by their differences
SMALL = 128  # sets of this size and less use one class and pairs, as their cells hold too little

_SCAN_ARROW = pa.schema([
    ("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), ("sig2", pa.int64()),
    ("seen", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("toks", pa.binary())])
_SCAN = "kind int, id long, n int, sig long, sig2 long, seen int, bucket int, blob binary, toks binary"
_COUNT_ARROW = pa.schema([("sig", pa.int64()), ("shared", pa.int32()), ("often", pa.binary())])
_COUNT = "sig long, shared int, often binary"


def _distinct(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order within each row, their rows, and the count of each row."""
    buf, rows = T.texts(batch.column(batch.schema.get_field_index("text")))
    s, e, first = T.words(buf, rows)
    h = T.hashes(T.lower(buf), s, e)
    g, row = T.grams(h, first, words, short=True)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[keep], row[keep]
    return g, row, np.bincount(row, minlength=batch.num_rows).astype(np.int64)


def _pack(keys: list[np.ndarray], refs: list[np.ndarray], ids: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """Postings by bucket: the sets present, then (local set, rest of the key) for each posting."""
    k, r, ids = np.concatenate(keys), np.concatenate(refs), np.concatenate(ids)
    bucket = (k >> _U(KEY_BITS - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rest = (k[order] & _U((1 << (KEY_BITS - bits)) - 1)).astype(np.uint32)
    bucket, r = bucket[order], r[order]
    for a, z in T.runs(bucket):
        used, local = np.unique(r[a:z], return_inverse=True)
        local = local.astype(np.uint32 if len(used) >> 16 else np.uint16)
        head = np.array([len(used), z - a], np.int64).tobytes()
        yield int(bucket[a]), head + ids[used].tobytes() + local.tobytes() + rest[a:z].tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    u, m = np.frombuffer(blob, np.int64, 2)
    ids = np.frombuffer(blob, np.int64, u, 16)
    wide = np.uint32 if u >> 16 else np.uint16
    at = 16 + 8 * u
    local = np.frombuffer(blob, wide, m, at)
    return np.frombuffer(blob, np.uint32, m, at + m * wide().itemsize), ids[local]


def _rows(count: int, **cols) -> pa.RecordBatch:
    arrays = [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(count, f.type) for f in _SCAN_ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCAN_ARROW)


def _scan(words: int, bits: int, share: float, tokens: bool):
    """Per row its set's size, 128-bit signature and count of keys (kind 0); postings of the counted
    shingles (kind 1).  With ``tokens`` the rows also hold the sorted set."""
    limit = _U(min(int(share * 2**64), 2**64 - 1))

    def run(batches):
        keys, refs, ids, held, docs = [], [], [], 0, 0

        def flush():
            parts = list(_pack(keys, refs, ids, bits)) if held else []
            for i in range(0, len(parts), 64):
                p = parts[i: i + 64]
                yield _rows(len(p), kind=[1] * len(p), bucket=[x[0] for x in p], blob=[x[1] for x in p])

        for b in T.slices(batches):
            g, row, n = _distinct(b, words)
            at = np.concatenate([[0], np.cumsum(n)])
            sig = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                sums = np.zeros(len(g) + 1, np.uint64)
                np.cumsum(T.mix(T.mix(g ^ _U(salt)) + _U(salt)), out=sums[1:])
                sig.append(T.mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)).astype(np.int64))
            own = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
            key = g >> _U(64 - KEY_BITS)
            pick = g <= limit
            new = pick.copy()  # shingles of one set that clash in their keys count as one that may be shared
            new[1:] &= (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            seen = np.bincount(row[new], minlength=len(n)).astype(np.int32)
            cols = {"kind": np.zeros(len(n), np.int32), "id": own, "n": n.astype(np.int32), "sig": sig[0], "sig2": sig[1], "seen": seen}
            if tokens:
                raw = g.tobytes()
                cols["toks"] = [raw[8 * i: 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield _rows(len(n), **cols)
            keys.append(key[new])
            refs.append(row[new] + docs)
            ids.append(sig[0])
            held, docs = held + int(new.sum()), docs + len(n)
            if held > 750_000:
                yield from flush()
                keys, refs, ids, held, docs = [], [], [], 0, 0
        yield from flush()

    return run


def _count(bits: int, classes: bool):
    """For a bucket: per set the number of its keys that another set has too and, with ``classes``, its
    frequent keys, each with its class above the key's bits."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        parts = [_unpack(x.as_py()) for x in table["blob"]]
        rest, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, rest))
        rest, ids = rest[order], ids[order]
        keep = np.ones(len(rest), bool)
        keep[1:] = (rest[1:] != rest[:-1]) | (ids[1:] != ids[:-1])
        rest, ids = rest[keep], ids[keep]
        at = T.starts_of(rest)
        size = np.diff(np.append(at, len(rest)))
        size = np.repeat(size, size)
        rest, ids, size = rest[size > 1], ids[size > 1], size[size > 1]
        order = np.argsort(ids, kind="stable")
        rest, ids, size = rest[order], ids[order], size[order]
        edge = np.append(T.starts_of(ids), len(ids))
        often = [b""] * (len(edge) - 1)
        if classes:
            level = np.zeros(len(size), np.int64)
            for k in range(1, MOST_TOGETHER):
                level += size >= FREQUENT**k
            word = rest.astype(np.int64) | (bucket << (KEY_BITS - bits)) | (level << KEY_BITS)
            often = [w[w >> KEY_BITS > 0].tobytes() for w in np.split(word, edge[1:-1])] if len(word) else often
        return pa.table([pa.array(ids[edge[:-1]]), pa.array(np.diff(edge).astype(np.int32)), pa.array(often, pa.binary())], schema=_COUNT_ARROW)

    return run


@cache
def _choose(m: int, k: int) -> np.ndarray:
    """All ways to take k of m, in order."""
    return np.array(list(combinations(range(m), k)), np.int64).reshape(-1, k)


def _combined(toks: np.ndarray, cell: np.ndarray, k: int, salt: int) -> Iterator[np.ndarray]:
    """Hashes of the k-shingle combinations of each cell; ``toks`` in one order in every set."""
    order = np.argsort(cell, kind="stable")
    toks = toks[order]
    at = T.starts_of(cell[order])
    size = np.diff(np.append(at, len(toks)))
    for m in np.unique(size).tolist():
        if m >= k:
            block = toks[at[size == m][:, None] + np.arange(m)]
            h = np.full((len(block), len(_choose(m, k))), _U(salt))
            for j in range(k):
                h = T.mix(h * _U(3) + block[:, _choose(m, k)[:, j]])
            yield h.ravel()


def _signatures(num: int, den: int):
    """Rows (s, id, n, shared) of the sets' signatures; see the module's text."""
    band = math.log(den / num)
    schema = pa.schema([("s", pa.int64()), ("id", pa.binary()), ("n", pa.int32()), ("shared", pa.int32())])

    def of(g: np.ndarray, often: np.ndarray) -> np.ndarray:
        n = len(g)
        need = n - (num * n + den - 1) // den + 1
        level = np.zeros(n, np.int64)
        if len(often):
            order = np.argsort(often & ((1 << KEY_BITS) - 1))
            keys, levels = (often & ((1 << KEY_BITS) - 1))[order], (often >> KEY_BITS)[order]
            own = (g >> _U(64 - KEY_BITS)).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            level = np.where(keys[at] == own, levels[at], 0)
        rare = g[level == 0]
        out = [rare[:need]]
        if len(rare) < need and n > 1:
            j = int(math.log(n) / band + 1e-9)
            order = np.argsort(level, kind="stable")[len(rare):]
            toks, kinds = g[order], level[order]
            for b in (j, j + 1):
                width = math.exp(band * b)
                k_of = np.ones_like(kinds) if width < SMALL else kinds  # k - 1
                cells = np.maximum(1, (width / (8 * np.arange(1, MOST_TOGETHER + 1))).astype(np.int64))
                cell = (T.mix(toks) % cells[k_of - 1].astype(np.uint64)).astype(np.int64) * MOST_TOGETHER + k_of - 1
                # the first k - 1 of a cell add no evidence
                by = np.argsort(cell, kind="stable")
                first = T.starts_of(cell[by])
                place = np.empty(len(cell), np.int64)
                place[by] = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
                m = int(np.searchsorted(np.cumsum(place >= k_of), need - len(rare), "left")) + 1
                for k in np.unique(k_of[:m]).tolist():
                    mine = np.flatnonzero(k_of[:m] == k)
                    out.extend(_combined(toks[mine], cell[mine], k + 1, 8 * (b + 1) + k))
        return np.unique(np.concatenate(out))

    def run(batches):
        for b in T.released(batches):
            ids, shared = b.column("id"), b.column("shared").to_numpy()
            got, size, ns = [], [], []
            for i, (t, o) in enumerate(zip(b.column("toks"), b.column("often"), strict=True)):
                g = np.frombuffer(t.as_buffer(), np.uint64)
                got.append(of(g, np.frombuffer(b"".join(o.as_py()), np.int64)))
                size.append(len(got[-1]))
                ns.append(len(g))
                if sum(size) > 500_000 or i == len(ids) - 1:
                    lo = i + 1 - len(size)
                    at = np.repeat(np.arange(lo, i + 1), size)
                    cols = [pa.array(np.concatenate(got).astype(np.int64)), ids.take(pa.array(at)), pa.array(np.array(ns, np.int32)[at - lo]), pa.array(shared[at].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
                    got, size, ns = [], [], []

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sets, ta and tb."""
    b = sets.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
    a = sets.select(F.col("id").alias("a"), F.col("toks").alias("ta"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact intersection of the whole sets."""

    def run(batches):
        for t in T.released(batches):
            keep = []
            for x, y in zip(t.column("ta"), t.column("tb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                fits = min(len(x), len(y)) * den >= num * max(len(x), len(y))
                same = both - len(np.unique(np.concatenate([x, y]))) if fits else 0
                keep.append(same > 0 and same * den >= num * (both - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    return _with_sets(pairs, sets).mapInArrow(run, "a binary, b binary")


def _differences(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """For each (pivot a, set b): whether they link, the sizes of b and of the difference, how many of its
    entries, first in any order, suffice against any set (``short``) or against linked ones (``long``), and the
    entries."""

    def run(batches):
        for t in T.released(batches):
            out = []
            for x, y in zip(t.column("ta"), t.column("tb"), strict=True):
                r, s = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                d = np.setxor1d(r, s, assume_unique=True)
                m, n = len(d), len(s)
                same = (len(r) + n - m) // 2
                link = same > 0 and same * den >= num * (len(r) + n - same)
                half = -((-(m * (den + num) + (den - num) * (len(r) - n))) // (2 * (den + num)))  # rounded up
                far = m - n * (den - num) // num
                out.append((link, n, m, m - max(1, half, far) + 1, m - max(1, far) + 1, d.tobytes()))
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            cols = [t.column("a"), t.column("b")] + [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["r", "id", "link", "n", "m", "short", "long", "diff"])

    return _with_sets(pairs, sets).mapInArrow(run, "r binary, id binary, link boolean, n int, m int, short int, long int, diff binary")


def _entries(batches):
    """A row for each entry of a difference."""
    for b in T.released(batches):
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            at = part.schema.get_field_index("diff")
            size = np.array([len(x.as_buffer()) // 8 for x in part.column(at)])
            row = np.repeat(np.arange(part.num_rows), size)
            entry = np.frombuffer(b"".join(x.as_py() for x in part.column(at)), np.int64)
            cols = [part.column(i).take(pa.array(row)) for i in range(part.num_columns) if i != at]
            names = [f.name for f in part.schema if f.name != "diff"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(entry)], names=[*names, "entry"])


def _across(diffs: DataFrame, hubs: DataFrame, placed, st: Stage, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets that share a prefix entry of their differences from a pivot: one in the
    pivot's component and one not, or both in none; components as before ``placed`` names them anew."""
    of = hubs.select(F.col("hub").alias("r"), F.col("c").alias("of"))
    rows = placed(diffs.withColumnRenamed("c", "was").join(of, "r", "left"))
    rows = rows.withColumn("role", F.when(F.col("was") == F.col("of"), 0).when(F.col("was") == F.col("id"), 1).otherwise(2))
    # beyond the largest difference of the component, the whole of what may differ is exceeded
    most = rows.groupBy("r").agg(F.coalesce(F.max(F.when(F.col("role") == 0, F.col("m"))), F.lit(0)).alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    rows = rows.join(most.where("lo <> hi"), "r").withColumn("near", F.expr(f"m - most <= n * {den - num} / {num}"))
    rows = rows.where("role = 0 OR role = 1 OR near")
    cols = ["r", "id", F.col("n").cast("long"), F.col("m").cast("long"), "short", "long", "c", "role", "near"]
    kinds = "r binary, id binary, n long, m long, short int, long int, c binary, role int, near boolean"
    around = st.put(rows.select(*cols, "diff"), "around")
    rows = around.mapInArrow(_entries, f"{kinds}, entry long")
    # a difference's entries that lead to no pair come first, then those that lead to the fewest
    weigh = F.expr("sum(int(role = 0)) * sum(int(role > 0 AND near)) + sum(int(role = 1)) * (sum(int(role = 1)) - 1)").alias("pairs")
    weights = rows.groupBy("r", "entry").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), weigh).where("lo <> hi AND pairs > 0")
    own = Window.partitionBy("r", "id")
    rows = rows.join(weights.select("r", "entry", "pairs"), ["r", "entry"])
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("pairs", "entry")) - F.count("*").over(own) + F.col("m"))
    # as x, as y to any, as y to sets of no component
    rows = rows.withColumn("px", F.expr("rank <= short")).withColumn("py", F.expr("role > 0 AND near AND rank <= long")).withColumn("pz", F.expr("role = 1 AND rank <= short"))
    rows = st.put(rows.where("px OR py OR pz").drop("short", "long", "near"), "entries")
    # entries of the same sets lead to the same pairs: the first of them is joined
    flags = ("id", "px", "py", "pz")
    same = rows.groupBy("r", "entry").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(F.xxhash64(*flags)).alias("h1"), F.bit_xor(F.xxhash64(*flags, F.lit(7))).alias("h2"), F.count("*").alias("sets"),
        F.expr("bool_or(px) AND bool_or(py OR pz)").alias("both"), F.first("pairs").alias("pairs"))
    one = same.where("lo <> hi AND both").groupBy("r", "h1", "h2", "sets").agg(F.min_by("entry", F.struct("pairs", "entry")).alias("entry")).select("r", "entry")
    rows = st.put(rows.join(one, ["r", "entry"]), "kept")
    x = rows.where("px").alias("x")
    y = rows.where("py OR pz").alias("y")
    # where two differences meet first, what follows must do for a link
    rest = f"{2 * (den + num)} * (1 + least(x.m - x.rank, y.m - y.rank)) >= {den + num} * (x.m + y.m) - {den - num} * (x.n + y.n)"
    fits = f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) AND {den + num} * abs(x.m - y.m) <= {den - num} * (x.n + y.n) AND {rest}"
    roles = "(x.role = 0 AND y.py OR x.role = 1 AND y.pz AND x.id < y.id)"
    pairs = x.join(y, ["r", "entry"]).where(f"x.c <> y.c AND {roles} AND {fits}")
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _links(sig: DataFrame, sets: DataFrame, st: Stage, num: int, den: int) -> DataFrame | None:
    """``(node, component)`` of the sets that are linked, or None if none are."""
    links, comp = None, None

    def add(found: DataFrame, name: str):
        nonlocal links, comp
        found = st.put(found, name)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            if comp is None:
                comp = components(found, st, f"cc-{name}")
                return
            # only the components so far are merged
            of = [comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
            merged = found.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            new = components(merged, st, f"cc-{name}").withColumnRenamed("component", "now")
            both = comp.withColumnRenamed("node", "of").join(new, comp.component == new.node, "left").select(F.col("of").alias("node"), F.coalesce("now", "component").alias("component"))
            alone = new.join(comp.select("node"), "node", "left_anti").select("node", F.col("now").alias("component"))
            comp = st.put(both.unionByName(alone), f"comp-{name}")

    def placed(df: DataFrame) -> DataFrame:
        if comp is None:
            return df.withColumn("c", F.col("id"))
        return df.join(comp, df.id == comp.node, "left").select(*[df[c] for c in df.columns], F.coalesce("component", "id").alias("c"))

    # 1. each set with the pivot of most of its signatures
    star = F.min(F.struct("id", "n", "shared"))
    stars = sig.groupBy("s").agg(star.alias("y"), F.count("*").alias("sets")).where("sets > 1").select("s", "y")
    fits = f"{num + den} * least(x.shared, y.shared) >= {num} * (x.n + y.n) AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)"
    met = sig.alias("x").join(stars, "s").where(f"x.id <> y.id AND {fits}").groupBy("x.id", F.col("y.id").alias("sid")).count()
    met = met.groupBy("id").agg(F.max_by("sid", F.struct("count", "sid")).alias("sid"))
    add(_verify(met.select(F.col("sid").alias("a"), F.col("id").alias("b")), sets, num, den), "stars")

    # 2. signatures of several components, those with the same sets once
    at = st.put(placed(sig), "placed")
    groups = at.groupBy("s").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct("c", "id")).alias("pivot"), F.count("*").alias("sets"),
        F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("h2")).where("lo <> hi")
    groups = groups.groupBy("h1", "h2", "sets").agg(F.min_by(F.struct("s", "pivot.id"), "s").alias("g"))
    groups = st.put(groups.select("g.s", F.col("g.id").alias("r"), "sets"), "groups")
    few = at.join(groups.where(F.col("sets") <= TOGETHER).select("s"), "s").groupBy("s").agg(F.collect_list(F.struct("id", "c", "n", "shared")).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.expr(f"slice(all, i + 2, {TOGETHER})")).alias("y"))
    few = few.where(f"x.c <> y.c AND {fits}").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    near = st.put(_verify(st.put(few, "few"), sets, num, den), "near")

    # 3. larger ones by differences from their pivots, the hubs of components
    # the components of a signature, and all of their sets: a row a component, however many of its sets have it
    seen = at.where("c = id").select("s", "c").unionByName(at.where("c <> id").select("s", "c").distinct())
    many = st.put(seen.join(groups.where(F.col("sets") > TOGETHER).select("s"), "s").distinct(), "many")
    nodes = many.select("c").distinct()
    if comp is None:
        nodes = nodes.withColumn("id", F.col("c"))
    else:
        nodes = nodes.join(comp, F.col("c") == F.col("component"), "left").select(F.coalesce("node", "c").alias("id"), "c")
    nodes = st.put(nodes, "nodes")
    if links is None:
        hubs = nodes.select("c", F.col("id").alias("hub"), F.lit(0).cast("long").alias("size")).limit(0)
    else:
        degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").count()
        hubs = degree.join(comp, "node").groupBy(F.col("component").alias("c")).agg(F.max(F.struct("count", "node")).alias("h"), F.count("*").alias("size"))
        hubs = hubs.select("c", F.col("h.node").alias("hub"), "size")
    hubs = st.put(hubs, "hubs")
    met = many.join(hubs, "c", "left")  # a set of no component is its own hub
    met = met.select("s", "c", F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("hub", "c").alias("hub")).alias("h"))
    met = st.put(met, "met")
    # of two components the smaller one's sets meet the larger one's hub; sets of no component meet the largest hub
    other = met.where("h.size > 1").select("s", F.col("c").alias("of"), F.col("h").alias("g"))
    to = met.join(other, "s").where("g > h").select(F.col("g.hub").alias("r"), "of", "c").distinct()
    own = met.where("h.size > 1").select(F.col("h.hub").alias("r"), F.col("c").alias("of"), "c").distinct()
    alone = met.where("h.size = 1").select("s", "c").join(met.groupBy("s").agg(F.max("h").alias("h")), "s")
    alone = alone.select(F.col("h.hub").alias("r"), F.col("c").alias("of"), F.col("c").alias("id")).distinct()
    wide = st.put(to.unionByName(own), "wide").join(nodes, "c").select("r", "of", "id")
    pairs = wide.unionByName(alone).where("id <> r").select(F.col("r").alias("a"), F.col("id").alias("b")).distinct()
    diffs = st.put(_differences(pairs, sets, num, den), "diffs")
    add(diffs.where("link").select(F.col("r").alias("a"), F.col("id").alias("b")).unionByName(near), "pivots")
    add(_verify(st.put(_across(diffs.join(nodes, "id"), hubs, placed, st, num, den), "across"), sets, num, den), "rest")
    return comp


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` under links of Jaccard >= num/den.

    Null and empty texts have no shingles and link with nothing; a text with fewer than ``words`` words
    is one shingle.  Rows that repeat a doc_id are judged row by row, each by its own text: equal ones are
    one class, unlike ones may end in different components.  Rows without a doc_id are in the class of the
    rows with an equal set and link through those only (null if there are none).  Other columns are ignored, so clashing
    names do no harm; an empty table gives an empty result.  ``1 - num/den`` must be below the counted
    share of the hash space.
    """
    spark = docs.sparkSession
    st = Stage(spark, "jaccard")
    bits = max(8, (4 * partitions(spark) - 1).bit_length())
    src = plain_docs(docs)
    scan = st.put(src.mapInArrow(_scan(words, bits, SAMPLE, False), _SCAN).drop("toks"), "scan", "kind")
    meta = scan.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "sig", "sig2", "seen")
    blobs = scan.where("kind = 1").select("bucket", "blob")
    shared = blobs.groupBy("bucket").applyInArrow(_count(bits, False), _COUNT).groupBy("sig").agg(F.sum("shared").alias("shared"))
    classes = meta.where("n > 0").groupBy("sig", "sig2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("seen").alias("seen"), F.count("*").alias("rows"))
    classes = st.put(classes, "classes")  # apart from the count, a large class can be split in joins
    may = classes.join(shared, "sig", "left")
    may = may.where(F.lit(den) * (F.col("n") - F.col("seen") + F.coalesce("shared", F.lit(0))) >= F.lit(num) * F.col("n"))
    may = st.put(may.where("n > 1 AND doc_id IS NOT NULL").select("doc_id", "sig", "sig2"), "may")
    named = st.put(may.select("doc_id").distinct(), "named")
    full = st.put(restrict(src, named, "doc_id", 16).mapInArrow(_scan(words, bits, 1.0, True), _SCAN), "full", "kind")
    counts = full.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(_count(bits, True), _COUNT)
    counts = counts.groupBy("sig").agg(F.sum("shared").cast("int").alias("shared"), F.collect_list("often").alias("often"))
    # an id is the class's smallest doc_id and its signature, so that a class of a lower doc_id comes first
    name = F.unhex(F.concat(F.lpad(F.hex("doc_id"), 16, "0"), F.lpad(F.hex("sig"), 16, "0")))
    sets = may.join(counts, "sig").join(full.where("kind = 0").select("sig", "sig2", "n", "seen", "toks"), ["sig", "sig2"])
    sets = sets.withColumn("shared", F.col("shared") + F.col("n") - F.col("seen"))
    sets = sets.where(F.lit(den) * F.col("shared") >= F.lit(num) * F.col("n")).dropDuplicates(["sig", "sig2"])
    sets = st.put(sets.select(name.alias("id"), "n", "shared", "often", "toks"), "sets")
    st.drop("full")
    sig = st.put(sets.mapInArrow(_signatures(num, den), "s long, id binary, n int, shared int"), "sig")
    comp = _links(sig, sets, st, num, den)
    st.drop("sig", "sets", "placed", "groups", "few", "many", "met", "wide", "diffs", "around", "entries", "kept", "across")

    own = classes.withColumn("node", name)
    if comp is None:
        own = own.select("sig", "sig2", F.col("doc_id").alias("least"), "rows")
    else:
        own = own.join(comp, "node", "left")
        least = own.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
        own = own.join(least, "component", "left").select(
            "sig", "sig2", F.coalesce("least", "doc_id").alias("least"), F.when(F.col("component").isNull(), F.col("rows")).otherwise(2).alias("rows"))
    own = st.put(own.where("rows > 1").select("sig", "sig2", "least"), "own")  # other documents are their own component
    out = join_checked(meta.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig", "sig2"), own, ["sig", "sig2"], "left", 32)
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
