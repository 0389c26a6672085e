"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are tokenised once; whole multiples of the capacity are cut off as full sequences, and what
remains (0 < length < capacity) is packed.  The driver sees only the histogram of remainders, at most
``capacity - 1`` numbers.  A linear program over patterns covers the histogram: the simplex basis starts
with one-length patterns, an unbounded-knapsack dynamic program prices new patterns by the duals, and the
loop ends at optimality, within GAP of the material bound, or after MOST_COLUMNS columns.  Pattern counts
are rounded down and the rest, less than one sequence a pattern, is packed by best fit.  Documents may be
cut, so the fullest patterns are kept, the documents of the others are laid end to end, and that stream
fills what the kept ones leave open (gaps under FILL_LEAST stay padding).  Remainders are ranked within
their length by partition offsets (no global sort), and a rank alone gives sequences and offsets.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import Stage, plain_docs, join_checked

CAPACITY = 1024
GAP, MOST_COLUMNS, FILL_LEAST = 1e-3, 400, 8
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, size int, at long, ids binary"


def encoder(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes.

    The byte-level vocabulary in the file gives the merge ranks of a faster encoder with the same ids;
    texts with characters beyond Latin, where character classes could differ, go through the
    ``tokenizers`` library itself.  Names of special tokens in a text are ordinary text."""
    import tiktoken
    from tokenizers import Tokenizer

    held = tiktoken.__dict__.setdefault("_encoders_by_path", {})  # a worker loads a vocabulary once
    if path not in held:
        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(code[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        held[path] = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=ranks, special_tokens={}), slow
    fast, slow = held[path]

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if text.isascii() or ord(max(text)) < 0x250:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where they all fit."""
    x = np.frombuffer(ids, "<u4")
    return x.astype("<u2").tobytes() if x.max() < 1 << 16 else ids


def _wide(ids: bytes, size: int) -> bytes:
    return ids if len(ids) == 4 * size else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _cut(path: str, capacity: int):
    """Pieces of each document, with the piece's rank among those of its length in this partition."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("at", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in T.slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + bytes(4)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    rows.append((doc, start, size, zlib.crc32(ids[4 * start: 4 * (start + size)]), n, part, size, int(seen[size]), None if size == capacity else _narrow(ids[4 * start:])))
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The counts of each size, within the capacity, that are worth most (unbounded knapsack).

    ``sizes`` ascend.  Sizes that a smaller one is worth as much as are left out; 1, 2, 4, ... copies of
    each other are taken or not, one vector step over all capacities each."""
    best, steps = np.zeros(capacity + 1), []
    for k in np.flatnonzero(worth > np.maximum.accumulate(np.concatenate([[0.0], worth[:-1]])) + 1e-12):
        if worth[k] <= best[sizes[k]] + 1e-12:  # smaller ones together are worth as much
            continue
        n = 1
        while n * sizes[k] <= capacity:
            s = n * int(sizes[k])
            new = best[:-s] + n * worth[k]
            better = new > best[s:] + 1e-12
            steps.append((int(k), n, s, better))
            best[s:] = np.where(better, new, best[s:])
            n *= 2
    out, c = np.zeros(len(sizes), np.int64), capacity
    for k, n, s, better in reversed(steps):
        if c >= s and better[c - s]:
            out[k] += n
            c -= s
    return float(best[capacity]), out


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (one a row) and how often the linear program uses each."""
    each = capacity // sizes
    basis = np.diag(each).astype(float)  # columns are patterns
    inverse = np.diag(1.0 / each)
    x = counts / each
    least = float((sizes * counts).sum()) / capacity
    for _ in range(MOST_COLUMNS):
        value = x.sum()
        if value <= least * (1 + GAP):
            break
        dual = inverse.sum(axis=0)
        worth, column = best_pattern(sizes, np.maximum(dual, 0), capacity)
        if worth <= 1 + 1e-9 or value / worth >= value * (1 - GAP):
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        x -= ratio[k] * d
        x[k] = ratio[k]
        np.maximum(x, 0, out=x)
        row = inverse[k] / d[k]
        used = np.flatnonzero(np.abs(d) > 1e-12)
        inverse[used] -= np.outer(d[used], row)
        inverse[k] = row
        basis[:, k] = column
    return basis.T.astype(np.int64), x


def _fit_rest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by falling size of what rounding left; sequences as lists of size indices."""
    bins, room = [], [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a sequence has r free
    for k in np.argsort(-sizes, kind="stable"):
        s = int(sizes[k])
        for _ in range(int(left[k])):
            fits = some >> s
            if fits:
                free = s + (fits & -fits).bit_length() - 1
                b = room[free].pop()
                if not room[free]:
                    some &= ~(1 << free)
            else:
                bins.append([])
                b, free = len(bins) - 1, capacity
            bins[b].append(int(k))
            if free > s:
                room[free - s].append(b)
                some |= 1 << (free - s)
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict, np.ndarray]:
    """Where the ranked remainders of each size go.

    First: by size, (first rank, sequence, offset) of runs of ranks that lie whole in consecutive
    sequences, the first rank of those that are cut, and their place in the stream.  Second: the gaps
    that the stream fills, rows (stream position, gap, first sequence, offset), n sequences each."""
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    groups, left = [], counts.copy()
    if len(sizes):
        use, x = patterns(sizes, counts.astype(float), capacity)
        for p in np.flatnonzero(x >= 1):
            held = np.flatnonzero(use[p])
            n = int(min(x[p] + 1e-9, (left[held] // use[p][held]).min()))
            if n:
                left[held] -= n * use[p][held]
                items = np.repeat(held, use[p][held])
                groups.append((capacity - int(sizes[items].sum()), n, items[np.argsort(-sizes[items], kind="stable")]))
        groups += [(capacity - int(sizes[items].sum()), 1, items) for items in _fit_rest(sizes, left, capacity)]
    groups.sort(key=lambda g: g[0])
    open_, tokens = 0, sum((capacity - g[0]) * g[1] for g in groups)
    kept = 0
    for gap, n, _ in groups:  # as long as the documents of the others can fill every gap
        fill = gap * n if gap >= FILL_LEAST else 0
        if tokens - (capacity - gap) * n < open_ + fill:
            break
        open_, tokens, kept = open_ + fill, tokens - (capacity - gap) * n, kept + 1
    runs, rank, gaps, sequence, stream = [[] for _ in sizes], np.zeros(len(sizes), np.int64), [], 0, 0
    for gap, n, items in groups[:kept]:
        offset = 0
        for k in items:
            runs[k].append((rank[k], sequence, offset))
            rank[k] += n
            offset += int(sizes[k])
        if gap >= FILL_LEAST:
            gaps.append((stream, gap, sequence, capacity - gap))
            stream += gap * n
        sequence += n
    gaps.append((stream, capacity, sequence, 0))
    out, place = {}, 0
    for k, r in enumerate(runs):
        out[int(sizes[k])] = (*(np.array(c, np.int64) for c in (zip(*r, strict=True) if r else ((), (), ()))), int(rank[k]), place)
        place += int((counts[k] - rank[k]) * sizes[k])
    return out, np.array(gaps, np.int64)


def spread(position: int, size: int, gaps: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(offset in the document, length, sequence, offset) of the pieces of a stream range."""
    out, at, end = [], position, position + size
    k = int(np.searchsorted(gaps[:, 0], at, "right")) - 1
    while at < end:
        base, gap, sequence, offset = (int(v) for v in gaps[k])
        limit = int(gaps[k + 1, 0]) if k + 1 < len(gaps) else end
        while at < min(end, limit):
            j, inside = divmod(at - base, gap)
            n = min(gap - inside, end - at)
            out.append((at - position, n, sequence + j, offset + inside))
            at += n
        k += 1
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row a piece.

    Null and empty texts are one piece of the closing id 0; repeated rows are packed each by itself; a
    null doc_id stays null.  Other columns are ignored; an empty table gives an empty result.  The
    vocabulary file must be readable under the same path on every executor.
    """
    st = Stage(docs.sparkSession, "packing")
    pieces = st.put(plain_docs(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer, capacity), _PIECES), "pieces")
    by_part = pieces.groupBy("part", "size").count()
    ahead = by_part.withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("part")) - F.col("count"))
    ahead = st.put(ahead, "ahead")
    total = {r["size"]: r["n"] for r in ahead.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    full = total.pop(capacity, 0)
    slots, gaps = plan(total, capacity)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches):
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            cols = [b.column(c).to_numpy(zero_copy_only=False).copy() for c in names[:5]] + [rank.copy(), np.zeros(len(rank), np.int64)]
            whole, more = np.ones(len(rank), bool), []
            order = np.argsort(size, kind="stable")
            for lo, hi in T.runs(size[order]):
                s, rows = int(size[order[lo]]), order[lo:hi]
                if s == capacity:
                    continue
                first, sequence, offset, pool, place_ = slots[s]
                kept = rows[rank[rows] < pool]
                k = np.searchsorted(first, rank[kept], "right") - 1
                cols[5][kept], cols[6][kept] = full + sequence[k] + rank[kept] - first[k], offset[k]
                for r in rows[rank[rows] >= pool].tolist():
                    whole[r] = False
                    ids = _wide(b.column("ids")[r].as_py(), s)
                    more += [(r, i, n, zlib.crc32(ids[4 * i: 4 * (i + n)]), full + q, o) for i, n, q, o in spread(place_ + (int(rank[r]) - pool) * s, s, gaps)]
            if more:
                r, i, n, crc, q, o = (np.array(c, np.int64) for c in zip(*more, strict=True))
                cut = [cols[0][r], cols[1][r] + i, n, crc, cols[4][r], q, o]
                cols = [np.concatenate([c[whole], x]) for c, x in zip(cols, cut, strict=True)]
            null = np.isnan(cols[0]) if cols[0].dtype.kind == "f" else None
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=null if j == 0 else None) if null is None or j else pa.array(np.where(null, 0, c).astype(np.int64), mask=null) for j, c in enumerate(cols)], names=names)

    ranked = join_checked(pieces, ahead.select("part", "size", "before"), ["part", "size"], "inner", 24)
    ranked = ranked.select(*names[:5], "size", (F.col("at") + F.col("before")).alias("rank"), "ids")
    return ranked.mapInArrow(place, ", ".join(f"{n} long" for n in names))
