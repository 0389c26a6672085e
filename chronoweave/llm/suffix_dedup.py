"""Removal of bytes that an earlier document already has in a run of at least 50 equal bytes.

1. Anchors.  Every 50-byte string picks one 19-byte gram of its own by minimum hash, so equal strings
   pick the same gram at the same offset, wherever they lie.  Grams are counted by distinct texts, in
   hashed buckets; only grams of two or more texts matter.  Exact copies of a text are one class.
2. Windows.  For each shared gram of a text, the bytes that any 50-byte string choosing it can cover
   (at most 81).  All occurrences of a repeated 50-byte string lie in windows of one gram, so buckets of
   grams are independent, and within a bucket equal windows are stored once with their smallest doc_id.
3. Suffixes.  A bucket's distinct windows are cut into shards; each shard's suffixes are sorted (prefix
   doubling) and give its Burrows-Wheeler transform.  The transforms alone are then merged by interleave
   refinement: leading symbols are read off the transforms' own mappings, the shards' orders, sorted as
   they are, are merged by them, and each further pass steps backwards through the transforms and refines
   the interleave by one more symbol.  The pass at which neighbours part is their common prefix; runs with
   50 common symbols are the repeated intervals.  Suffixes are never sorted again across shards.  Windows
   that differ from all others of their gram on both sides of it hold no repeat and take no part.
   A gram of more than HOT_TEXTS texts would make one task too large: its strings are told apart by
   128-bit hashes instead, whose smallest doc_id is found by partial sums and a join that can be split.
4. A start position of a text is a repeat if its interval holds a smaller doc_id; the 50 bytes from
   there go.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import Stage, join_checked, partitions, plain_docs, small

_U = np.uint64
LENGTH, GRAM = 50, 19
SPAN = LENGTH - GRAM + 1  # grams of one string
SIDE = (LENGTH - GRAM + 1) // 2
BATCH = 1 << 22  # bytes of windows that are merged together
SHARD = 1 << 18  # bytes of windows whose suffixes are sorted together
HOT_TEXTS = 1 << 16  # texts of one gram that a task takes
_HOT = 1 << 62  # marks such a gram's key
STOP = 255  # ends a window; no byte of UTF-8 has this value


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive entries, by doubling."""
    k, out = 1, x
    while 2 * k <= n:
        out = f(out[:-k], out[k:])
        k *= 2
    return f(out[: len(out) - (n - k)], out[n - k:]) if n > k else out


def anchors(buf: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys (32 + bits wide) of the grams that some string of LENGTH bytes within a row picks.

    Of equal grams in a string each counts, so the choice depends on the string alone."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(buf) < LENGTH:
        return none
    c = T.prefix(buf)
    n = len(buf) - GRAM + 1
    at = np.arange(n)
    full = T.range_hash(c, at, at + GRAM) >> _U(32 - bits)
    h = (full & _U(0xFFFFFFFF)).astype(np.uint32)
    low = _slide(h, SPAN, np.minimum)  # for the string that starts at each position
    ok = np.ones(len(low), bool)  # strings that end within their row
    bad = np.zeros(len(low) + 1, np.int32)
    inner = rows[1:-1]
    np.add.at(bad, np.clip(inner - LENGTH + 1, 0, len(low)), 1)
    np.add.at(bad, np.clip(inner, 0, len(low)), -1)
    ok = np.cumsum(bad[:-1]) == 0
    low = np.where(ok, low, np.uint32(0))
    pad = np.zeros(SPAN - 1, np.uint32)
    high = _slide(np.concatenate([pad, low, pad]), SPAN, np.maximum)[:n]
    cover = np.zeros(n + 1, np.int32)
    live = np.flatnonzero(ok)
    if not len(live):
        return none
    # a position counts only if a string over it is valid
    edge = np.concatenate([[True], np.diff(live) > 1])
    begin, end = live[edge], np.append(live[np.flatnonzero(edge)[1:] - 1], live[-1])
    cover[begin] += 1
    np.add.at(cover, np.minimum(end + SPAN, n), -1)
    pick = np.flatnonzero((high == h) & (np.cumsum(cover[:-1]) > 0))
    return pick, full[pick]


def _post(bits: int):
    """Distinct gram keys of each text, by bucket; a text is named by 64 bits of its digest."""

    def run(batches):
        keys, refs, ids, held, docs = [], [], [], 0, 0

        def flush():
            if not held:
                return
            k, r, names = np.concatenate(keys), np.concatenate(refs), np.concatenate(ids)
            order = np.lexsort((r, k))
            k, r = k[order], r[order]
            keep = np.ones(len(k), bool)
            keep[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
            k, r = k[keep], r[keep]
            bucket = (k >> _U(32)).astype(np.int64)
            rest = (k & _U(0xFFFFFFFF)).astype(np.uint32)
            out = []
            for a, z in T.runs(bucket):
                used, local = np.unique(r[a:z], return_inverse=True)
                out.append((int(bucket[a]), np.array([len(used), z - a], np.int64).tobytes() + names[used].tobytes() + local.astype(np.uint32 if len(used) >> 16 else np.uint16).tobytes() + rest[a:z].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "blob"])

        for b in T.slices(batches):
            buf, rows = T.texts(b.column(b.schema.get_field_index("text")))
            at, key = anchors(buf, rows, bits)
            row = np.searchsorted(rows, at, "right") - 1
            keys.append(key)
            refs.append(row + docs)
            ids.append(b.column(b.schema.get_field_index("sig")).to_numpy())
            held, docs = held + len(key), docs + b.num_rows
            if held > 1_000_000:
                yield from flush()
                keys, refs, ids, held, docs = [], [], [], 0, 0
        yield from flush()

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    u, m = np.frombuffer(blob, np.int64, 2)
    ids = np.frombuffer(blob, np.int64, u, 16)
    wide = np.uint32 if u >> 16 else np.uint16
    at = 16 + 8 * u
    return np.frombuffer(blob, np.uint32, m, at + m * wide().itemsize), ids[np.frombuffer(blob, wide, m, at)]


def _shared(bits: int):
    """For each text the keys of the bucket that another text has too, as bytes of 8 each."""

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
        many = np.repeat(size, size) > 1
        rest, ids = rest[many], ids[many]
        order = np.argsort(ids, kind="stable")
        large = np.repeat(size, size)[many][order] > HOT_TEXTS
        rest, ids = rest[order].astype(np.int64) | (bucket << 32) | np.where(large, _HOT, 0), ids[order]
        return pa.table([pa.array(ids[T.starts_of(ids)]), pa.array([rest[a:z].tobytes() for a, z in T.runs(ids)], pa.binary()), pa.array([bool(large[a:z].any()) for a, z in T.runs(ids)], pa.bool_())], names=["sig", "keys", "hot"])

    return run


def _pick(b: pa.RecordBatch, bits: int, hot: bool) -> tuple[np.ndarray, ...]:
    """The bytes and row offsets of a batch; positions, keys and rows of its grams that its lists name."""
    buf, rows = T.texts(b.column(b.schema.get_field_index("text")))
    at, key = anchors(buf, rows, bits)
    row = np.searchsorted(rows, at, "right") - 1
    keep = np.zeros(len(at), bool)
    edge = np.searchsorted(row, np.arange(b.num_rows + 1))
    for i, x in enumerate(b.column(b.schema.get_field_index("keys"))):
        mine = np.frombuffer(b"".join(x.as_py()), np.int64)
        mine = mine[(mine & _HOT > 0) == hot] & (_HOT - 1)
        keep[edge[i]: edge[i + 1]] = np.isin(key[edge[i]: edge[i + 1]], mine.astype(np.uint64))
    return buf, rows, at[keep], key[keep], row[keep]


def _hot_strings(bits: int):
    """Two hashes, document and place of every string that picks a gram of too many texts."""

    def run(batches):
        for b in T.slices(batches, most=1 << 18):
            buf, rows, at, _, row = _pick(b, bits, True)
            start = np.unique((at[:, None] - np.arange(SPAN)).ravel())
            start = start[start >= 0]
            row = np.searchsorted(rows, start, "right") - 1
            ok = start + LENGTH <= rows[row + 1]
            start, row = start[ok], row[ok]
            doc, sig = (b.column(b.schema.get_field_index(k)).to_numpy()[row] for k in ("doc_id", "sig"))
            one = T.hashes(buf, start, start + LENGTH)
            two = T.range_hash(T.prefix(buf), start, start + LENGTH)
            cols = (one.astype(np.int64), two.astype(np.int64), doc, sig, start - rows[row])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "doc_id", "sig", "start"])

    return run


_WINDOWS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _windows(bits: int, buckets: int):
    """Windows of the shared grams, by bucket, equal ones of a batch stored once with their occurrences."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        held, weight = [], 0

        def flush():
            doc, sig, pos, key, off, size, hsh, left, right, raw = (np.concatenate([h[i] for h in held]) for i in range(10))
            start = np.cumsum(size) - size
            order = np.lexsort((doc, hsh, key))
            order = order[np.argsort(key[order] % _U(buckets), kind="stable")]  # keys are spread by their low bits
            b = (key[order] % _U(buckets)).astype(np.int64)
            out = []
            for a, e in T.runs(b):
                o = order[a:e]
                first = np.ones(len(o), bool)
                first[1:] = (hsh[o][1:] != hsh[o][:-1]) | (key[o][1:] != key[o][:-1])
                kind = np.cumsum(first) - 1
                f = o[first]
                body = b"".join(raw[s: s + n].tobytes() for s, n in zip(start[f].tolist(), size[f].tolist(), strict=True))
                head = np.array([len(f), len(o)], np.int64).tobytes()
                meta = key[f].tobytes() + hsh[f].tobytes() + left[f].tobytes() + right[f].tobytes() + size[f].astype(np.uint8).tobytes() + off[f].astype(np.uint8).tobytes()
                occ = kind.astype(np.uint32).tobytes() + doc[o].tobytes() + sig[o].tobytes() + pos[o].astype(np.int64).tobytes()
                out.append((int(b[a]), z.compress(head + meta + occ + body)))
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[i: i + 64]], pa.int32()), pa.array([x[1] for x in out[i: i + 64]], pa.binary())], schema=_WINDOWS)

        for b in T.slices(batches):
            buf, rows, at, key, row = _pick(b, bits, False)
            doc, sig = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("doc_id", "sig"))
            if not len(at):
                continue
            lo = np.maximum(at - (LENGTH - GRAM), rows[row])
            hi = np.minimum(at + LENGTH, rows[row + 1])
            size = hi - lo
            spot = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            c = T.prefix(buf)
            # a string of LENGTH bytes has SIDE bytes before its gram or as many after it
            left = np.where(at - lo >= SIDE, T.range_hash(c, np.maximum(at - SIDE, 0), at + GRAM) >> _U(32), _U(0)).astype(np.uint32)
            right = np.where(hi - at >= GRAM + SIDE, T.range_hash(c, at, np.minimum(at + GRAM + SIDE, len(buf))) >> _U(32), _U(0)).astype(np.uint32)
            whole = T.hashes(buf, lo, np.minimum(hi, lo + T.LANES)) ^ T.range_hash(c, lo, hi)
            held.append((doc[row], sig[row], lo - rows[row], key, at - lo, size, whole, left, right, buf[spot]))
            weight += len(spot) + 48 * len(at)
            if weight > 12 << 20:
                yield from flush()
                held, weight = [], 0
        if held:
            yield from flush()

    return run


def shard_bwt(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of the windows (sorted rows, each filled with STOP to the same width) and
    the symbol before each; prefix doubling on ranks of 8, 16, ... symbols, equal suffixes in row order.

    A row's suffix ends at its first STOP, where it is followed by the row itself, so rows in sorted
    order keep stable passes by the preceding symbol consistent."""
    n, width = rows.shape
    pad = np.concatenate([rows, np.full((n, 8), STOP, np.uint8)], axis=1)
    word = np.zeros((n, width), np.uint64)
    for j in range(8):
        word = (word << _U(8)) | pad[:, j: j + width]
    live = np.concatenate([np.ones((n, 1), bool), rows[:, :-1] != STOP], axis=1)  # to the first STOP
    at = np.flatnonzero(live.ravel())
    col = at % width
    rank = _ranks(word.ravel()[at])
    size = live.sum(axis=1)
    left = np.repeat(size, size) - 1 - (np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size))  # symbols before STOP
    done = 8
    last = rank[left == 0][0]  # of the empty suffix
    while done < width and rank.max() + 1 < len(rank):
        later = np.full(len(rank), last, np.int64)
        inside = np.flatnonzero(left >= done)
        later[inside] = rank[inside + done]
        rank = _ranks(rank.astype(np.uint64) * _U(len(rank) + 1) + later.astype(np.uint64))
        last = rank[left == 0][0]
        done *= 2
    order = np.argsort(rank, kind="stable")
    before = np.where(col == 0, np.uint8(STOP), rows.ravel()[np.maximum(at - 1, 0)])
    return at[order], before[order]


def _ranks(word: np.ndarray) -> np.ndarray:
    order = np.argsort(word)
    w = word[order]
    out = np.empty(len(word), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])])
    return out


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs (keys, entries) merged two by two; of equal keys those of the first run come first."""

    def two(a, b):
        at = np.concatenate([np.arange(len(a[0])) + np.searchsorted(b[0], a[0], "left"), np.arange(len(b[0])) + np.searchsorted(a[0], b[0], "right")])
        out = np.empty(len(at), a[0].dtype), np.empty(len(at), np.int64)
        for o, x, y in zip(out, a, b, strict=True):
            o[at] = np.concatenate([x, y])
        return out

    while len(runs) > 1:
        runs = [reduce(two, runs[i: i + 2]) for i in range(0, len(runs), 2)]
    return runs[0]


def merge_bwt(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' transforms by their first ``depth`` symbols.

    Returns each entry's place (an entry is a row of a transform, numbered through the shards; equal ones
    share the first place of their run) and, by place, the common prefix with the place before (``depth``
    where it is as long).  Only the transforms are read: sorting a transform's symbols stably gives the
    entry that follows each, and so the first eight symbols of every entry, by which the shards' orders
    are merged.  Each pass then refines the interleave by one more symbol: entries of a block are told
    apart by where the last pass put the entries that follow them.  Only entries before ones that moved
    can move, and in their blocks they come after those that stay; settled blocks cost nothing."""
    before = np.concatenate(shards)
    n = len(before)
    follow, runs, base = np.empty(n, np.int64), [], 0
    for x in shards:
        follow[base: base + len(x)] = np.argsort(x, kind="stable") + base
        base += len(x)
    word = before[follow].astype(np.uint64)  # the first symbol of each entry: the transform's, sorted
    first, over, step = word.copy(), word == STOP, follow
    for bits in (8, 16, 32):
        tail = np.where(over, _U((1 << bits) - 1), word[step])
        over |= over[step]
        word, step = (word << _U(bits)) | tail, step[step]
    base = 0
    for x in shards:
        runs.append((word[base: base + len(x)], np.arange(base, base + len(x))))
        base += len(x)
    k, merged = _merged(runs)
    head = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[merged] = start[np.cumsum(head) - 1]
    size = np.zeros(n, np.int64)
    size[start] = np.diff(np.append(start, n))
    common = np.full(n, depth, np.int16)
    differ = (k[1:] ^ k[:-1])[head[1:]]
    common[0] = 0
    common[start[1:]] = np.sum([(differ >> _U(64 - 8 * j)) == 0 for j in range(1, 8)], axis=0)
    previous = np.empty(n, np.int64)
    previous[follow] = np.arange(n)
    move = np.flatnonzero(first != STOP)
    for h in range(8, depth):
        if not len(move):
            break
        old, after = rank[move], rank[follow[move]]
        order = np.argsort(old * n + after)
        move, old, after = move[order], old[order], after[order]
        block = T.starts_of(old)
        count = np.diff(np.append(block, len(old)))
        stay = size[old[block]] - count
        run = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])]))
        of = np.searchsorted(block, run, "right") - 1
        place = old[run] + stay[of] + run - block[of]
        length = np.diff(np.append(run, len(old)))
        keep = stay > 0
        size[old[block[keep]]] = stay[keep]
        size[place] = length
        new = np.repeat(place, length)
        rank[move] = new
        moved = move[new != old]
        common[place[place != old[run]]] = h
        move = previous[moved[before[moved] != STOP]]
    return rank, common


def repeats(rows: np.ndarray, low: np.ndarray, ok: np.ndarray, depth: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """For each window and start the smallest of ``low`` among windows with the same ``depth`` bytes from
    there, over the starts that ``ok`` allows (others: the largest integer)."""
    n, width = rows.shape
    out = np.full((n, width), np.iinfo(np.int64).max)
    per = max(1, shard // width)
    places, shards = [], []
    for a in range(0, n, per):
        order = np.argsort(np.ascontiguousarray(rows[a: a + per]).view(f"S{width}").ravel(), kind="stable")
        at, before = shard_bwt(rows[a: a + per][order])
        places.append((order[at // width] + a) * width + at % width)
        shards.append(before)
    rank, common = merge_bwt(shards, depth)
    interval = (np.cumsum(common < depth) - 1)[rank]  # runs of places with as long a common prefix
    place = np.concatenate(places)
    use = ok.ravel()[place]
    place, interval = place[use], interval[use]
    order = np.argsort(interval, kind="stable")
    place, interval = place[order], interval[order]
    if len(place):
        at = T.starts_of(interval)
        least = np.minimum.reduceat(low[place // width], at)
        out.ravel()[place] = np.repeat(least, np.diff(np.append(at, len(interval))))
    return out


def _twice(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Where another entry has the same key and (non-zero) side hash."""
    order = np.lexsort((side, key))
    k, x = key[order], side[order]
    same = (k[1:] == k[:-1]) & (x[1:] == x[:-1])
    out = np.zeros(len(key), bool)
    out[order] = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (x > 0)
    return out


def _bucket():
    """Byte ranges to remove, (doc_id, start, stop), from the windows of one bucket."""
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    width = 2 * LENGTH - GRAM + 1

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        z = zstandard.ZstdDecompressor()
        cols, base = [[] for _ in range(11)], 0
        for blob in table["blob"]:
            raw = z.decompress(blob.as_py())
            f, o = (int(v) for v in np.frombuffer(raw, np.int64, 2))
            at = 16
            for k, (kind, n) in enumerate(((np.uint64, f), (np.uint64, f), (np.uint32, f), (np.uint32, f), (np.uint8, f), (np.uint8, f), (np.uint32, o), (np.int64, o), (np.int64, o), (np.int64, o))):
                x = np.frombuffer(raw, kind, n, at)
                cols[k].append(x.astype(np.int64) + base if k == 6 else x)
                at += x.nbytes
            cols[10].append(np.frombuffer(raw, np.uint8, len(raw) - at, at))
            base += f
        key, hsh, left, right, size, off, kind, doc, sig, pos, body = (np.concatenate(c) for c in cols)
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        order = np.lexsort((hsh, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (hsh[order][1:] != hsh[order][:-1])
        merged = np.empty(len(order), np.int64)
        merged[order] = np.cumsum(new) - 1
        kind = merged[kind]
        rep = order[new]
        key, size, off, start, left, right = key[rep], size[rep], off[rep].astype(np.int64), start[rep], left[rep], right[rep]
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, kind, doc)
        starts = np.arange(width)
        ok = (starts <= off[:, None]) & (starts + LENGTH >= off[:, None] + GRAM) & (starts + LENGTH <= size[:, None])
        least = np.where(ok, low[:, None], np.iinfo(np.int64).max)
        # only windows that agree with another of their gram on one side can share a string with it
        many = np.flatnonzero(_twice(key, left) | _twice(key, right))
        at = np.append(T.starts_of(key[many]), len(many))
        a = 0
        while a < len(at) - 1:  # grams are independent: whole groups of about a batch's size at a time
            e = max(a + 1, int(np.searchsorted(at, at[a] + BATCH // width, "right")) - 1)
            own = many[at[a]: at[e]]
            rows = np.full((len(own), width), STOP, np.uint8)
            inside = starts < size[own][:, None]
            rows[inside] = body[(start[own][:, None] + starts)[inside]]
            least[own] = repeats(rows, low[own], ok[own])
            a = e
        out = []
        for a in range(0, len(kind), 1 << 16):
            k, d, t = (x[a: a + (1 << 16)] for x in (kind, doc, sig))
            gone = least[k] < d[:, None]
            hit = np.flatnonzero(gone.any(axis=1))
            g = gone[hit]
            p = pos[a: a + (1 << 16)][hit]
            out.append((d[hit], t[hit], p + g.argmax(axis=1), p + width - 1 - g[:, ::-1].argmax(axis=1) + LENGTH))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.lexsort((cols[2], cols[0]))
        return pa.table([pa.array(x[order]) for x in cols], schema=schema)

    return run


def _apply(batches):
    """What is left of each text once its ranges are gone."""
    for b in batches:
        doc, text, ranges = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text", "ranges"))
        out = []
        for t, r in zip(text, ranges, strict=True):
            data = np.frombuffer(t.as_buffer(), np.uint8) if t.as_buffer() is not None else np.zeros(0, np.uint8)
            v = r.values
            lo, hi = v.field("start").to_numpy(), v.field("stop").to_numpy()
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, lo, 1)
            np.add.at(step, hi, -1)
            gone = np.cumsum(step[:-1]) > 0
            out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), data[~gone].tobytes()))
        cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([doc, b.column(b.schema.get_field_index("sig")), *cols], names=["doc_id", "sig", "n_removed", "n_spans", "kept"])


def repeated_ranges(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """``(meta, ranges)``: per row its size, digest and first equal document; per first document its
    ranges to remove as a list."""
    spark = docs.sparkSession
    bits = max(6, (partitions(spark) - 1).bit_length())
    docs = docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("sig", F.xxhash64("sha"))
    meta = stage.put(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha", "sig"), "meta")
    first = meta.groupBy("sha", "sig").agg(F.min("doc_id").alias("first"))
    docs = docs.drop("sha")
    grams = docs.where(F.octet_length("text") >= LENGTH).mapInArrow(_post(bits), "bucket int, blob binary")
    shared = grams.groupBy("bucket").applyInArrow(_shared(bits), "sig long, keys binary, hot boolean")
    shared = shared.groupBy("sig").agg(F.collect_list("keys").alias("keys"), F.max("hot").alias("hot"))
    lists = stage.put(shared.join(first, "sig").select(F.col("first").alias("doc_id"), "sig", "keys", "hot"), "lists")
    named = _near(docs, lists).join(lists, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"])
    windows = named.mapInArrow(_windows(bits, 4 << bits), "bucket int, blob binary")
    found = windows.groupBy("bucket").applyInArrow(_bucket(), "doc_id long, sig long, start long, stop long")
    if not lists.where("hot").isEmpty():
        strings = named.where("hot").mapInArrow(_hot_strings(bits), "h1 long, h2 long, doc_id long, sig long, start long")
        strings = stage.put(strings, "strings")
        least = strings.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        again = strings.join(stage.put(least.where("least < most"), "least"), ["h1", "h2"]).where("doc_id > least")
        found = found.unionByName(again.select("doc_id", "sig", "start", (F.col("start") + LENGTH).alias("stop")))
    ranges = stage.put(found.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "ranges")
    return meta, ranges


def _near(docs: DataFrame, some: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``some`` names, where its ids are few enough to broadcast; else all."""
    ids = some.select("doc_id")
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if small(ids, 64) else docs


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every row; ``kept`` holds the
    remaining bytes where some are gone and some stay, and is null otherwise (all kept or none).

    Null texts are empty; texts under 50 bytes keep everything.  Rows that repeat a doc_id are judged row
    by row, each by its own text against smaller ids; equal ones give equal rows.  Rows without a doc_id keep their bytes and remove none of others'.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "suffix")
    src = plain_docs(docs)
    meta, ranges = repeated_ranges(src.where("doc_id IS NOT NULL"), stage)
    signed = src.withColumn("sig", F.xxhash64(F.sha2(F.col("text").cast("binary"), 256)))
    cut = _near(signed, ranges).join(ranges, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"])
    cut = cut.mapInArrow(_apply, "doc_id long, sig long, n_removed long, n_spans long, kept binary")
    cut = stage.put(cut.withColumn("kept_sha256", F.sha2("kept", 256)), "cut")
    again = meta.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    again = stage.put(again, "again")  # apart from the count, a large class can be split in the join
    out = join_checked(join_checked(meta, again, "sha", "left", 80), cut, ["doc_id", "sig"], "left", 256)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    out = out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(~copy, F.col("kept")).alias("kept"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
    lost = src.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return out.unionByName(lost)
