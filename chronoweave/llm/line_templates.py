"""Boilerplate lines found with a fixed-depth log-template tree and dropped.

A line's leaf is its token count and its first DEPTH tokens, fields with digits read as variable.  Within
a leaf a token stays constant at its position if MIN_DOCS documents have it there; all else is a variable
field.  Lines that keep at least CONSTANT of their tokens share a template if their constants agree; lines
of a template that MIN_DOCS documents have are candidates.  A template recurs if it has MIN_DOCS contexts,
a context being the leaves of the nearest lines on each side that are neither candidates nor under
MIN_TOKENS, so that a run of candidates counts as a whole.  Copies are no evidence: equal texts count
once, and a text counts only if OWN of its words lie in such lines of its own (in a copy nearly all
lines are candidates); contexts must be at least CONTEXTS of the texts that count.  Lines of recurring
templates are dropped, in every document; lines under MIN_TOKENS stay.  For lines of more than LONG tokens
LONG_DOCS takes the place of MIN_DOCS; where fewer than MIN_DOCS have one, the smallest doc_id keeps it.

Everything after the scans is aggregation with partial sums, over lines of recurring leaves only.  Whether a
token is a constant is told by two bitmaps, of the constants and of the other keys that the first holds by
chance; keys that both hold are compared themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import Stage, join_checked, plain_docs

_U = np.uint64
DEPTH, MIN_TOKENS, MIN_DOCS, CONSTANT, CONTEXTS, OWN = 2, 4, 5, 0.6, 0.5, 1 / 3
LONG, LONG_DOCS = 50, 2  # lines of more than LONG tokens recur from LONG_DOCS documents on
# Keys are dealt by their highest PIECE_BITS bits; the bitmaps that travel with the scans have 2^MAP_BITS bits for
# each piece (8 MB in all) and two for a key.  Chance hits cost work but change no result.
PIECE_BITS, MAP_BITS = 10, 16
HELD = 1 << 18  # keys that a task holds before it passes them on
SLICE = 1 << 18  # bytes of text at a time, as arrays over its tokens take many times that
_DIGIT = np.array([48 <= c < 58 for c in range(256)])
_WILD = _U(0x57494C44)


def _lines(b: pa.RecordBatch):
    """Per line: row, number and leaf; token hashes and each line's first token."""
    buf, rows = T.texts(b.column(b.schema.get_field_index("text")))
    begin = np.union1d(rows[:-1], np.flatnonzero(buf == 10) + 1)
    begin = begin[begin < len(buf)]
    edge = np.append(begin, len(buf))
    s, e, first = T.words(buf, edge)
    h = T.hashes(buf, s, e)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    h = np.where(digits[e] > digits[s], _WILD, h)
    row = np.searchsorted(rows, begin, "right") - 1
    n = np.diff(first)
    leaf = n.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    for k in range(DEPTH):
        has = n > k
        leaf[has] = T.mix(leaf[has] + h[first[:-1][has] + k] * _U(2 * k + 1))
    leaf = T.mix(leaf)
    number = np.arange(len(row)) - T.starts_of(row)[np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))] if len(row) else np.zeros(0, np.int64)
    return row, number.astype(np.int32), leaf, h, first


def _counted(b: pa.RecordBatch, which: np.ndarray, keys: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and in how many of the batch's documents each is (twice, and 1 more for keys of long lines); documents
    lie in one batch."""
    doc = b.column(b.schema.get_field_index("doc_id")).to_numpy()[which].astype(np.uint64)
    at = np.unique(T.mix(keys + T.mix(doc) * _U(3)), return_index=True)[1]
    keys, one, docs = np.unique(keys[at], return_index=True, return_counts=True)
    return keys, 2 * docs + long[at][one]


def _summed(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, in order, with their documents added up."""
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[first], 2 * np.add.reduceat(docs >> 1, first) + (docs[first] & 1) if len(keys) else docs


def _dealt(found):
    """(piece, keys, docs): the counted keys of several batches, packed by piece."""
    held, n = [], 0

    def packed():
        keys, docs = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        pieces, start = np.unique(keys >> _U(64 - PIECE_BITS), return_index=True)
        edge = np.append(start, len(keys))
        cols = [pa.array(pieces.astype(np.int64))]
        for x in (keys, docs.astype(np.int64)):
            at = pa.py_buffer((8 * edge).astype(np.int32).tobytes())
            cols.append(pa.Array.from_buffers(pa.binary(), len(pieces), [None, at, pa.py_buffer(x.tobytes())]))
        return pa.RecordBatch.from_arrays(cols, names=["piece", "keys", "docs"])

    for x in found:
        held.append(x)
        n += len(x[0])
        if n > HELD:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def _leaves(batches):
    """The leaves of the lines that count."""

    def found():
        for b in T.released(batches):
            leaves, sizes = (b.column(b.schema.get_field_index(c)) for c in ("leaves", "sizes"))
            row = np.repeat(np.arange(b.num_rows), np.diff(leaves.offsets.to_numpy()))
            leaf, n = leaves.flatten().to_numpy().astype(np.uint64), sizes.flatten().to_numpy()
            ok = n >= MIN_TOKENS
            yield _counted(b, row[ok], leaf[ok], n[ok] > LONG)

    return _dealt(found())


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a key in the bitmap of its piece."""
    low = _U((1 << MAP_BITS) - 1)
    return (keys >> _U(38)) & low, (keys >> _U(22)) & low


def _bitmap(keys: np.ndarray) -> np.ndarray:
    """The bitmap of keys of one piece."""
    out = np.zeros(1 << MAP_BITS, np.uint8)
    for at in _bits(keys):
        out[at] = 1
    return np.packbits(out, bitorder="little")


def _has(bits: np.ndarray, keys: np.ndarray, pieces: bool = True) -> np.ndarray:
    """Which keys may be known by the bitmap, of all pieces or of the keys' own one."""
    piece = (keys >> _U(64 - PIECE_BITS)) << _U(MAP_BITS) if pieces else _U(0)
    one, two = ((bits[(piece | at) >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1 for at in _bits(keys))
    return one & two


def _judged(table: pa.Table) -> pa.Table:
    """Of a piece: the bitmap of the keys that enough documents have, the bitmap of the others that it holds by
    chance, and the keys of enough documents that the second one holds."""
    keys, docs = (np.frombuffer(b"".join(x.as_py() for x in table[c]), t) for c, t in (("keys", np.uint64), ("docs", np.int64)))
    keys, docs = _summed(keys, docs)
    often = docs >> 1 >= np.where(docs & 1, LONG_DOCS, MIN_DOCS)
    known = _bitmap(keys[often])
    rest = keys[~often]
    doubt = _bitmap(rest[_has(known, rest, False)])
    unsure = keys[often][_has(doubt, keys[often], False)]
    cols = [pa.array([x.tobytes()], pa.binary()) for x in (known, doubt)]
    return pa.table([table["piece"].combine_chunks()[:1], *cols, pa.array([unsure.astype(np.int64)], pa.list_(pa.int64()))], names=["piece", "known", "doubt", "unsure"])


def _whole(pieces: DataFrame, name: str) -> np.ndarray:
    """The pieces' bitmaps in one."""
    size = 1 << (MAP_BITS - 3)
    out = np.zeros(size << PIECE_BITS, np.uint8)
    for r in pieces.select("piece", name).toLocalIterator():  # 8 MB in all
        out[r[0] * size: (r[0] + 1) * size] = np.frombuffer(r[1], np.uint8)
    return out


def _keys(b: pa.RecordBatch, leaves: np.ndarray):
    """Lines of the leaves: document row, number, leaf and size; their tokens' line, and key of leaf, position
    and token (masked fields are no constants and have none)."""
    row, number, leaf, h, first = _lines(b)
    n = np.diff(first)
    at = np.flatnonzero((n >= MIN_TOKENS) & _has(leaves, leaf))
    n = n[at]
    line = np.repeat(np.arange(len(at)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    tok = h[first[:-1][at][line] + pos]
    plain = tok != _WILD
    line, pos, tok = line[plain], pos[plain], tok[plain]
    return row[at], number[at], leaf[at], n, line, T.mix(leaf[at][line] + T.mix(tok + pos.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def _constants(leaves: np.ndarray):
    """The keys of the leaves' tokens."""

    def found(batches):
        for b in T.slices(batches, most=SLICE):
            row, _, _, n, line, key = _keys(b, leaves)
            yield _counted(b, row[line], key, n[line] > LONG)

    return lambda batches: _dealt(found(batches))


def _kept(leaves: np.ndarray, known: np.ndarray, doubt: np.ndarray):
    """A row for each line that may keep enough: the sum (xor) and number of the keys that are constants for
    certain, and the keys that are constants or chance hits of the bitmap."""

    def run(batches):
        for b in T.slices(batches, most=SLICE):
            row, number, leaf, n, line, key = _keys(b, leaves)
            hit = _has(known, key)
            enough = np.bincount(line[hit], minlength=len(n)) >= CONSTANT * n
            hit &= enough[line]
            line, key, at = line[hit], key[hit], np.flatnonzero(enough)
            if not len(at):
                continue
            open_ = _has(doubt, key)
            first = np.searchsorted(line, at)
            mask = np.bitwise_xor.reduceat(np.where(open_, _U(0), key), first)
            held = np.add.reduceat((~open_).astype(np.int64), first)
            edge = np.append(np.searchsorted(line[open_], at), open_.sum()).astype(np.int32)
            own = b.column(b.schema.get_field_index("own")).to_numpy()[row[at]]
            doc = b.column(b.schema.get_field_index("doc_id")).to_numpy()[row[at]]
            whole = (number[at].astype(np.int64) << 32) | n[at]  # the line's number and size in one
            cols = [pa.array(x) for x in (own, doc, whole, mask.astype(np.int64), held)]
            cols.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(key[open_].astype(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, names=["own", "doc_id", "at", "mask", "held", "open"])

    return run


def _frames(batches):
    """Per document: a hash of its text, and its lines' leaves and sizes."""
    for b in T.slices(batches, most=SLICE):
        buf, rows = T.texts(b.column(b.schema.get_field_index("text")))
        text = T.hashes(buf, rows[:-1], rows[1:])
        row, _, leaf, _, first = _lines(b)
        at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
        cols = [b.column(b.schema.get_field_index("doc_id")), pa.array(text.astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(leaf.astype(np.int64))), pa.ListArray.from_arrays(at, pa.array(np.diff(first).astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "leaves", "sizes"])


def _around(batches):
    """(template, text, context) of the candidate lines of documents that have enough text of their own."""
    for b in T.released(batches):
        out = []
        for text, leaves, sizes, lines, templates in zip(*(b.column(c) for c in ("text", "leaves", "sizes", "lines", "templates")), strict=True):
            leaf, size = leaves.values.to_numpy().astype(np.uint64), sizes.values.to_numpy()
            line = lines.values.to_numpy()
            own = size >= MIN_TOKENS
            own[line] = False
            if size[own].sum() < OWN * size.sum():
                continue
            at = np.flatnonzero(own)
            k = np.searchsorted(at, line)
            near = np.concatenate([[_U(0)], leaf[at], [_U(0)]])
            context = T.mix(near[k] * _U(3) + near[k + 1])
            out.append((templates.values.to_numpy(), np.full(len(line), text.as_py()), context.astype(np.int64)))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["template", "text", "context"])


def recurring_lines(docs: DataFrame, stage: Stage) -> DataFrame:
    """``doc_id, lines``: the numbers (from 0) of the lines to drop, for documents that have any."""
    least = F.when(F.col("long"), LONG_DOCS).otherwise(MIN_DOCS)

    def judged(found: DataFrame, name: str) -> DataFrame:
        return stage.put(found.groupBy("piece").applyInArrow(_judged, "piece long, known binary, doubt binary, unsure array<long>"), name)

    # staged, so that no task holds two Python workers
    frames = stage.put(docs.mapInArrow(_frames, "doc_id long, text long, leaves array<long>, sizes array<int>"), "frames")
    dealt = "piece long, keys binary, docs binary"
    leaves = _whole(judged(frames.mapInArrow(_leaves, dealt), "leaves"), "known")  # a filter only: constants need as many documents
    keys = judged(docs.mapInArrow(_constants(leaves), dealt), "keys")
    known, doubt = _whole(keys, "known"), _whole(keys, "doubt")
    own = docs.withColumn("own", F.monotonically_increasing_id())  # tells repeated rows of a document apart
    kept = own.mapInArrow(_kept(leaves, known, doubt), "own long, doc_id long, at long, mask long, held long, open array<long>")
    kept = stage.put(kept, "kept")
    # only keys that both bitmaps hold are compared with the constants themselves
    unsure = keys.select(F.explode("unsure").alias("key"))
    part = kept.where(F.size("open") > 0)
    sure = part.select("own", "doc_id", "at", "mask", "held")
    more = part.select("own", "doc_id", "at", F.explode("open").alias("key")).join(unsure, "key")
    more = sure.unionByName(more.select("own", "doc_id", "at", F.col("key").alias("mask"), F.lit(1).cast("long").alias("held")))
    more = more.groupBy("own", "doc_id", "at").agg(F.bit_xor("mask").alias("mask"), F.sum("held").alias("held"))
    shape = kept.where(F.size("open") == 0).select("own", "doc_id", "at", "mask", "held").unionByName(more)
    n = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    shape = shape.where(F.col("held") >= CONSTANT * n)  # a key holds its leaf, so the keys alone name the template
    shape = shape.select("doc_id", F.shiftright("at", 32).cast("int").alias("line"), (n > LONG).alias("long"), F.xxhash64("mask", "held").alias("template"))
    shape = stage.put(shape, "shape")
    stage.drop("leaves", "keys", "kept")
    often = shape.select("template", "long", "doc_id").distinct().groupBy("template", "long").count().where(F.col("count") >= least).select("template")
    shape = stage.put(join_checked(shape, stage.put(often, "often"), "template", "left_semi", 16), "candidates")
    mine = shape.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line", "template"))).alias("c")).select("doc_id", F.col("c.line").alias("lines"), F.col("c.template").alias("templates"))
    around = join_checked(frames, stage.put(mine, "mine"), "doc_id", "inner", 400).mapInArrow(_around, "template long, text long, context long")
    around = stage.put(around, "around")
    stage.drop("frames")
    texts = around.select("template", "text").distinct().groupBy("template").agg(F.count("*").alias("texts"))
    contexts = around.select("template", "context").distinct().groupBy("template").agg(F.count("*").alias("contexts"))
    # of a long line in fewer than MIN_DOCS texts the smallest document keeps its copy
    held = shape.groupBy("template", "long").agg(F.min("doc_id").alias("first"))
    again = texts.join(contexts, "template").join(held, "template").where((F.least("texts", "contexts") >= least) & (F.col("contexts") >= CONTEXTS * F.col("texts")))
    again = again.select("template", F.when(F.least("texts", "contexts") < MIN_DOCS, F.col("first")).alias("keeper"))
    again = stage.put(again, "again")
    out = join_checked(shape, again, "template", "inner", 24).where("keeper IS NULL OR doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    return stage.put(out, "drop")


def drop_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``text`` replaced by what is left, and ``n_lines``, ``n_dropped`` added.

    Null and empty texts have no lines and stay as they are.  Rows with the same doc_id must be equal;
    rows without one are left alone.  A frame that has columns n_lines or n_dropped gets them replaced.
    An empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "lines")
    drop = recurring_lines(plain_docs(docs).where("doc_id IS NOT NULL"), stage)
    mark = "_drop"
    while mark in docs.columns:
        mark += "_"
    drop = drop.withColumnRenamed("lines", mark)
    parts = F.split("text", "\n")
    left = F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(`{mark}`, i)), '\\n')")
    out = join_checked(docs, drop, "doc_id", "left", 48)
    out = out.withColumn("n_lines", F.when(F.length("text") > 0, F.size(parts)).otherwise(0).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(mark).isNull(), 0).otherwise(F.size(mark)).cast("long"))
    return out.withColumn("text", F.when(F.col(mark).isNull(), F.col("text")).otherwise(left)).select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
