"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words (lower-cased, split at ASCII punctuation) give unigrams, bigrams, one-gap skip-grams and word
stems of a few lengths, each hashed to 2**BITS slots and counted once per document, however long.
Training rows are a bounded sample of the labelled ones (TOXIC_ROWS, CLEAN_ROWS, smallest hash of the
id first) weighted back to the labels' proportions.  A slot enters the model once INCLUDE of the toxic
training rows have it (the inclusion rule of the FTRL-proximal paper); per-coordinate rates and L1 leave
a few thousand weights, which travel with the scoring tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import Stage, plain_docs

_U = np.uint64
BITS = 20
STEMS = (4, 5, 6, 8)
TOXIC_ROWS, CLEAN_ROWS = 4096, 8192
INCLUDE = 3
PARTS = 16  # in which the driver reads the training rows
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 1.0, 4


def _slots(batch: pa.RecordBatch):
    """Arrays (row, slot) of a batch's features, repeated ones included, family by family."""
    buf, rows = T.texts(batch.column(batch.schema.get_field_index("text")))
    s, e, first = T.words(buf, rows, T.PUNCT)
    if not len(s):
        return
    low = T.lower(buf)
    h = T.hashes(low, s, e)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
    cut = _U(64 - BITS)
    yield row, (T.mix(h) >> cut).astype(np.int64)
    for k in STEMS:
        far = e - s > k
        yield row[far], (T.mix(T.hashes(low, s[far], s[far] + k) + _U(k)) >> cut).astype(np.int64)
    for gap, salt in ((1, 3), (2, 5)):
        same = row[gap:] == row[:-gap]
        yield row[gap:][same], (T.mix(h[:-gap][same] * _U(salt) + h[gap:][same]) >> cut).astype(np.int64)


def _features(batches):
    """Per document its distinct slots as bytes of int32."""
    for b in T.slices(batches):
        keys = np.unique(np.concatenate([np.zeros(0, np.int64)] + [(row << BITS) | slot for row, slot in _slots(b)]))
        at = np.searchsorted(keys >> BITS, np.arange(b.num_rows + 1))
        slot = (keys & ((1 << BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([slot[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "slots"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and bias from the labelled rows whose crc32(doc_id) mod 5 is not 0.

    Null labels and ids are ignored; a doc_id labelled twice counts once, as toxic if either is.
    Without toxic training rows the bias is minus infinity (every score 0)."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.withColumn("order", F.xxhash64("doc_id"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not total.get(1):
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    st = Stage(docs.sparkSession, "toxic")
    toxic = known.where("toxic = 1").orderBy("order", "doc_id").limit(TOXIC_ROWS)
    clean = known.where("toxic = 0").orderBy("order", "doc_id").limit(CLEAN_ROWS)
    chosen = st.put(toxic.unionByName(clean).select("doc_id", "toxic"), "chosen")  # TOXIC_ROWS + CLEAN_ROWS at most
    rows = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    label = {r[0]: r[1] for r in chosen.collect()}
    # the driver reads a few parts one after another, each a job without Python code
    found = st.put(rows.mapInArrow(_features, "doc_id long, slots binary"), "features").coalesce(PARTS)

    def slots():
        return ((r["doc_id"], np.frombuffer(r["slots"], np.int32)) for r in found.toLocalIterator())

    seen = np.zeros(1 << BITS, np.int32)
    for i, x in slots():
        if label[i]:
            seen[x] += 1
    keep = seen >= min(INCLUDE, total[1])
    data = [(i, x[keep[x]]) for i, x in slots()]
    st.drop()
    data.sort(key=lambda x: x[0])
    n_toxic = sum(label[i] for i, _ in data)
    weigh = (total.get(0, 0) / max(1, len(data) - n_toxic)) / (total[1] / max(1, n_toxic))
    return _ftrl(data, label, weigh)


def _ftrl(data: list, label: dict, weigh: float) -> tuple[np.ndarray, np.ndarray, float]:
    bias = 1 << BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(x):
        zx = z[x]
        return np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + np.sqrt(n[x])) / ALPHA + L2))

    order = np.random.default_rng(20240229)
    for _ in range(EPOCHS):
        for k in order.permutation(len(data)):
            i, slots = data[k]
            x = np.append(slots, bias)
            w = weights(x)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - 1) if label[i] else p * weigh
            step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - step * w
            n[x] += g * g
    w = weights(np.arange(bias + 1))
    at = np.flatnonzero(w[:bias])
    return at, w[at], float(w[bias])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *keep: str) -> DataFrame:
    """``doc_id``, the columns named in ``keep`` and ``score`` of every document (empty: the bias alone)."""
    at, w, bias = model

    def run(batches):
        table = np.zeros(1 << BITS)
        table[at] = w
        for b in T.slices(batches):
            keys = [np.zeros(0, np.int64)]
            for row, slot in _slots(b):
                hit = table[slot] != 0
                keys.append((row[hit] << BITS) | slot[hit])
            keys = np.unique(np.concatenate(keys))
            sums = np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], b.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35))) if np.isfinite(bias) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in ("doc_id", *keep)] + [pa.array(np.round(p, 9))], names=["doc_id", *keep, "score"])

    cols = docs.select("doc_id", *keep, *([] if "text" in keep else ["text"]))
    kinds = dict(cols.dtypes)
    return cols.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in ("doc_id", *keep)) + ", score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, repeated ones included.

    Null texts count as empty; a null doc_id is never held out.  Columns other than doc_id and text are
    not read, so clashing names do no harm; an empty table gives an empty result.
    """
    src = plain_docs(docs)
    out = score(src, fit(src, labels))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
