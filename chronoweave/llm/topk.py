"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

A block of vectors keeps each component's values as a sorted list.  A query reads every list from its
good end (the top for a positive weight, the bottom for a negative one), a further share a round.  What
has been read gives a vector a partial score; its lower bound adds the worst value of each list not yet
read for it, its upper bound the values at which the lists stand.  A query stops in a block once few
vectors outside its best k can reach the k-th lower bound, the k-th score of earlier blocks counting as
well; the scores of those left are then resolved.  Blocks grow from small to large, so that the first,
which is read to its end, soon gives a k-th score that stops the others.  Upper bounds of a round are one
matrix product for many queries: where a value lies beyond its list's place, the place stands for it.

Queries are staged in blocks of bounded size that tasks read from the shared folder; neither the driver
nor a closure holds them.  Each partition keeps k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Stage

QUERY_VALUES = 1 << 20  # query components of one pass (8 MB)
ROWS = 4096  # vectors whose lists are sorted together, at most
FIRST = 256  # vectors of the first block; each next one has twice as many
TOGETHER = 256  # queries whose bounds are held at once
ROUNDS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # share of each list read by the end of a round
FEW = 32  # a query stops when one in so many vectors is left


def quantise(vectors: DataFrame, key: str, value: str, scale: int = 1024) -> DataFrame:
    """``id`` and ``v``, floor(scale * x) of each component; vectors that are null or hold null or
    non-finite components are left out."""
    x = F.transform(F.col(value), lambda c: c.cast("double"))
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    given = vectors.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    given = given.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(fine)
    return given.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


class Lists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.sorted = ids, x, np.sort(x, axis=0)

    def best(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[list, np.ndarray]:
        """(scores, ids) that may be among each query's best k, ``floor`` being its k-th score so far, and
        the share of the lists that each query read."""
        n = len(self.ids)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        out, live, read = [None] * len(q), np.arange(len(q)), np.ones(len(q))
        mine = own[:, None] == self.ids
        for share in ROUNDS:
            t = max(1, int(np.ceil(share * n)))
            top, bottom = self.sorted[n - t], self.sorted[t - 1]  # where the lists stand
            u, d = up[live], down[live]
            high = u @ np.maximum(self.x, top).T + d @ np.minimum(self.x, bottom).T
            high[mine[live]] = -np.inf
            bar = floor[live]
            m = min(k, n)
            if m == k and (t == n or np.isneginf(bar).any()):
                low = high if t == n else u @ np.where(self.x >= top, self.x, self.sorted[0]).T + d @ np.where(self.x <= bottom, self.x, self.sorted[-1]).T
                low = np.where(mine[live], -np.inf, low)
                bar = np.maximum(bar, np.partition(low, n - m, axis=1)[:, n - m])
            may = (high >= bar[:, None]) & ~mine[live]
            done = (may.sum(axis=1) <= max(2 * k, n // FEW)) | (t == n)
            for r in np.flatnonzero(done):
                c = np.flatnonzero(may[r])
                score = high[r][c] if t == n else self.x[c] @ q[live[r]]  # final scores of the ones left
                out[live[r]] = score, self.ids[c]
            read[live[done]] = t / n
            live = live[~done]
            if not len(live):
                break
        return out, read


class Search:
    """The best k of each query over blocks of vectors, and the share of list entries read."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.scores, self.found = [np.zeros(0)] * len(q), [np.zeros(0, np.int64)] * len(q)
        self.floor, self.rows, self.read = np.full(len(q), -np.inf), 0, 0.0
        self.held, self.size = [], FIRST

    def block(self, own: np.ndarray, x: np.ndarray) -> None:
        lists = Lists(own, x)
        for a in range(0, len(self.q), TOGETHER):
            z = a + TOGETHER
            best, read = lists.best(self.q[a:z], self.ids[a:z], self.k, self.floor[a:z])
            self.rows, self.read = self.rows + len(read) * len(own), self.read + float(read.sum()) * len(own)
            for j, (s, i) in enumerate(best, a):
                s, i = np.concatenate([self.scores[j], s]), np.concatenate([self.found[j], i])
                keep = np.lexsort((i, -s))[: self.k]
                self.scores[j], self.found[j] = s[keep], i[keep]
                if len(keep) == self.k:
                    self.floor[j] = s[keep[-1]]

    def add(self, own: np.ndarray, x: np.ndarray, last: bool = False) -> None:
        """Take vectors; blocks double up to ROWS."""
        self.held.append((own, x))
        if last or sum(len(h[0]) for h in self.held) >= self.size:
            own, x = (np.concatenate(c) for c in zip(*self.held, strict=True))
            a = 0
            while len(own) - a >= self.size or (last and a < len(own)):
                self.block(own[a: a + self.size], x[a: a + self.size])
                a, self.size = a + self.size, min(ROWS, 2 * self.size)
            self.held = [(own[a:], x[a:])]


def _matrix(v: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``width`` numbers as rows, and which they are."""
    size = np.diff(np.asarray(v.offsets))
    same = size == width
    return np.asarray(v.flatten())[np.repeat(same, size)].reshape(-1, width), same


def _search(path: str, width: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        from pyarrow import fs, parquet

        store, place = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:") and "://" not in path else path)
        if store.get_file_info(place).type == fs.FileType.NotFound:  # no query fell into this block
            return
        rows = parquet.read_table(place, filesystem=store, partitioning=None).combine_chunks()
        if not rows.num_rows:
            return
        search = Search(rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks(), width)[0], k)
        search.add(np.zeros(0, np.int64), np.zeros((0, width)))
        for b in batches:
            x, same = _matrix(b.column("v"), width)
            search.add(b.column("id").to_numpy()[same], x)
        search.add(np.zeros(0, np.int64), np.zeros((0, width)), last=True)
        n = [len(s) for s in search.scores]
        cols = np.repeat(search.ids, n), np.concatenate(search.found), np.concatenate(search.scores).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return run


def top_k(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows, other than its own, of each query (the rows
    whose id ``every`` divides), ties to the smaller id; fewer rows than k give all.

    Only vectors of one length are compared.  Repeated ids are candidates row by row and one query; rows
    without an id take no part.  Other columns are ignored; an empty table gives an empty result.  Sums
    are exact while they stay below 2**53.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "topk")
    src = quantise(vectors, key, value)
    queries = src.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = stage.put(queries.withColumn("d", F.size("v")), "queries")
    sizes = queries.groupBy("d").count().collect()  # a row for each length of vector
    schema = "query_id long, vec_id long, score long"
    out = spark.createDataFrame([], schema)
    for d, count in ((r["d"], r["count"]) for r in sizes if r["d"]):
        blocks = 1 + d * count // QUERY_VALUES
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
        stage.put(queries.where(F.col("d") == d).select("id", "v", block).repartition("block"), f"d{d}", "block")
        for b in range(blocks):
            path = f"{stage.path(f'd{d}')}/block={b}"
            out = out.unionByName(src.mapInArrow(_search(path, d, k), schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
