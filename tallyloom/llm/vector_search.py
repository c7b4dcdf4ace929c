"""Exact top-k search with multi-resolution segment statistics.

Vectors are cut into segments, first few, then more, and each segment keeps its mean and standard
deviation. For two segments of n values the squared distance is at least
n ((mean - mean)^2 + (dev - dev)^2); with the norms, that bounds the inner product from above by
n (mean mean + dev dev). Candidates whose bound falls short of the k-th score found so far go, coarse
to fine, and the survivors are scored exactly.

Rows are dealt into blocks of a bounded size by a hash of their id, and the stated queries visit
every block; the block results, k rows a query, are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = (1, 4, 16)
BLOCK_ROWS = 50_000
#: Queries bounded at once against a block.
TOGETHER = 64


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations by segment, each times the root of the segment's length."""
    parts = np.array_split(np.arange(x.shape[1]), max(1, min(segments, x.shape[1])))
    if not x.shape[1]:  # empty vectors: one segment without a value
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    mean = np.stack([x[:, p].mean(axis=1) * np.sqrt(len(p)) for p in parts], axis=1)
    dev = np.stack([x[:, p].std(axis=1) * np.sqrt(len(p)) for p in parts], axis=1)
    return mean, dev


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers held as doubles; sums that doubles cannot hold are made of Python's integers."""
    if not x.size or not q.size or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**53:
        return (x @ q.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in q]
    most = 2**63 - 1
    made = [[max(-most - 1, min(most, sum(int(a) * b for a, b in zip(row, other, strict=True)))) for other in whole] for row in x]
    return np.array(made, dtype=np.int64).reshape(len(x), len(q))


class Block:
    """Rows of one block and one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.levels = [np.concatenate(statistics(x, s), axis=1) for s in SEGMENTS]
        self.norms = np.sqrt((x * x).sum(axis=1))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """query id, row id and score: the k best rows for each query, ties to the smaller id.

        All queries given go through the levels together: a row stays as long as one of them may
        still need it, and each level's bounds and the exact scores are one matrix product.
        """
        stats = [np.concatenate(statistics(q, s), axis=1) for s in SEGMENTS]
        slack = 1e-9 * self.norms[None, :] * np.sqrt((q * q).sum(axis=1))[:, None] + 1e-6  # for rounding
        others = ids[:, None] != self.ids[None, :]
        bound = np.where(others, stats[0] @ self.levels[0].T + slack, -np.inf)
        # the rows of greatest bound give a score that the k best do not fall short of
        first = np.argpartition(-bound, min(4 * k, bound.shape[1] - 1), axis=1)[:, : 4 * k]
        least = np.full(len(q), -np.inf)
        for i, mine in enumerate(first):
            mine = mine[others[i, mine]]
            if len(mine) >= k:
                least[i] = np.sort(exact(self.x[mine], q[i : i + 1])[:, 0])[-k]
        alive = others & (bound >= least[:, None])
        left = np.flatnonzero(alive.any(axis=0))
        for level, mine in zip(self.levels[1:], stats[1:], strict=True):
            stays = alive[:, left] & (mine @ level[left].T + slack[:, left] >= least[:, None])
            alive[:, left] = stays
            left = left[stays.any(axis=0)]
        scores = exact(self.x[left], q)
        for i, own in enumerate(ids.tolist()):
            mine = np.flatnonzero(alive[i, left])
            score = scores[mine, i]
            if len(score) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                mine, score = mine[near], score[near]
            names = self.ids[left[mine]]
            for b in np.lexsort((names, ~score))[:k]:
                yield own, int(names[b]), int(score[b])


def _by_length(column: pa.Array, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of some rows of a column of lists, those of each length: their places and a matrix."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    starts = offsets[:-1][at]
    sizes = offsets[1:][at] - starts
    for size in np.unique(sizes).tolist():
        mine = sizes == size
        yield at[mine], values[starts[mine][:, None] + np.arange(size)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", values: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of greatest inner product for each query.

    Every component x counts as floor(scale * x). All rows but the query's own (by id) are candidates,
    rows of equal id or equal values each for itself; ties go to the smaller id, and fewer candidates
    give fewer rows. Vectors that are null or hold a null or non-finite component, and rows without
    an id take no part; vectors meet only those of their own length, empty ones with a score of 0. Of
    queries of equal id the least vector asks. Scores beyond a long are held to its ends. Empty
    tables give an empty result; other columns are not read.

    Every query visits every block, so queries x blocks rows are shuffled. A task holds the rows of
    one block, at most about ``block_rows``, and answers ``TOGETHER`` queries at a time as they come.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        made = F.transform(values, lambda x: F.lit(float(scale)) * x.cast("double"))
        return df.filter(F.col(vec_id).isNotNull() & F.col(values).isNotNull()).filter(sound).select(F.col(vec_id).cast("long").alias("vec_id"), made.alias("x"))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, -(-vectors.count() // block_rows))
    rows = whole(vectors).select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "vec_id", "x")
    asked = whole(queries).groupBy("vec_id").agg(F.min("x").alias("x")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "vec_id", "x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, made, asked = None, {}, {}, {}

        def answer(size: int) -> list[tuple[int, int, int]]:
            """What the waiting queries of one length find."""
            ids, q = (np.concatenate(x) for x in zip(*asked.pop(size), strict=True))
            if size not in made and size in rows:
                made[size] = Block(*(np.concatenate(x) for x in zip(*rows.pop(size), strict=True)))
            return [t for at in range(0, len(q), TOGETHER) for t in made[size].search(ids[at : at + TOGETHER], q[at : at + TOGETHER], k)] if size in made else []

        def put(found: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        for b in batches:
            block, query, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero((block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
            for at in np.split(np.arange(len(block)), edges):
                if not len(at):
                    continue
                if block[at[0]] != now:
                    for size in list(asked):
                        yield from put(answer(size))
                    now, rows, made = block[at[0]], {}, {}
                for some, x in _by_length(b.column(3), at):
                    size = x.shape[1]
                    (asked if query[at[0]] else rows).setdefault(size, []).append((ids[some], np.floor(x)))
                    if query[at[0]] and sum(len(i) for i, _ in asked[size]) >= TOGETHER:
                        yield from put(answer(size))
        for size in list(asked):
            yield from put(answer(size))

    dealt = rows.union(asked).repartition(partitions, "block").sortWithinPartitions("block", "query", "vec_id")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
