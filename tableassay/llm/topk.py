"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers. Each block of candidate rows has one list per dimension,
sorted by value. For a query the lists are read in step, each from the end its
weight favours; rows met are scored whole. The sum of weight times value at the
depth reached bounds every row not met yet, and reading stops when the bound is
below the k-th score. The k-th score is carried from block to block of a task.

Queries go to the tasks in groups of bounded size (``query_rows``), each against all rows.

Defined cases: null vectors and vectors with a null or non-finite component take no
part; missing dimensions of shorter vectors count as 0; ties go to the smaller
vec_id, null last; a row is never its own result, but an equal row with the same id
is. Sums are exact: doubles hold them below 2^53, 64-bit integers below 2^63, as the
greatest component and the greatest length bound them; beyond that a ValueError says so.
An empty table gives no rows; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableassay.llm.shared import staged

K, EVERY, SCALE = 5, 50, 256
QUERY_ROWS = 4096
BLOCK_ROWS = 4096
_LAST = np.iinfo(np.int64).max


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v (array of long) of the vectors that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    parts = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(v.isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v"))


class Lists:
    """A block of rows with one sorted list per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.rows, self.ids, self.values = rows, ids, values
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)

    def better(self, query: np.ndarray, own: int, k: int, top: tuple) -> tuple:
        """``top`` (scores, ids, rows; best first) with this block's rows merged in."""
        n = len(self.rows)
        use = np.flatnonzero(query)
        weight, down = query[use], query[use] > 0
        met = self.rows == own
        depth, step = 0, 8
        while depth < n or not depth:
            to = min(n, depth + step)
            at = np.arange(depth, to)[:, None]
            at = np.where(down, n - 1 - at, at)
            fresh = np.zeros(n, bool) if len(use) else np.ones(n, bool)
            fresh[self.order[at, use]] = True
            new = np.flatnonzero(fresh & ~met)
            met |= fresh
            score = self.values[new] @ query
            if len(new):
                worst = top[0][-1] if len(top[0]) == k else -np.inf
                keep = score >= worst
                top = best(np.concatenate([top[0], score[keep]]), np.concatenate([top[1], self.ids[new[keep]]]), np.concatenate([top[2], self.rows[new[keep]]]), k)
            depth, step = to, step * 2
            if met.all():
                break
            bound = weight @ self.sorted[np.where(down, n - depth, depth - 1), use]
            if len(top[0]) == k and top[0][-1] > bound:
                break
        return top


def best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple:
    order = np.lexsort((rows, ids, -score))[:k]
    return score[order], ids[order], rows[order]


def _matrix(column: pa.Array, width: int, number: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    per = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(per), max(width, int(per.max(initial=0)))), number)
    out[np.repeat(np.arange(len(per)), per), np.arange(len(flat)) - np.repeat(np.cumsum(per) - per, per)] = flat
    return out


def exact_type(vectors: DataFrame) -> type:
    """The number type that holds every sum of products of two vectors."""
    low, high, size = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v"))).first()
    bound = max(abs(low or 0), abs(high or 0)) ** 2 * (size or 0)
    if bound >= 2**63:
        raise ValueError(f"components of up to {max(abs(low), abs(high))} in vectors of length {size}: a score may pass 64 bits")
    return np.float64 if bound < 2**53 else np.int64


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_row, query_id, rank, vec_id, score; both inputs as ``integers`` gives them, staged."""
    spark = vectors.sparkSession
    groups = max(1, -(-queries.count() // query_rows))
    number = exact_type(vectors.select("v").union(queries.select("v")))
    found = None
    for g in range(groups):
        asked = queries.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).collect()  # about query_rows
        shared = spark.sparkContext.broadcast([(r["row"], r["vec_id"], r["v"]) for r in asked])
        part = vectors.mapInArrow(_scan(shared, k, number), "query_row long, query_id long, vec_id long, score long, row long")
        part = staged(part, "topk-part") if groups > 1 else part
        found = part if found is None else found.union(part)
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def _scan(shared, k, number):
    def run(batches):
        asked = shared.value
        width = max((len(v) for _, _, v in asked), default=0)
        nothing = (np.zeros(0, number), np.zeros(0, np.int64), np.zeros(0, np.int64))
        tops = [nothing] * len(asked)
        weights = None
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(begin, BLOCK_ROWS)
                values = _matrix(piece.column(2), width, number)
                if weights is None or weights.shape[1] < values.shape[1]:
                    weights = np.zeros((len(asked), values.shape[1]), number)
                    for i, (_, _, v) in enumerate(asked):
                        weights[i, : len(v)] = v
                elif values.shape[1] < weights.shape[1]:
                    values = np.pad(values, ((0, 0), (0, weights.shape[1] - values.shape[1])))
                ids = piece.column(1).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
                lists = Lists(piece.column(0).to_numpy(), ids, values)
                for i, (row, _, _) in enumerate(asked):
                    tops[i] = lists.better(weights[i], row, k, tops[i])
        out = [(row, query, int(i) if i != _LAST else None, int(s), int(r)) for (row, query, _), top in zip(asked, tops, strict=True) for s, i, r in zip(*top, strict=True)]
        names = ["query_row", "query_id", "vec_id", "score", "row"]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(5)], names)

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every row whose vec_id is divisible by ``every``."""
    rows = staged(integers(vectors), "topk-rows")
    return search(rows, rows.where(F.col("vec_id") % every == 0), k).select("query_id", "rank", "vec_id", "score")
