"""Exact top-k inner products over integer vectors.

Every component x becomes floor(scale * x). The vectors are rotated by the
right singular vectors of the whole table (the eigenvectors of its Gram matrix,
which tasks add up exactly), so the first coordinates hold most of each length.
Each candidate batch is processed by descending length in slices. A query skips
a slice if its length times the slice's largest length, by Cauchy-Schwarz, stays
below its threshold: the k-th best score that it is sure to have. Otherwise the
first coordinates' partial product plus the product of the two residual lengths
bounds each score; only candidates that this bound lets pass are scored, in
integers. Thresholds start from the longest vectors and rise in each task.
Bounds are widened by more than rounding can take, so no result is lost.

Queries are taken in blocks of ``query_block``, a parameter; a block is what the
driver sends out, whatever the size of the table. Each task keeps k results for
each query of the block, and a window over these picks the last k.

Vectors that are null, empty or hold null or non-finite components take no part.
Vectors of unequal lengths are compared as if zeros followed the shorter one.
A null vec_id takes no part. Rows that repeat a vec_id count as one candidate,
with the best of their scores, and as one query, with their least vector. Fewer
than k candidates: all. An empty table gives an empty result. Only the two named
columns are read. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoengine.llm.common import batch_of, column
from geoengine.session import durable

#: Candidates that are pruned together.
SLICE = 512
#: Longest vectors that give the first thresholds.
PROBE = 2048


def valid(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return vector.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array<bigint>): the rows that take part."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale))
    return df.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, zeros after the shorter ones."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: by floating point where every partial sum is below 2^53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Columns: the right singular vectors of all rows, by falling singular value."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            m = _matrix(b.column(0), dims).astype(np.float64)
            total += m.T @ m
        yield batch_of(i=np.repeat(np.arange(dims), dims), j=np.tile(np.arange(dims), dims), x=total.ravel())

    out = np.zeros((dims, dims))
    for r in rows.select("v").mapInArrow(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r.i, r.j] = r.x
    values, vectors = np.linalg.eigh((out + out.T) / 2)
    return vectors[:, np.argsort(-values)]


class Best:
    """The k best (score, id) of each query, no id twice; ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k, self.floor = queries, k, floor.copy()
        self.lists: list[dict[int, int]] = [{} for _ in queries]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if ids.size > 4 * self.k:  # all that can be among the best, with every tie
            least = np.partition(scores, ids.size - self.k)[ids.size - self.k] if np.unique(ids).size == ids.size else None
            if least is not None:
                top = scores >= least
                ids, scores = ids[top], scores[top]
                order = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[order], scores[order]
        mine = self.lists[q]
        for i, s in zip(ids.tolist(), scores.tolist()):
            if mine.get(i, s - 1) < s:
                mine[i] = s
        if len(mine) > self.k:
            mine = self.lists[q] = dict(sorted(mine.items(), key=lambda x: (-x[1], x[0]))[: self.k])
        if len(mine) == self.k:
            self.floor[q] = max(self.floor[q], min(mine.values()))


def scan(ids: np.ndarray, v: np.ndarray, queries: dict, best: Best, turn: np.ndarray, head: int) -> None:
    """Score a batch of candidates against all queries, with pruning."""
    length = np.sqrt(np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64)))
    order = np.argsort(-length, kind="stable")
    ids, v, length = ids[order], v[order], length[order]
    rotated = v.astype(np.float64) @ turn[:, :head]
    rest = np.sqrt(np.maximum(0.0, length**2 - np.einsum("ij,ij->i", rotated, rotated)))
    for s in range(0, len(ids), SLICE):
        # an error of rounding is far below a millionth of the lengths' product
        reach = queries["length"] * length[s]
        active = np.flatnonzero(reach * (1 + 1e-6) + 1 >= best.floor)
        if not active.size:
            break
        c = slice(s, s + SLICE)
        bound = queries["head"][active] @ rotated[c].T + np.outer(queries["rest"][active], rest[c]) + (1e-6 * reach[active] + 1)[:, None]
        passes = (bound >= best.floor[active][:, None]) & (ids[c][None, :] != queries["id"][active][:, None])
        scored = np.flatnonzero(passes.any(axis=1))
        if not scored.size:
            continue
        some = np.flatnonzero(passes.any(axis=0))
        exact = products(queries["v"][active[scored]], v[c][some])
        for row, q in enumerate(active[scored].tolist()):
            got = np.flatnonzero(passes[scored[row]][some] & (exact[row] >= best.floor[q]))
            if got.size:
                best.add(q, ids[c][some[got]], exact[row][got])


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_block: int = 16_384, head: int = 24) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each row whose id is divisible by ``every``, with all other rows."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    schema = "query_id long, rank int, vec_id long, score long"
    rows = quantized(df, id_col, vector_col, scale)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return spark.createDataFrame([], schema)
    head = min(head, dims)
    turn = rotation(rows, dims)
    queries = durable(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    # longest first: a bounded number of rows, which give every block its first thresholds
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    probe = rows.orderBy(norm.desc(), "id").limit(PROBE).toArrow().combine_chunks()
    probe_ids, probe_v = probe["id"].to_numpy(), _matrix(pa.array(probe["v"].combine_chunks()), dims)
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for n in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        q = {"id": part["id"].to_numpy(), "v": _matrix(pa.array(part["v"].combine_chunks()), dims)}
        q["length"] = np.sqrt((q["v"].astype(np.float64) ** 2).sum(axis=1))
        q["head"] = q["v"].astype(np.float64) @ turn[:, :head]
        q["rest"] = np.sqrt(np.maximum(0.0, q["length"] ** 2 - (q["head"] ** 2).sum(axis=1)))
        first = Best(q["id"], k, np.full(part.num_rows, -(2**63), np.int64))
        scan(probe_ids, probe_v, q, first, turn, head)
        shared = sc.broadcast((q, first.floor, turn))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, floor, turn = shared.value
            best = Best(q["id"], k, floor)
            for b in batches:
                if b.num_rows:
                    scan(column(b, "id"), _matrix(b.column(1), dims), q, best, turn, head)
            out = [(q["id"][i], v, s) for i, own in enumerate(best.lists) for v, s in own.items()]
            ids, vecs, scores = zip(*out) if out else ((), (), ())
            yield batch_of(query_id=np.array(ids, np.int64), vec_id=np.array(vecs, np.int64), score=np.array(scores, np.int64))

        got = rows.mapInArrow(search, "query_id long, vec_id long, score long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], schema)
    # tasks may have scored rows that repeat a vec_id
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
