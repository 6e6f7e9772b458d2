"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, drop, written

#: Bytes of the queries that the driver and each task hold at once; they are selected together, in one set of passes.
QUERY_BYTES = 1 << 24
#: Bins a query's score range is parted into in a round.
BINS = 1024
#: Candidate vectors of a step, and queries that they are scored against at once.
STEP_ROWS, TILE = 4096, 256
#: Candidate vectors that a task holds while it goes through the queries.
HELD_ROWS = 1 << 16


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite components; v are floor(scale * x) as longs."""
    wide = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the batch's rows of the dimension, STEP_ROWS at a time."""
    ids, vecs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
    flat, offsets = vecs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    rows = np.flatnonzero(sizes == dim)
    for at in range(0, len(rows), STEP_ROWS):
        some = rows[at : at + STEP_ROWS]
        yield ids[some], flat[offsets[some][:, None] + np.arange(dim)]


def scored(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, queries by candidates, of matrices of floats where sums stay under 2**53, else of integers."""
    got = q @ c.T
    return got if got.dtype == np.int64 else got.astype(np.int64)


def held(batches: Iterator[pa.RecordBatch], dim: int, exact_float: bool) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Ids and vectors of the dimension, in steps, HELD_ROWS at a time."""
    out, n = [], 0
    for batch in batches:
        for c, v in matrices(batch, dim):
            out.append((c, v.astype(float) if exact_float else v))
            n += len(c)
            if n >= HELD_ROWS:
                yield out
                out, n = [], 0
    if out:
        yield out


def top_k(df: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query: Column | None = None, scale: int = 256) -> DataFrame:
    """For each query row its k highest integer inner products with other rows: query_id, rank, vec_id, score.

    Vectors are floor(scale * x). Queries: rows where query holds (default: id divisible by 50); candidates: every other
    row of equal dimension. Ties go to the smaller id; fewer candidates than k give fewer rows; null ids, null vectors,
    and vectors with null or non-finite components take no part; a repeated row is a candidate each time, but a query
    only once per id and vector, and never of its own id.

    The queries go in blocks of QUERY_BYTES. Per block, all candidates are scored and counted in BINS bins over each query's
    range; the bin where the kth value lies becomes the range of the next round, until bins have width 1. A task sends of
    its counts only those bins that its k best reach. Then all rows are scored again, and each task keeps at most its k
    best at or above the kth value, ties by id; a window over at most k rows a task and query ends the selection. A
    block's result is written, so neither the plan nor what the driver holds grows with the queries.
    """
    spark = df.sparkSession
    query = F.col("vec_id") % 50 == 0 if query is None else query
    vectors = written(quantised(df, id_col, vec_col, scale), "vectors")
    shape = vectors.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("m"), F.max(F.size("v")).alias("d")).first()
    largest, widest = shape["m"] or 0, shape["d"] or 0
    if largest * largest * max(widest, 1) >= 1 << 63:
        raise OverflowError("scores may leave 64 bits")
    exact_float = largest * largest * max(widest, 1) < 1 << 53
    asked = written(vectors.where(query).distinct().withColumn("n", F.size("v")), "queries")
    out = None
    for dim, number in sorted((r["n"], r["c"]) for r in asked.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()):  # a row per dimension
        most = max(1, QUERY_BYTES // (8 * max(dim, 1)))
        blocks = -(-number // most)
        mine = asked.where(F.col("n") == dim)
        for b in range(blocks):
            rows = mine.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).select("vec_id", "v").toArrow()
            for at in range(0, rows.num_rows, most):
                some = rows.slice(at, most).combine_chunks()
                q = np.array(some["v"].combine_chunks().flatten(), np.int64).reshape(some.num_rows, dim)
                got = selected(vectors, np.array(some["vec_id"]), q, k, largest, exact_float)
                got = got if blocks == 1 and out is None else written(got, "best")
                out = got if out is None else out.unionByName(got)
    drop(asked)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def selected(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, largest: int, exact_float: bool) -> DataFrame:
    """top_k for one block of queries."""
    spark, dim = vectors.sparkSession, q.shape[1]
    share = spark.sparkContext.broadcast((ids, q.astype(float) if exact_float else q))  # at most QUERY_BYTES
    bound = int(np.abs(q).sum(axis=1).max()) * largest if q.size else 0
    low = np.full(len(ids), -bound, np.int64)
    span = 2 * bound + 1
    above = np.zeros(len(ids), np.int64)  # scores over the range
    active = np.arange(len(ids))
    while True:
        width = -(-span // BINS)
        state = spark.sparkContext.broadcast((active, low[active], span, above[active]))

        def counts(batches, state=state, width=width):
            rows, lo, size, over = state.value
            qi, qv = (x[rows] for x in share.value)
            for steps in held(batches, dim, exact_float):
                for t in range(0, len(rows), TILE):
                    tile = slice(t, t + TILE)
                    n = len(qi[tile])
                    found = np.zeros((n, BINS), np.int64)
                    for c, v in steps:
                        s = scored(qv[tile], v) - lo[tile, None]
                        ok = (s >= 0) & (s < size) & (qi[tile, None] != c[None, :])
                        found += np.bincount((s // width + np.arange(n)[:, None] * BINS)[ok], minlength=n * BINS).reshape(-1, BINS)
                    # bins under a task's own kth best of the range cannot hold the kth best of all
                    need = (k - over[tile])[:, None]
                    reach = np.cumsum(found[:, ::-1], axis=1)[:, ::-1] - found < need
                    i, j = np.nonzero((found > 0) & reach)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[tile][i].astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(found[i, j]), pa.array(need[i, 0])], ["q", "bin", "n", "need"])

        binned = arrow_map(vectors.select("vec_id", "v"), counts, "q int, bin int, n long, need long").groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        reached = binned.withColumn("to", F.sum("n").over(down))
        # one row a query of the block
        hit = reached.where(F.col("to") >= F.col("need")).groupBy("q").agg(F.max(F.struct("bin", "n", "to")).alias("h")).select("q", "h.bin", "h.n", "h.to").toArrow()
        state.destroy()
        of, at, n, to = (np.array(hit[c], np.int64) for c in ("q", "bin", "n", "to"))
        low[of] += at * width
        above[of] += to - n
        # a query of fewer than k candidates keeps its whole range
        active = np.sort(of)
        if width == 1 or not len(active):
            break
        span = width
    kth = spark.sparkContext.broadcast(low)

    def best(batches):
        lo, (qi, qv) = kth.value, share.value
        for steps in held(batches, dim, exact_float):
            for t in range(0, len(qi), TILE):
                tile = slice(t, t + TILE)
                held_s, held_c, held_q = [], [], []
                for c, v in steps:
                    s = scored(qv[tile], v)
                    i, j = np.nonzero((s >= lo[tile, None]) & (qi[tile, None] != c[None, :]))
                    held_s, held_c, held_q = first(k, [*held_s, s[i, j]], [*held_c, c[j]], [*held_q, i + t])
                if len(held_s[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(qi[held_q[0]]), pa.array(held_c[0]), pa.array(held_s[0]), pa.array(held_q[0].astype(np.int32))], ["query_id", "vec_id", "score", "q"])

    kept = arrow_map(vectors.select("vec_id", "v"), best, "query_id long, vec_id long, score long, q int")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first(k: int, scores: list[np.ndarray], ids: list[np.ndarray], queries: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Each query's k highest scores, ties to the smaller id."""
    s, c, i = np.concatenate(scores), np.concatenate(ids), np.concatenate(queries)
    order = np.lexsort((c, -s, i))
    s, c, i = s[order], c[order], i[order]
    new = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    keep = place < k
    return [s[keep]], [c[keep]], [i[keep]]
