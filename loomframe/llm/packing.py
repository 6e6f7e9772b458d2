"""Packing documents into sequences: length patterns fitted by non-negative least squares, then best fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Encoder, crc, local, stream, text_bytes, tokenizer_path, written


def patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs and triples of occurring lengths that fill a sequence exactly, as rows of three (0: none)."""
    lengths = np.flatnonzero(counts[:capacity])
    lengths = lengths[lengths > 0]
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    a = lengths[lengths * 2 <= capacity]
    a = a[have[capacity - a]]
    out = [np.stack([np.zeros_like(a), a, capacity - a], 1)]
    for x in lengths[lengths * 3 <= capacity]:
        y = lengths[(lengths >= x) & (lengths * 2 <= capacity - x)]
        y = y[have[capacity - x - y]]
        out.append(np.stack([np.full_like(y, x), y, capacity - x - y], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def nnls(rows: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 300) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - counts|, A having a one per length of a pattern; accelerated projected gradient."""
    target = counts[:capacity].astype(float)
    target[0] = 0

    def times(x):
        got = sum(np.bincount(rows[:, j], x, capacity) for j in range(3))
        got[0] = 0
        return got

    def back(r):
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(times(v))
        size = np.linalg.norm(v)
        v /= size or 1
    step = 1 / (1.05 * size + 1e-9)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


#: Shares of the fitted counts that plans are tried with; the rest is left to best fit.
SHARES = (1.0, 0.5, 0.2)


def plan(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Sequences for counts[n] pieces of each length n <= capacity: (lengths, how many such), and their number.

    Full pieces stand alone. Patterns whose longest piece takes at least half a sequence get a share of their fitted
    counts, rounded, as far as pieces last; best fit packs the rest. The share that needs the fewest sequences wins.
    Bounded by the capacity, not by the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    whole = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(left, capacity)
    rows = rows[rows.max(axis=1) * 2 >= capacity] if len(rows) else rows
    fit = nnls(rows, left, capacity) if len(rows) else np.zeros(0)
    best = min((whole + filled(rows, fit * share, left, capacity) for share in SHARES), key=lambda made: sum(k for _, k in made))
    return best, sum(k for _, k in best)


def filled(rows: np.ndarray, fit: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences by the fitted counts of patterns, then by best fit of decreasing lengths, whole classes of equal
    sequences at a time."""
    left, fit, out = counts.copy(), fit.copy(), []
    for rounding in (0.0, 0.5):
        for k in np.argsort(-fit, kind="stable"):
            want = int(fit[k] + rounding)
            if want <= 0:
                break
            lens = tuple(int(n) for n in rows[k] if n)
            need = {n: lens.count(n) for n in lens}
            times = min(want, *(int(left[n]) // m for n, m in need.items()))
            if times > 0:
                out.append((lens, times))
                fit[k] -= times
                for n, m in need.items():
                    left[n] -= m * times
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # open sequences by what is free in them, in classes
    for n in range(capacity - 1, 0, -1):
        m = int(left[n])
        for room in sorted(k for k in free if k >= n):
            while m and free.get(room):
                lens, times = free[room].pop()
                each = min(room // n, -(-m // times))  # pieces that each of these sequences takes
                used = min(times, m // each)
                put(free, room, lens, times - used)
                put(free, room - each * n, (*lens, *[n] * each), used)
                m -= each * used
            if not m:
                break
        each = capacity // n
        put(free, capacity - each * n, (n,) * each, m // each)
        if m % each:
            put(free, capacity - m % each * n, (n,) * (m % each), 1)
    return out + [c for classes in free.values() for c in classes]


def put(free: dict, room: int, lens: tuple[int, ...], times: int) -> None:
    if times:
        free.setdefault(room, []).append((lens, times))


def runs(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """By (length, rank of a piece among its length): the sequence and the place in it, as runs sorted by key."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, seq = [], 0
    for lens, times in made:
        at = 0
        for n in sorted(set(lens), reverse=True):
            for _ in range(lens.count(n)):
                rows.append(((n << 44) + int(taken[n]), seq, at))
                taken[n] += times
                at += n
        seq += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return {"key": a[:, 0], "seq": a[:, 1], "at": a[:, 2]}


def token_pieces(docs: DataFrame, capacity: int, end_id: int, id_col: str, text_col: str, tokenizer: str, keep_ids: bool) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, the task that made it and its rank
    among that task's pieces of its length (and its ids as little-endian 32-bit integers if keep_ids)."""

    def step(cols, state):
        ids, ends = Encoder.of(tokenizer_path(tokenizer)).encode(text_bytes(cols[1]))
        ids = np.insert(ids, ends[1:], end_id).astype("<u4")
        sizes = np.diff(ends) + 1
        edges = np.concatenate([[0], np.cumsum(sizes)])
        number = -(-sizes // capacity)
        of = np.repeat(np.arange(len(sizes)), number)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
        first = sizes - (number - 1) * capacity  # only the first piece may be shorter
        start = np.where(piece, first[of] + (piece - 1) * capacity, 0)
        length = np.where(piece, capacity, first[of])
        at = edges[of] + start
        crcs = [crc(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
        seen = state.setdefault("seen", np.zeros(capacity + 1, np.int64))
        order = np.argsort(length, kind="stable")
        by = length[order]
        new = np.concatenate([[True], by[1:] != by[:-1]])
        began = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        rank = np.empty(len(by), np.int64)
        rank[order] = np.arange(len(by)) - began + seen[by]
        seen += np.bincount(length, minlength=capacity + 1)
        out = [cols[0].take(pa.array(of)), piece.astype(np.int32), start, length, pa.array(crcs, pa.int64()), np.full(len(of), TaskContext.get().partitionId(), np.int32), rank]
        return out + ([pa.array([ids[a:b].tobytes() for a, b in zip(at.tolist(), (at + length).tolist())], pa.binary())] if keep_ids else [])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * keep_ids
    return stream(docs, step, [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")], schema)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """Packs all documents into few sequences of at most capacity tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids if keep_ids).

    Every document's ids end with end_id; a null text is empty and gives that id alone. Only documents over the
    capacity are cut, into pieces of the capacity, the first shorter if need be. Repeated rows are packed each. The
    driver sees the histogram of at most capacity lengths and returns runs of ranks; pieces are then numbered by their
    rank among their length, from counts per task, so neither a hot length nor the number of pieces meets in one task.
    """
    pieces = written(token_pieces(docs, capacity, end_id, id_col, text_col, tokenizer, keep_ids), "pieces")
    spark = docs.sparkSession
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    table = runs(plan(counts, capacity)[0], capacity)
    shared = spark.sparkContext.broadcast(table)  # bounded by the patterns of a capacity
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a (task, length) has at most the rows that one task made
    ranked = pieces.join(bases, ["task", "length"])

    def place(cols, state):
        t = local(shared)
        length, rank = (c.to_numpy(zero_copy_only=False) for c in cols[:2])
        key = (length << 44) + rank
        i = np.searchsorted(t["key"], key, "right") - 1
        return [*cols[2:], cols[0], t["seq"][i] + key - t["key"][i], t["at"][i]]

    more = ["ids"] if keep_ids else []
    kinds = dict(pieces.dtypes)
    cols = ["doc_id", "piece", "start", "ids_crc32", *more]
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", length long, sequence_id long, offset long"
    placed = stream(ranked, place, [F.col("length"), F.col("rank") + F.col("base"), *map(F.col, cols)], schema)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more)
