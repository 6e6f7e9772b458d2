"""Connected components of links kept as a DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop, written

#: Links that a task contracts in one go, and links for which there is one task more.
STEP_LINKS, TASK_LINKS = 1 << 20, 100_000
#: Nodes of many links whose minima are broadcast, at most.
HOT_NODES = 50_000
#: Links of a node that are not many.
FEW_LINKS = 64


class Forest:
    """Components of the numbers 0 to n - 1 as pairs of them are joined, for arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.run = np.arange(n)  # places of equal run are connected; brought up to date now and then
        self.label, self.since = self.parent.copy(), 0

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while (r != (up := self.parent[r])).any():
            r = up
        self.parent[x] = r
        return r

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Joins the pairs; places of those that connected two components."""
        a, b = self.roots(x), self.roots(y)
        some = np.flatnonzero(a != b)
        if not len(some):
            return some
        low, high = np.minimum(a[some], b[some]), np.maximum(a[some], b[some])
        _, one = np.unique(low * len(self.parent) + high, return_index=True)
        up: dict[int, int] = {}  # among the roots that these pairs join

        def top(k: int) -> int:
            while (p := up.get(k, k)) != k:
                up[k] = up.get(p, p)
                k = p
            return k

        kept = []
        for k in np.sort(one).tolist():
            p, q = top(int(low[k])), top(int(high[k]))
            if p != q:
                up[max(p, q)] = min(p, q)
                kept.append(k)
        for k in up:
            self.parent[k] = top(k)
        self.since += len(kept)
        if self.since * 32 >= max(2048, len(self.parent)):
            self.label = self.roots(np.arange(len(self.parent)))
            self.run = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
            self.since = 0
        return some[kept]

    def connected(self, a: np.ndarray, ae: np.ndarray, b: np.ndarray, be: np.ndarray) -> np.ndarray:
        """Whether all places a to ae and b to be, the ends not included, are known to be connected."""
        return (self.run[a] == self.run[ae - 1]) & (self.run[b] == self.run[be - 1]) & (self.label[a] == self.label[b])


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer links: each task joins what STEP_LINKS of its links connect and keeps one link a
    node."""

    def run(batches):
        held, n = [], 0

        def joined():
            u, v = (np.concatenate(x) for x in zip(*held))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            forest = Forest(len(nodes))
            forest.join(at[: len(u)], at[len(u) :])
            root = forest.roots(np.arange(len(nodes)))
            some = np.flatnonzero(root != np.arange(len(nodes)))
            for k in range(0, len(some), 1 << 16):
                few = some[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[few]), pa.array(nodes[root[few]])], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > STEP_LINKS:
                yield from joined()
                held, n = [], 0
        if n:
            yield from joined()

    return arrow_map(edges.select("u", "v"), run, "u long, v long")


def beside(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """rows (u, v) with m of their u in least (u, m, n), n being u's number of links. Nodes of many links, of which there
    are at most HOT_NODES, are broadcast, so that the rows of none of them meet in one task; the rest are shuffled."""
    many = max(FEW_LINKS, links // HOT_NODES + 1)
    hot = F.broadcast(least.where(F.col("n") >= many).select("u", F.col("m").alias("hot")))
    found = rows.join(hot, "u", "left")
    rest = found.where(F.col("hot").isNull()).select("u", "v").join(least.where(F.col("n") < many).select("u", "m"), "u")
    return found.where(F.col("hot").isNotNull()).select("u", "v", F.col("hot").alias("m")).unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Roots of linked nodes: (node, root), root the smallest node reachable; a node without links has no row.

    edges: (u, v) of long, in any direction, repeats allowed, no nulls. Tasks of some TASK_LINKS links first drop those that
    they do not need. Then large stars and small stars alternate, which end in one link from each node to its root after
    some log-many rounds; every round is written to the shared folder, so a lost executor repeats at most one. No node's
    links are gathered: minima are aggregated before the shuffle, and links of nodes that have many are not shuffled by
    node.
    """
    every = written(edges.select("u", "v"), name)
    now = written(contracted(every.coalesce(1 + every.count() // TASK_LINKS)), name)
    drop(every)
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if new == mark:
            break
        mark = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = beside(both.where("v > u"), least, 2 * new["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = beside(down, low, 2 * new["n"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, written(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(1 + new["n"] // TASK_LINKS), name)
        drop(last)
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ends)
