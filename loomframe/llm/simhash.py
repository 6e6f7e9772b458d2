"""SimHash fingerprints, and near-duplicates by a self-join of binary tries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import STEP_BYTES, arrow_map, gathered, stream, text_bytes, written
from .components import Forest, components

#: The bits of each byte, one to a byte of a 64-bit integer.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]

#: Shingles whose bits are summed in one go.
HELD_SHINGLES = 1 << 17

#: A bucket of fingerprints is parted once more beyond so many, as long as LEVELS has more parts.
HOT_BUCKET = 2048

#: Bits that are not yet agreed on, and bits of each of the four parts of which one must agree, level by level.
LEVELS = ((64, 16), (48, 12), (36, 9))

#: Node pairs that one step of the traversal may hold, pairs of keys that are compared in one go, and links of a batch.
FRONTIER, COMPARED, BATCH_LINKS = 1 << 16, 1 << 20, 1 << 16

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text, in lists of about STEP_BYTES of it that overlap by size - 1 words."""
    at, last = 0, []
    while at < len(text):
        cut = SPACE.search(text, at + STEP_BYTES) if len(text) - at > STEP_BYTES else None
        end = cut.start() if cut else len(text)
        w = last + text[at:end].lower().split()
        yield w
        at, last = end, w[max(0, len(w) - size + 1) :]


def fingerprints(texts: list[bytes], size: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased, shingles of size words with repeats (the
    whole sequence if it has fewer, none if empty), a bit set where over half of the shingles' XXH64 have it."""
    digest = partial(xxh64_intdigest, seed=seed)
    hashes: list[int] = []
    runs: list[tuple[int, int]] = []
    counts, ones = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    for i, text in enumerate(texts):
        w: list[bytes] = []
        for w in word_runs(text, size):
            n = len(w) - size + 1
            if n > 0:
                hashes += map(digest, map(b" ".join, zip(*(w[j:] for j in range(size)))))
                runs.append((i, n))
                counts[i] += n
                if len(hashes) > HELD_SHINGLES:
                    add_bits(ones, hashes, runs)
                    hashes, runs = [], []
        if w and not counts[i]:
            hashes.append(digest(b" ".join(w)))
            runs.append((i, 1))
            counts[i] = 1
    add_bits(ones, hashes, runs)
    return np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def add_bits(ones: np.ndarray, hashes: list[int], runs: list[tuple[int, int]]) -> None:
    """Adds to ones how many hashes of each text have each bit. runs: texts, and numbers of consecutive hashes of each."""
    if not hashes:
        return
    lanes = LANES[np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)]
    text, n = np.array(runs, np.int64).T
    # parts of at most 255 hashes, so that a lane of 8 bits holds their sum
    begin, number = np.cumsum(n) - n, -(-n // 255)
    of = np.repeat(np.arange(len(n)), number)
    k = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    sums = np.add.reduceat(lanes, begin[of] + 255 * k, axis=0).view(np.uint8)
    np.add.at(ones, text, np.add.reduceat(sums, np.flatnonzero(k == 0), axis=0, dtype=np.int64))


def trie_pairs(keys: np.ndarray, depth: int, budget: int, forest: Forest | None = None):
    """Pairs (i, j), i < j, of the sorted 64-bit keys that agree in the first depth bits and differ in at most budget
    bits, as arrays.

    A node of the binary trie is a range of keys with one prefix. Pairs of nodes are traversed together, a level at a
    time, with the differing bits so far; a pair beyond the budget is dropped, and a pair of few keys is compared key by
    key. A step holds at most FRONTIER pairs; what is above waits on a stack. With a forest, only pairs that connect what
    the pairs so far do not are given, and node pairs whose keys are all connected are dropped.
    """
    n = len(keys)
    if n < 2:
        return
    roots = np.flatnonzero(np.concatenate([[True], keys[1:] >> np.uint64(64 - depth) != keys[:-1] >> np.uint64(64 - depth)]))
    ends = np.append(roots[1:], n)
    more = ends - roots > 1
    r, e = roots[more], ends[more]
    todo = [(63 - depth, r, e, r, e, np.zeros(len(r), np.int8))]
    while todo:
        bit, a, ae, b, be, err = todo.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            todo += [(bit, *(x[half:] for x in (a, ae, b, be, err))), (bit, *(x[:half] for x in (a, ae, b, be, err)))]
            continue
        if forest is not None:
            apart = ~forest.connected(a, ae, b, be)
            a, ae, b, be, err = (x[apart] for x in (a, ae, b, be, err))
        few = ((ae - a) * (be - b) <= 64) | (bit < 0)
        if few.any():
            for i, j in compared(keys, a[few], ae[few], b[few], be[few], budget):
                if forest is not None:
                    new = forest.join(i, j)
                    i, j = i[new], j[new]
                yield i, j
            a, ae, b, be, err = (x[~few] for x in (a, ae, b, be, err))
        if not len(a):
            continue
        am, bm = split(keys, a, ae, bit), split(keys, b, be, bit)
        same = a == b
        parts = [(a, am, b, bm, err), (am, ae, bm, be, err), (a, am, bm, be, err + 1)]
        other = ~same
        parts.append((am[other], ae[other], b[other], bm[other], err[other] + 1))
        a, ae, b, be, err = (np.concatenate(x) for x in zip(*parts))
        keep = (a < ae) & (b < be) & (err <= budget) & ~((a == b) & (ae - a < 2))
        todo.append((bit - 1, *(x[keep] for x in (a, ae, b, be, err))))


def split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys of each range begin to have the bit, by bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (keys[np.minimum(mid, len(keys) - 1)] >> np.uint64(bit)) & np.uint64(1) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def compared(keys, a, ae, b, be, budget):
    """Pairs within the budget of each range of a against the range of b."""
    step = COMPARED // 64
    for at in range(0, len(a), step):
        s = slice(at, at + step)
        w = be[s] - b[s]
        i = gathered(a[s], ae[s] - a[s])
        own = np.repeat(np.arange(len(w)), ae[s] - a[s])
        j = gathered(b[s][own], w[own])
        i = np.repeat(i, w[own])
        ok = i < j
        i, j = i[ok], j[ok]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        if near.any():
            yield i[near], j[near]


def rotated(x: np.ndarray, by: int, width: int = 64) -> np.ndarray:
    """x rotated left within its lowest width bits; bits above stay."""
    if not by:
        return x
    mask = np.uint64((1 << width) - 1)
    low = x & mask
    return (x & ~mask) | ((low << np.uint64(by)) & mask) | (low >> np.uint64(width - by))


def paths() -> list[list[int]]:
    """The parts that agree, level by level, by number of a path: those of one level, then those of two, and so on."""
    out, last = [], [[]]
    for _ in LEVELS:
        last = [[*p, j] for p in last for j in range(4)]
        out += last
    return out


def turned(c: Column, by: int, width: int) -> Column:
    """Column c rotated left by some bits in its lowest width bits, the bits above kept."""
    if not by:
        return c
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    mask = (1 << width) - 1
    low = c.bitwiseAND(F.lit(signed(mask)))
    out = F.shiftleft(low, by).bitwiseAND(F.lit(signed(mask))).bitwiseOR(F.shiftrightunsigned(low, width - by))
    return out if width == 64 else c.bitwiseAND(F.lit(signed(((1 << 64) - 1) ^ mask))).bitwiseOR(out)


def bucketed(prints: DataFrame) -> DataFrame:
    """path, key, lead of each fingerprint in each bucket that it goes to: the key has the bits that a path's parts agree on
    first, and these lead.

    Of four parts of the bits at most three can differ, so each fingerprint goes to four tries, turned so that one part
    leads. A bucket of over HOT_BUCKET fingerprints is parted again, by its other bits, at each further level.
    """
    number = {tuple(p): k for k, p in enumerate(paths())}

    def parted(rows: DataFrame, level: int) -> DataFrame:
        """rows with a path of level parts, each to the four paths of one part more."""
        width, size = LEVELS[level]
        first = number[(0,) * (level + 1)]
        begin = number[(0,) * level] if level else 0
        copies = F.explode(F.array(*(F.struct(((F.col("path") - begin) * 4 + (first + j)).cast("int").alias("path"), turned(F.col("key"), size * j, width).alias("key")) for j in range(4))))
        return rows.select(copies.alias("c")).select("c.path", "c.key", F.shiftrightunsigned("c.key", width - size).alias("lead"))

    out, rows = None, parted(prints.select(F.lit(0).alias("path"), F.col("fp").alias("key")), 0)
    for level in range(1, len(LEVELS)):
        # hot buckets are at most 1 / HOT_BUCKET of the rows; Spark broadcasts them if they are small
        hot = rows.groupBy("path", "lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("path", "lead", F.lit(True).alias("hot"))
        rows = rows.join(hot, ["path", "lead"], "left")
        cold = rows.where(F.col("hot").isNull()).select("path", "key", "lead")
        out = cold if out is None else out.unionByName(cold)
        rows = parted(rows.where(F.col("hot")), level)
    return out.unionByName(rows)


def linked(prints: DataFrame, budget: int = 3, spanning: bool = False) -> DataFrame:
    """Links (u, v), u < v as signed longs, between different fingerprints (column fp, distinct) of at most budget (0 to 3)
    differing bits: all of them, each once; or, spanning, so many in each bucket that its links' components stay the
    same, which are fewer than its fingerprints.

    A pair counts only in the first of the buckets that it shares. A task holds the fingerprints of its buckets, and
    gives links in batches of at most BATCH_LINKS. An empty table gives no links.
    """
    if not 0 <= budget <= 3:
        raise ValueError("the parts hold for a budget of 0 to 3")
    known = paths()

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches if b.num_rows]
        if not held:
            return
        path, key = (np.concatenate(x) for x in zip(*held))
        del held
        for p in np.unique(path).tolist():
            mine, parts = np.unique(key[path == p]), known[p]
            depth = sum(size for _, size in LEVELS[: len(parts)])
            for i, j in trie_pairs(mine, depth, budget, Forest(len(mine)) if spanning else None):
                for at in range(0, len(i), BATCH_LINKS):
                    x, y = mine[i[at : at + BATCH_LINKS]], mine[j[at : at + BATCH_LINKS]]
                    first = np.ones(len(x), bool)
                    for (width, size), part in reversed(list(zip(LEVELS, parts))):
                        x, y = (rotated(z, (width - size * part) % width, width) for z in (x, y))
                        for before in range(0 if spanning else part):
                            first &= ((x ^ y) >> np.uint64(width - size * (before + 1))) & np.uint64((1 << size) - 1) != 0
                    if first.any():
                        x, y = x[first].view(np.int64), y[first].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

    return arrow_map(bucketed(prints).repartition("path", "lead").select("path", "key"), run, "u long, v long")


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, digest) of every row: its fingerprint, and XXH64 of its text; a null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    step = lambda cols, state: [cols[0], fingerprints(text_bytes(cols[1])).view(np.int64), cols[2]]
    return stream(docs, step, [F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest")], f"doc_id {kind}, fp long, digest long")


def rooted(prints: DataFrame, budget: int) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint of hashed(): its row of the smallest id, as (nameless, doc_id, fp,
    digest) with nameless true for a null id, and the smallest fingerprint that it reaches."""
    roots = components(linked(prints.select("fp").distinct(), budget, spanning=True))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "digest")).alias("least")
    return prints.groupBy("fp").agg(least).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id among documents reached by links.

    Copies are one class from the start: only distinct fingerprints are joined, and their members follow by fingerprint.
    Empty and null texts have fingerprint zero and link like any other. Rows with equal ids stay; a null id never is a
    component_id unless its component has no other. An empty table gives no rows.
    """
    prints = written(hashed(docs, id_col, text_col), "prints")
    classes = rooted(prints, budget)
    least = classes.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3) -> DataFrame:
    """docs, all their columns, with one row of each component.

    It is the row of the smallest id, a null id last; of the rows of that id the one of the smallest fingerprint, then of
    the smallest digest of its text. Rows that repeat the kept one's id and text are one. Empty and null texts link like
    any others, fingerprint zero. An empty table gives no rows.
    """
    prints = written(hashed(docs, id_col, text_col), "prints")
    kept = rooted(prints, budget).groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.digest")
    repeats = prints.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest")
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__digest"))

    def among(side: DataFrame, found: DataFrame, how: str) -> DataFrame:
        return side.join(found, side["__id"].eqNullSafe(found["doc_id"]) & (side["__digest"] == found["digest"]), how)

    rows = among(rows, kept, "left_semi")
    if repeats.limit(1).count():
        once = among(rows, repeats, "left_anti")
        twice = among(rows, repeats, "left_semi").groupBy("__id", "__digest").agg(F.first("__row").alias("__row"))
        rows = once.select("__row").unionByName(twice.select("__row"))
    return rows.select("__row.*")
