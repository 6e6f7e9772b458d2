"""Benchmark passages in documents, found by a Wu-Manber search over words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, arrow_map, gathered, local, sliced, stream, text_bytes, words, written

#: Words of all items that one table may hold, or those of one item; more are searched table by table.
TABLE_WORDS = 500_000
#: Words of one lane of text.
LANE_WORDS = 2048
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


class Patterns:
    """Wu-Manber tables of patterns of one length m over word numbers.

    SHIFT says, for a block of two words (one if m is 1), how far a window of m words that ends in it can move without
    passing an occurrence. A block with shift 0 ends patterns: its hash bucket holds them, sorted by a hash of their first
    block, and those of the window's first block are compared with it word by word.
    """

    def __init__(self, m: int, rows: np.ndarray, owners: np.ndarray, ends: np.ndarray):
        """rows: the patterns, all different; owners[ends[i]:ends[i + 1]]: the items that pattern i is in."""
        self.m, self.block, self.owners, self.ends = m, min(m, 2), owners, ends
        self.most = m - self.block + 1
        code = np.concatenate([self.blocks(rows[:, end - self.block : end]) for end in range(self.block, m + 1)])
        shift = np.repeat(np.arange(self.most - 1, -1, -1), len(rows))
        order = np.lexsort((shift, code))
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        self.codes, self.shift = code[order][first], shift[order][first]
        bucket = np.searchsorted(self.codes, self.blocks(rows[:, m - self.block :]))
        key = bucket << 32 | self.prefix(rows)
        self.of = np.argsort(key, kind="stable")
        self.key, self.rows = key[self.of], rows[self.of]

    def blocks(self, w: np.ndarray) -> np.ndarray:
        return w[:, 0].astype(np.int64) if self.block == 1 else w[:, 0].astype(np.int64) << 32 | w[:, 1]

    def prefix(self, rows: np.ndarray) -> np.ndarray:
        """A 32-bit hash of the first block of each row."""
        return (self.blocks(rows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)

    def search(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and patterns of all occurrences within the ranges of text. All ranges, in lanes that overlap by m - 1
        words, advance together, each by its own shift."""
        m = self.m
        long = ends - starts >= m
        starts, ends = starts[long], ends[long]
        lanes = -(-(ends - starts - m + 1) // LANE_WORDS)
        at = gathered(np.zeros(len(lanes), np.int64), lanes) * LANE_WORDS + np.repeat(starts, lanes)
        stop = np.minimum(at + LANE_WORDS + m - 1, np.repeat(ends, lanes)) - m  # the last place for a window
        places, found = [], []
        while len(at):
            last = at + m - self.block
            code = text[last].astype(np.int64) if self.block == 1 else text[last].astype(np.int64) << 32 | text[last + 1]
            bucket = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            shift = np.where(self.codes[bucket] == code, self.shift[bucket], self.most)
            ended = shift == 0
            if ended.any():
                hit = at[ended]
                window = text[hit[:, None] + np.arange(m)]
                key = bucket[ended] << 32 | self.prefix(window)
                i, j = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
                n = j - i
                which, rows = np.repeat(np.arange(len(hit)), n), gathered(i, n)
                same = (window[which] == self.rows[rows]).all(axis=1)
                places.append(hit[which[same]])
                found.append(self.of[rows[same]])
            at = at + np.maximum(shift, 1)
            keep = at <= stop
            at, stop = at[keep], stop[keep]
        none = np.zeros(0, np.int64)
        return (np.concatenate(places), np.concatenate(found)) if places else (none, none)


class Table:
    """The patterns of a block of items (name, text), by their length, and the items' names."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        ids, lengths = [], []
        for _, text in items:
            w = words(text)
            ids.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int32))
            lengths.append(len(w))
        every, begin = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        own, lengths = np.array([number[i] for i, _ in items], np.int64), np.array(lengths, np.int64)
        self.patterns = []
        for m in np.unique(np.minimum(lengths, size)).tolist():
            of = np.flatnonzero(np.minimum(lengths, size) == m)
            if not m:
                continue
            n = lengths[of] - m + 1
            rows = every[gathered(begin[of], n)[:, None] + np.arange(m)]
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat(own[of], n)], 1), axis=0)
            self.patterns.append(Patterns(m, rows, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))))

    def numbers(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, 0 for others; STEP_BYTES of it are split at a time."""
        get, at, out = self.vocabulary.get, 0, []
        while at < len(text):
            cut = SEPARATOR.search(text, at + STEP_BYTES) if len(text) - at > STEP_BYTES else None
            end = cut.start() if cut else len(text)
            w = words(text[at:end])
            out.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
            at = end
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int32), *out])

    def found_in(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Words of each text, and, of each text with an occurrence, the spans of all as (first word, end), and the items."""
        numbers = [self.numbers(x) for x in texts]
        counts = np.array([len(w) for w in numbers], np.int64)
        begin, ids = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([np.zeros(0, np.int32), *numbers])
        own: dict[int, tuple[list, set]] = {}
        for p in self.patterns:
            places, which = p.search(ids, begin[:-1], begin[1:])
            of = np.searchsorted(begin, places, "right") - 1
            for i, at, k in zip(of.tolist(), (places - begin[of]).tolist(), which.tolist()):
                spans, items = own.setdefault(i, ([], set()))
                spans.append((at, at + p.m))
                items.update(self.names[x] for x in p.owners[p.ends[k] : p.ends[k + 1]].tolist())
        return counts, own


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, table_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items as (name, text) in blocks of at most table_words words, or one item; one block at least. The driver holds
    two blocks, and one partition of the benchmark, at a time."""
    held, total, some = [], 0, False
    for r in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        text = (r["t"] or "").encode()
        n = len(words(text))
        if total and total + n > table_words:
            yield held
            held, total, some = [], 0, True
        if n:
            held.append((r["i"], text))
            total += n
    if held or not some:
        yield held


def table_of(shared, state: dict, size: int) -> Table:
    """The table of a broadcast block, made once a task."""
    if "table" not in state:
        state["table"] = Table(local(shared), size)
    return state["table"]


NOTHING = hashlib.sha256(b"").hexdigest()
VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, holds_window boolean"


def verdicts(counts: np.ndarray, own: dict, size: int, share: int) -> list:
    """The columns of VERDICT of texts, given their words, and the spans and items of those with an occurrence."""
    n_hit, n_items, window = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
    sha = [NOTHING] * len(counts)
    for i, (spans, items) in own.items():
        n_hit[i], n_items[i], window[i] = covered(spans), len(items), any(b - a == size for a, b in spans)
        sha[i] = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return [counts, n_hit, n_items, pa.array(sha, pa.string()), pa.array((n_hit > 0) & (share * n_hit >= counts)), pa.array(window)]


def judged(docs: DataFrame, benchmark: DataFrame, size: int, share: int, id_col: str, text_col: str, item_col: str, item_text_col: str, table_words: int) -> DataFrame:
    """doc_id and VERDICT of every document."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    cols = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    blocks = item_blocks(benchmark, item_col, item_text_col, table_words)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        shared = spark.sparkContext.broadcast(block)  # at most table_words words, or one item

        def whole(cols, state):
            return [cols[0], *verdicts(*table_of(shared, state, size).found_in(text_bytes(cols[1])), size, share)]

        return stream(docs, whole, cols, f"doc_id {kind}, {VERDICT}")
    parts = None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)

        def one(cols, state, shared=shared):
            texts = text_bytes(cols[0])
            _, own = table_of(shared, state, size).found_in(texts)
            rows = sorted(own)
            return [
                pa.array([hashlib.sha256(texts[i]).digest() for i in rows], pa.binary()),
                pa.array([[x for s in own[i][0] for x in s] for i in rows], pa.list_(pa.int64())),
                pa.array([sorted(own[i][1]) for i in rows], pa.list_(pa.string())),
            ]

        # by text: copies of a text have the same hits
        hits = written(stream(docs, one, cols[1:], "digest binary, spans array<long>, items array<string>").dropDuplicates(["digest"]), "hits")
        shared.destroy()
        parts = hits if parts is None else parts.unionByName(hits)
        block, more = more, next(blocks, None)
    both = parts.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def counted(cols, state):
        texts = text_bytes(cols[1])
        return [cols[0], np.array([len(words(x)) for x in texts], np.int64), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())]

    def last(cols, state):
        own = {i: (list(zip(spans[::2], spans[1::2])), set(items)) for i, (spans, items) in enumerate(zip(cols[2].to_pylist(), cols[3].to_pylist())) if spans}
        return [cols[0], *verdicts(cols[1].to_numpy(), own, size, share)]

    joined = stream(docs, counted, cols, f"doc_id {kind}, n_words long, digest binary").join(both, "digest", "left")
    return stream(joined, last, [F.col(c) for c in ("doc_id", "n_words", "spans", "items")], f"doc_id {kind}, {VERDICT}")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A window: size consecutive words of an item, all
    of them if it has fewer; an item without words has none. contaminated: at least a word is hit, and at least one in
    share. Null texts have no words; a null item id counts as an item named by the empty string; items of equal id are
    one; repeated documents get a row each. Without documents there are no rows, without items no hits.

    The benchmark is read in blocks of at most table_words words; documents are scanned once a block in place, with no
    shuffle for one block. For more blocks each block's hits are written, by text, and joined to the documents' texts at the
    end; the result is the same.
    """
    return judged(docs, benchmark, size, share, id_col, text_col, item_col, item_text_col, table_words).drop("holds_window")


def covered(spans: list[tuple[int, int]]) -> int:
    """Words that lie in any span."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """docs, all their columns, without the rows that hold a whole window of size words of an item anywhere, or that
    contamination() marks (which tells of items of fewer words).

    Each row is judged by its whole text: null and empty texts have no words and stay, and ids play no part, so they may be
    null or repeat. Without items all rows stay; without documents there are none. For one block of items a row is judged
    where it is; for more, rows go by the SHA-256 of their text.
    """
    blocks = item_blocks(benchmark, item_col, item_text_col, table_words)
    block, more = next(blocks), next(blocks, None)
    columns, text = docs.columns, F.col(f"`{text_col}`").cast("string")
    if more is not None:
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.sha2(text.cast("binary"), 256).alias("__digest"))  # null for a null text
        texts = docs.select(F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
        bad = judged(texts, benchmark, size, share, "digest", "text", item_col, item_text_col, table_words).where("contaminated or holds_window").select("doc_id").distinct()
        return rows.join(bad, rows["__digest"] == bad["doc_id"], "left_anti").select("__row.*")
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most table_words words, or one item

    def run(batches):
        state: dict = {}
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for few in sliced(batch):
                *_, contaminated, window = verdicts(*table_of(shared, state, size).found_in(text_bytes(few.column(at).cast(pa.string()))), size, share)
                yield few.filter(pa.compute.invert(pa.compute.or_(contaminated, window)))

    return arrow_map(docs, run, docs.schema)
