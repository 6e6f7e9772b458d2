"""Token ids as wavelet matrices: one succinct, compressed, searchable row of a Parquet file per shard."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import STEP_BYTES, Encoder, arrow_map, crc, shared_dir, sliced, stream, text_bytes, tokenizer_path

#: Tokens after which a shard ends, at the next document's end.
SHARD_TOKENS = 1 << 21
#: Bits between two entries of a rank directory.
RANK_BITS = 512
#: Bytes of a plane that are compressed together, a multiple of RANK_BITS / 8.
BLOCK_BYTES = 1 << 15
#: Bytes of text whose ids go to one task and one file, about.
PART_BYTES = 32 * STEP_BYTES
#: Values that are parted together, so that their places stay in a core's cache.
PARTED = 1 << 15

SHARD_SCHEMA = "part int, seq int, part_start long, n_tokens long, n_docs long, bits int, docs binary, zeros array<long>, ranks array<binary>, planes array<array<binary>>"


class Plane:
    """Bytes of a bit-plane in blocks of BLOCK_BYTES, each compressed by itself and opened when it is asked for."""

    def __init__(self, blocks: list[bytes]):
        self.blocks, self.open = blocks, {}

    @classmethod
    def of(cls, plane: np.ndarray) -> list[bytes]:
        z = zstandard.ZstdCompressor(1)
        return [z.compress(plane[k : k + BLOCK_BYTES].tobytes()) for k in range(0, len(plane), BLOCK_BYTES)]

    def block(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[k]), np.uint8)
        return self.open[k]

    def __getitem__(self, at) -> np.ndarray | int:
        """A byte, or a slice that lies within one block."""
        k, low = divmod(at.start if isinstance(at, slice) else int(at), BLOCK_BYTES)
        if not isinstance(at, slice):
            return self.block(k)[low]
        return self.block(k)[low : low + at.stop - at.start] if at.stop > at.start else np.zeros(0, np.uint8)

    def whole(self) -> np.ndarray:
        z = zstandard.ZstdDecompressor()
        return np.frombuffer(b"".join(z.decompress(x) for x in self.blocks), np.uint8)


class WaveletMatrix:
    """A sequence of integers under 2**bits as bit-planes, highest bit first, each stably parted by the one above.

    access, rank, select, count and occurrences take O(bits) plane lookups an answer; rank reads a directory of
    ones before each RANK_BITS bits and counts within one block. planes and ranks may be arrays, or a Plane and a
    function that gives the directory.
    """

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray | Plane], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = np.asarray(ids)
        a = a.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (a >> a.dtype.type(level)) & a.dtype.type(1) != 0
            plane = np.packbits(one)
            planes.append(plane)
            ranks.append(directory(plane))
            zeros.append(len(a) - int(ranks[-1][-1]))
            down = np.empty_like(a)
            for at, (lo, low), (hi, high) in parted(one, zeros[-1]):
                down[lo : lo + len(low)], down[hi : hi + len(high)] = a[at][low], a[at][high]
            a = down
        return cls(len(a), bits, zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All values, by undoing the partings from the lowest plane up."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits):
            plane = self.planes[self.bits - 1 - level]
            plane = plane.whole() if isinstance(plane, Plane) else plane
            one = np.unpackbits(plane, count=self.n).view(bool)
            z = self.zeros[self.bits - 1 - level]
            up = np.empty_like(a)
            a[z:] |= a.dtype.type(1 << level)
            for at, (lo, low), (hi, high) in parted(one, z):
                up[at][low], up[at][high] = a[lo : lo + len(low)], a[hi : hi + len(high)]
            a = up
        return a

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block, step = i // RANK_BITS, RANK_BITS // 8
        out = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][block * step : i >> 3]).sum())
        return out + (int(self.planes[k][i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else out

    def access(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, value = int(i), 0
        for k in range(self.bits):
            b = self._bit(k, at)
            value = value << 1 | b
            at = self.zeros[k] + self._ones(k, at) if b else at - self._ones(k, at)
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> self.bits:
            return 0, 0
        for k in range(self.bits):
            if lo == hi:
                return 0, 0
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol before place i."""
        lo, hi = self._range(symbol, 0, i)
        return hi - lo

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, j: int) -> int:
        """Place of the j-th occurrence (from 0) of symbol."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        at = lo + j
        for k in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - k) & 1
            want = at - self.zeros[k] if one else at
            low, high = 0, self.n - 1  # the place of the want-th such bit of plane k
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(k, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]


def parted(one: np.ndarray, zeros: int) -> Iterator[tuple[slice, tuple[int, np.ndarray], tuple[int, np.ndarray]]]:
    """Of each PARTED values: their slice; where its zeros begin among all values parted, and their places in the slice;
    the same of its ones. Places are found without a branch a value, which a mask as an index takes."""
    lo, hi = 0, zeros
    for k in range(0, len(one), PARTED):
        at = slice(k, k + PARTED)
        low, high = np.flatnonzero(~one[at]), np.flatnonzero(one[at])
        yield at, (lo, low), (hi, high)
        lo, hi = lo + len(low), hi + len(high)


def directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each RANK_BITS bits, and in all."""
    step = RANK_BITS // 8
    padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
    padded[: len(plane)] = plane
    each = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(each)]).astype(np.uint32)


def packed(part: int, seq: int, start: int, docs: list, lengths: list[int], ids: np.ndarray, bits: int, id_type: pa.DataType) -> list:
    """The shard's row, in the order of SHARD_SCHEMA."""
    z = zstandard.ZstdCompressor(1)
    m = WaveletMatrix.of(ids, bits)
    sink = io.BytesIO()
    table = pa.table({"doc_id": pa.array(docs, id_type), "n_tokens": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return [part, seq, start, m.n, len(docs), bits, z.compress(sink.getvalue()), m.zeros, [z.compress(x.tobytes()) for x in m.ranks], [Plane.of(x) for x in m.planes]]


class Ranks:
    """A plane's rank directory, opened when it is asked for."""

    def __init__(self, data: bytes):
        self.data, self.open = data, None

    def __getitem__(self, k: int) -> int:
        if self.open is None:
            self.open = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data), np.uint32)
        return int(self.open[k])


def opened(bits: int, n: int, zeros: list[int], ranks: list[bytes], planes: list[list[bytes]]) -> WaveletMatrix:
    """The matrix of a shard's row; only what an answer needs is decompressed."""
    return WaveletMatrix(n, bits, zeros, [Plane(x) for x in planes], [Ranks(x) for x in ranks])


def listed(docs: bytes) -> pa.Table:
    """The documents of a shard's row: doc_id and n_tokens, in order."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(docs, max_output_size=1 << 31)).read_all()


def ranged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, tie (a hash of the text), range, text of every document, and the number of ranges of (doc_id, tie), of
    about PART_BYTES of text each.

    Where ranges end is read from rows drawn by their bytes, about one in STEP_BYTES of text, before any text is encoded.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    drawn = rows.select("doc_id", "tie", size.alias("size")).where(F.rand(5) * STEP_BYTES < F.col("size"))
    drawn = drawn.select(F.struct("doc_id", "tie", F.greatest("size", F.lit(STEP_BYTES)).alias("stands_for")).alias("x"))
    drawn = drawn.agg(F.sort_array(F.collect_list("x")).alias("x")).first()["x"]
    upto = np.cumsum([x["stands_for"] for x in drawn], dtype=np.int64)
    n = math.ceil(int(upto[-1]) / PART_BYTES) if len(drawn) else 1
    ends = [drawn[k] for k in np.unique(np.searchsorted(upto, [int(upto[-1]) * k // n for k in range(1, n)])).tolist()] if n > 1 else []
    if not ends:
        return rows.select("doc_id", "tie", F.lit(0).alias("range"), "text"), 1
    kind = docs.schema[id_col].dataType
    # sorted by Spark again: whatever a literal made of an id, ranges ascend
    sorted_ends = F.sort_array(F.array(*(F.struct(literal(x["doc_id"], kind).alias("doc_id"), F.lit(x["tie"]).cast("long").alias("tie")) for x in ends)))
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))))
    # the number of ends up to (doc_id, tie), by halving
    at = F.aggregate(halves, F.lit(0), lambda lo, half: F.when((lo + half <= len(ends)) & (F.get(sorted_ends, lo + half - 1) <= F.struct("doc_id", "tie")), lo + half).otherwise(lo))
    return rows.select("doc_id", "tie", at.alias("range"), "text"), len(ends) + 1


def literal(x, kind: DataType) -> Column:
    """A value of a row that was read, as it stands in a query."""
    if isinstance(kind, StructType) and x is not None:
        return F.struct(*(literal(v, f.dataType).alias(f.name) for v, f in zip(x, kind.fields)))
    return F.lit(x).cast(kind)


def token_ids(rows: DataFrame, tokenizer: str, end_id: int, bits: int) -> DataFrame:
    """Of rows from ranged(): doc_id, tie, range, ids: every document's ids with end_id as little-endian integers of 16 or
    32 bits."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def step(cols, state):
        ids, ends = Encoder.of(tokenizer_path(tokenizer)).encode(text_bytes(cols[3]))
        if max(int(ids.max(initial=0)), end_id) >> bits:
            raise ValueError(f"the vocabulary of {tokenizer} needs more than {bits} bits")
        ids = np.insert(ids, ends[1:], end_id).astype("<u2" if bits <= 16 else "<u4")
        edges = ((ends + np.arange(len(ends))) * ids.itemsize).tolist()
        data = ids.tobytes()
        return [*cols[:3], pa.array([data[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary())]

    return stream(rows, step, [F.col(c) for c in ("doc_id", "tie", "range", "text")], f"doc_id {kind}, tie long, range int, ids binary")


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, bits: int = 16, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every document, appends end_id, and writes ids in ascending id order as wavelet-matrix shards.

    Texts are encoded where they are, and only ids, of 2 bytes, are dealt to ranges of (doc_id, hash of the text) of about
    PART_BYTES, so neither long texts nor a much-repeated id make one range large. A shard never parts a document. Shards
    are rows of the Parquet files under path, in order of (part, seq); the commit of Spark's writer makes each whole or
    absent, and nothing else is written. A null text is empty: only end_id. A null id sorts first; repeated ids stay
    apart, in order of their texts' hash. An id of over bits bits is an error. An empty table gives no shard.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(SHARD_SCHEMA)])
    width = np.dtype("<u2" if bits <= 16 else "<u4")

    def run(batches):
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held_docs, held_len, held_ids, held = [], [], [], 0

        def row():
            got = packed(part, seq, start, held_docs, held_len, np.frombuffer(b"".join(held_ids), width), bits, id_type)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(got, arrow.types)], schema=arrow)

        for batch in batches:
            for few in sliced(batch):
                for d, ids in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    size = len(ids) // width.itemsize
                    held_docs.append(d)
                    held_len.append(size)
                    held_ids.append(ids)
                    held += size
                    if held >= shard_tokens:
                        yield row()
                        seq, start = seq + 1, start + held
                        held_docs, held_len, held_ids, held = [], [], [], 0
        if held_docs:
            yield row()

    rows, n = ranged(docs, id_col, text_col)
    dealt = token_ids(rows, tokenizer, end_id, bits).repartitionById(n, "range").sortWithinPartitions("doc_id", "tie")
    arrow_map(dealt.select("doc_id", "ids"), run, SHARD_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids.

    Each shard is decoded alone; starts within a part are in its shards, and the parts' own starts are sums over one
    row a part.
    """
    def step(cols, state):
        out = {k: [] for k in ("start", "n_tokens", "ids_crc32")}
        ids = []
        for start, n, bits, docs, zeros, ranks, planes in zip(*(c.to_pylist() for c in cols)):
            values, table = opened(bits, n, zeros, ranks, planes).decode(), listed(docs)
            lengths = table["n_tokens"].to_numpy()
            edges = np.concatenate([[0], np.cumsum(lengths)])
            ids.append(table["doc_id"].combine_chunks())
            out["start"] += (start + edges[:-1]).tolist()
            out["n_tokens"] += lengths.tolist()
            values = values.astype("<u4")
            out["ids_crc32"] += [crc(values[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return [pa.concat_arrays(ids), *(pa.array(out[k], pa.int64()) for k in ("start", "n_tokens", "ids_crc32"))]

    cols = [F.col(c) for c in ("first", "n_tokens", "bits", "docs", "zeros", "ranks", "planes")]
    return stream(shards(spark, path), step, cols, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards under path, each with first: the place of its first token among all."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("t"))  # one row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("part_at"))
    # a row a task that wrote; shards themselves, whole matrices, stay where they are
    return rows.join(F.broadcast(parts), "part").withColumn("first", F.col("part_start") + F.col("part_at")).drop("part_at")


#: Columns of a shard that the functions below open.
MATRIX = ("bits", "n_tokens", "zeros", "ranks", "planes")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the tokens stands in the files, by rank over every shard; 0 for one that does not."""

    def step(cols, state):
        made = [opened(*row) for row in zip(*(c.to_pylist() for c in cols))]
        return [np.array(tokens, np.int64), np.array([sum(m.count(t) for m in made) for t in tokens], np.int64)]

    got = stream(spark.read.parquet(path), step, [F.col(c) for c in MATRIX], "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    asked = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token long")
    return asked.join(got, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def token_occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, at: every place of the token, counted from its document's first id; by select in every shard. Repeated
    ids' documents are not told apart."""
    id_type = None

    def step(cols, state):
        ids, at = [], []
        for docs, *row in zip(*(c.to_pylist() for c in cols)):
            places, table = np.array(opened(*row).occurrences(token), np.int64), listed(docs)
            edges = np.concatenate([[0], np.cumsum(table["n_tokens"].to_numpy())])
            of = np.searchsorted(edges, places, "right") - 1
            ids.append(table["doc_id"].combine_chunks().take(pa.array(of)))
            at.append(places - edges[of])
        return [pa.concat_arrays(ids), np.concatenate(at)]

    rows = spark.read.parquet(path)
    first = rows.select("docs").first()
    id_type = "long" if first is None else from_arrow(listed(first["docs"]).schema.field("doc_id").type)
    return stream(rows, step, [F.col(c) for c in ("docs", *MATRIX)], f"doc_id {id_type}, at long")


def from_arrow(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> dict[int, int]:
    """The token at each of the places, counted over all files; by access in the shards that hold them. Places outside
    the files are left out."""
    asked = sorted(set(places))

    def step(cols, state):
        at, values = [], []
        for first, *row in zip(*(c.to_pylist() for c in cols)):
            m = opened(*row)
            own = [p for p in asked if first <= p < first + m.n]
            at += own
            values += [m.access(p - first) for p in own]
        return [np.array(at, np.int64), np.array(values, np.int64)]

    some = F.exists(F.array(*(F.lit(p).cast("long") for p in asked)), lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("n_tokens"))) if asked else F.lit(False)
    got = stream(shards(spark, path).where(some), step, [F.col(c) for c in ("first", *MATRIX)], "place long, token long")
    return {r["place"]: r["token"] for r in got.collect()}  # a row a place asked for


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Writes docs as token files in the shared folder and returns read_token_files of them."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_token_files(docs, path, **options)
    return read_token_files(spark, path, docs.schema[options.get("id_col", "doc_id")].dataType.simpleString())
