"""Helpers shared by the corpus operators: shared folders, row streaming, word splitting and the encoder cache."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds memory in a Python worker.
STEP_BYTES = 1 << 20

#: Rows of a batch that Spark sends to Python.
BATCH_ROWS = 500

#: Entries an encoder cache may hold in one Python worker; later chunks are encoded each time.
CACHE_ENTRIES = 1_200_000
#: The cache's hash table has 2**TABLE_BITS places, 12 bytes each.
TABLE_BITS = 21
#: Bytes of text that are encoded in one go, and of the longest chunk that is looked up.
WINDOW, LONGEST = 2 * STEP_BYTES, 256

#: ASCII bytes that are not in a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ become spaces, once A-Z are lower case.
WORD_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors all see, under spark.checkpoint.dir; deleted when the driver ends. Only a
    session on one machine may leave the setting out: then it is set here."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


def clear() -> None:
    """Deletes all folders that were made; results that still read from them are lost."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may have ended: what is left there is the cluster's to clear
            remove(spark, path)


atexit.register(clear)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless their PYTHONPATH is known to hold it."""
    import loomframe

    root = os.path.dirname(os.path.dirname(os.path.abspath(loomframe.__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_loomframe_sent", False):
        return
    tmp = tempfile.mkdtemp()  # Spark serves the archive from here as long as the session lasts
    atexit.register(shutil.rmtree, tmp, True)
    sc.addPyFile(shutil.make_archive(f"{tmp}/loomframe-{uuid.uuid4().hex}", "zip", root, "loomframe"))
    sc._loomframe_sent = True


def bounded(spark: SparkSession) -> None:
    """Bounds the batches that go to Python: by default 10,000 rows, which of long documents are hundreds of MB on both
    sides. A session that sets fewer keeps its own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def local(shared: Broadcast):
    """A broadcast's value, of which a Python worker keeps the one asked for last; workers outlive many queries."""
    if not _held or _held[0] is not shared:
        _held[:] = [shared, shared.value]
        if shared._path is not None:  # read again from there if it is asked for again
            shared.__dict__.pop("_value", None)
    return _held[1]


_held: list = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomframe_path = path
    return out


def drop(*written_dfs: DataFrame) -> None:
    """Deletes the folders of what written() returned and nothing reads any more."""
    for df in written_dfs:
        if path := getattr(df, "_loomframe_path", None):
            remove(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with bounded batches; a Python worker, which outlives its tasks, gives back after each what it does not
    hold on to."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    bounded(df.sparkSession)
    return df.mapInArrow(whole, schema)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def stream(df: DataFrame, step: Callable[[list[pa.Array], dict], list], cols: list[Column], schema: str) -> DataFrame:
    """mapInArrow of step over the selected columns. step gets the columns of at most STEP_BYTES of data (or one
    row) and a dict that lasts for the partition, and returns the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        out = None
        for batch in batches:
            for part in sliced(batch):
                got = step(part.columns, state)
                out = out or names
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in got], out)

    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names
    return arrow_map(df.select(*cols), run, schema)


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about STEP_BYTES each, never less than a row."""
    n = batch.num_rows
    if not n:
        return
    rows = max(1, int(n * STEP_BYTES / max(batch.nbytes, 1)))
    for at in range(0, n, rows):
        yield batch.slice(at, rows)


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text after A-Z are lower-cased."""
    return text.lower().translate(WORD_TABLE).split()


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one byte array, and where each begins with the total length last."""
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def gathered(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i]+lengths[i]-1 for each i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)


class Encoder:
    """Encodes texts exactly as the tokenizers library does, calling it once for each distinct chunk of text.

    A text is cut before a space or newline that follows a character other than white space, and before one of
    ,.;:!? that follows an ASCII letter. Pre-tokenizers that never join across such places (the two BPE files used
    here: no pre-token spans a cut, the normalizers act within a chunk, added tokens hold no white space or such
    punctuation) give the same ids chunk by chunk. Cut places are only where the rule certainly holds: a character that
    could be white space outside ASCII suppresses the cut.

    Chunks are looked up by a 64-bit hash, and every chunk is then compared byte by byte with the one whose ids it is to
    get; one that only has the same hash goes to the library, as do chunks over LONGEST bytes. Texts are read in windows
    of WINDOW bytes, so a very long text takes little more than its bytes and ids.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        self.lib = Tokenizer.from_file(path)
        self.codes = np.random.default_rng(20240229).integers(0, 1 << 64, LONGEST * 256, np.uint64)
        self.table = np.zeros(1 << TABLE_BITS, np.uint64)
        self.entry = np.zeros(1 << TABLE_BITS, np.int32)
        self.ids, self.text = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint8)
        # of each entry: where its ids and its text begin, and the number of its ids
        self.at, self.text_at, self.length = np.zeros(1 << 12, np.int64), np.zeros((1 << 12) + 1, np.int64), np.zeros(1 << 12, np.int32)
        self.kept = self.used = 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each file and Python process."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1; linear probing of all at once."""
        out = np.full(len(hashes), -1, np.int64)
        rest, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(rest):
            there = self.table[at]
            same = there == hashes[rest]
            out[rest[same]] = self.entry[at[same]]
            on = ~same & (there != 0)
            rest, at = rest[on], (at[on] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def _keep(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Puts new, distinct hashes in the table."""
        rest, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(rest):
            free = self.table[at] == 0
            self.table[at[free]] = hashes[rest[free]]  # of several for a place, one stays
            won = self.table[at] == hashes[rest]
            self.entry[at[won]] = entries[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & ((1 << TABLE_BITS) - 1)

    def _library(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Ids of chunks of the data."""
        whole = data.tobytes() if len(starts) > 8 else None
        parts = (whole[a:b] if whole is not None else data[a:b].tobytes() for a, b in zip(starts.tolist(), (starts + sizes).tolist()))
        return [x.ids for x in self.lib.encode_batch_fast([x.decode("utf-8", "replace") for x in parts], add_special_tokens=False)]

    def _add(self, got: list[list[int]], data: np.ndarray, starts: np.ndarray, chunk_sizes: np.ndarray) -> np.ndarray:
        """New entries for chunks of the data and their lists of ids."""
        sizes = np.array([len(x) for x in got], np.int64)
        total, texts = int(sizes.sum()), int(chunk_sizes.sum())
        end = int(self.text_at[self.kept])
        self.ids, self.text = grown(self.ids, self.used + total), grown(self.text, end + texts)
        self.at, self.length, self.text_at = grown(self.at, self.kept + len(got)), grown(self.length, self.kept + len(got)), grown(self.text_at, self.kept + len(got) + 1)
        new = np.arange(self.kept, self.kept + len(got))
        self.length[new] = sizes
        self.at[new] = self.used + np.cumsum(sizes) - sizes
        self.text_at[new + 1] = end + np.cumsum(chunk_sizes)
        self.ids[self.used : self.used + total] = [x for y in got for x in y]
        self.text[end : end + texts] = data[gathered(starts, chunk_sizes)]
        self.used += total
        self.kept += len(got)
        return new

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other (int32), and where each text's begin, with their number last."""
        data, bounds = flat(parts)
        n, at, done, width = len(data), 0, 0, WINDOW
        begin, out = np.zeros(len(parts) + 1, np.int64), []
        while at < n:
            stop = min(n, at + width)
            inside = slice(*np.searchsorted(bounds, [at, stop]).tolist())
            starts = cuts(data, bounds[inside], at, stop)
            if stop < n:
                if len(starts) == 1:  # no cut in a whole window
                    width *= 2
                    continue
                stop, starts = int(starts[-1]) + at, starts[:-1]  # the last chunk may go on
                inside = slice(inside.start, int(np.searchsorted(bounds, stop)))
            ids, ends = self._chunks(data[at:stop], starts)
            begin[inside] = done + ends[np.searchsorted(starts, bounds[inside] - at)]
            out.append(ids)
            at, done, width = stop, done + int(ends[-1]), WINDOW
        begin[np.searchsorted(bounds, n) :] = done  # empty texts at the end, and the number of all
        return np.concatenate(out) if out else np.zeros(0, np.int32), begin

    def _chunks(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks of the data (one from each start), and where each chunk's begin, with their number last."""
        import pandas as pd

        sizes = np.diff(starts, append=len(data))
        place = np.arange(len(data), dtype=np.int32) - np.repeat(starts, sizes).astype(np.int32)  # in its chunk
        code = self.codes[np.minimum(place, LONGEST - 1) * np.int32(256) + data]
        hashes = (np.add.reduceat(code, starts) + sizes.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        del code
        codes, uniques = pd.factorize(hashes)
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        # chunks that are not, byte by byte, the first one of their hash go to the library by themselves
        loose = (sizes != sizes[first[codes]]) | (sizes > LONGEST)
        back = np.repeat((starts - starts[first[codes]]).astype(np.int32), sizes)
        if loose.any():
            back[np.repeat(loose, sizes)] = 0
        there = np.arange(len(data), dtype=np.int32) - back
        if len(bad := np.flatnonzero(data[there] != data)):
            loose[np.searchsorted(starts, bad, "right") - 1] = True
        fit = ~loose[first]  # of a loose first chunk all others of equal size were compared with it
        entry = self._find(uniques)
        held = np.flatnonzero((entry >= 0) & fit)
        wrong = self._differ(entry[held], data, starts[first[held]], sizes[first[held]])
        fit[held[wrong]] = False
        before = self.kept, self.used
        if len(new := np.flatnonzero((entry < 0) & fit)):
            of = first[new]
            entry[new] = self._add(self._library(data, starts[of], sizes[of]), data, starts[of], sizes[of])
            if self.kept <= CACHE_ENTRIES:
                self._keep(uniques[new], entry[new])
                before = self.kept, self.used
        entry = entry[codes]
        loose |= ~fit[codes]
        if len(odd := np.flatnonzero(loose)):
            entry[odd] = self._add(self._library(data, starts[odd], sizes[odd]), data, starts[odd], sizes[odd])
        lengths = self.length[entry].astype(np.int64)
        ids = self.ids[gathered(self.at[entry], lengths)]
        if (self.kept, self.used) != before:  # entries of this step alone
            self.kept, self.used = before
            if odd.size and int(sizes[odd].max()) > LONGEST:
                self.ids, self.text = self.ids[: max(1 << 16, 2 * self.used)].copy(), self.text[: max(1 << 16, 2 * int(self.text_at[self.kept]))].copy()
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def _differ(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the text of each entry is another than the chunk of the data."""
        out = self.text_at[entry + 1] - self.text_at[entry] != sizes
        same = np.flatnonzero(~out)
        if len(same):
            begin = np.cumsum(sizes[same]) - sizes[same]
            apart = self.text[gathered(self.text_at[entry[same]], sizes[same])] != data[gathered(starts[same], sizes[same])]
            out[same] = np.add.reduceat(apart, begin, dtype=np.int64) > 0
        return out


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array, longer by half until it holds n."""
    size = len(a)
    while size < n:
        size += size // 2
    return a if size == len(a) else np.concatenate([a, np.zeros(size - len(a), a.dtype)])


def cuts(data: np.ndarray, bounds: np.ndarray, at: int, stop: int) -> np.ndarray:
    """Where chunks begin in data[at:stop], counted from at: at itself, the bounds of texts, and safe places between."""
    own = data[at:stop]
    kind = KIND[own]
    cut = np.zeros(len(own), bool)
    cut[1:] = ((kind[1:] == 2) & (kind[:-1] & 1 == 1)) | ((kind[1:] == 5) & (kind[:-1] == 3))
    far = np.flatnonzero(cut & np.concatenate([[False], own[:-1] >= 0x80])) + at
    if len(far):
        lead2, lead3 = data[np.maximum(far - 2, 0)], data[np.maximum(far - 3, 0)]
        cut[far[(lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3))] - at] = False
    cut[0] = True
    cut[bounds[bounds < stop] - at] = True
    return np.flatnonzero(cut)


#: By byte: 2 a space or newline; 3 an ASCII letter; 5 punctuation to cut before; 1 other visible or non-ASCII; 0 the rest.
KIND = np.ones(256, np.uint8)
KIND[:33] = 0
KIND[127] = 0
KIND[[10, 32]] = 2
KIND[[ord(c) for c in ",.;:!?"]] = 5
KIND[[*range(65, 91), *range(97, 123)]] = 3


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; each process resolves it for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
