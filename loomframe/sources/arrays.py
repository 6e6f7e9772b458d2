"""Arrays kept as binary files, decoded on the executors: a row per element."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# NumPy's and Spark's types of the formats' element types.
NUMPY = {"bool": "u1", "int8": "i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float32": "<f4", "float64": "<f8"}
WIDE = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "string": "string"}
#: Elements per batch that decoding hands on.
BATCH = 1 << 16


class Folder:
    """Files under an address that Spark's file systems read, as one-row DataFrames of their bytes."""

    def __init__(self, spark: SparkSession, root: str):
        from .store import Store

        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark)

    def exists(self, path: str) -> bool:
        return self.store.exists(f"{self.root}/{path}")

    def json(self, path: str):
        return json.loads(self.store.read(f"{self.root}/{path}"))

    def names(self, path: str) -> list[str]:
        return self.store.names(f"{self.root}/{path}")

    def bytes(self, path: str, column: str) -> DataFrame:
        return self.spark.read.format("binaryFile").load(f"{self.root}/{path}").select(F.col("content").alias(column))


class Site:
    """Files under an http address. What there is comes from its metadata.zip, an archive of all JSON files with the axes'
    names in axes/metadata.json; without one, from its metadata.json, a map from each file to its JSON."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        try:
            with zipfile.ZipFile(io.BytesIO(fetched(f"{self.root}/metadata.zip"))) as archive:
                self.index = {n: json.loads(archive.read(n)) for n in archive.namelist()}
            self.index |= {f"axes/{a}.txt": None for a in self.index["axes/metadata.json"]}
            self.complete = False
        except HTTPError:
            self.index, self.complete = json.loads(fetched(f"{self.root}/metadata.json")), True

    def exists(self, path: str) -> bool:
        if path in self.index or self.complete or path.endswith(".json"):
            return path in self.index
        try:
            with urlopen(Request(f"{self.root}/{path}", method="HEAD"), timeout=30):
                return True
        except HTTPError:
            return False

    def json(self, path: str):
        return self.index[path] if path in self.index else json.loads(fetched(f"{self.root}/{path}"))

    def names(self, path: str) -> list[str]:
        return sorted({k[len(path) + 1 :].split("/")[0] for k in self.index if k.startswith(f"{path}/")})

    def bytes(self, path: str, column: str) -> DataFrame:
        url = f"{self.root}/{path}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([fetched(x)], pa.binary())], [column])

        return self.spark.range(1).select(F.lit(url).alias("url")).mapInArrow(run, f"{column} binary")


def fetched(url: str) -> bytes:
    with urlopen(url, timeout=30) as response:
        return response.read()


def elements(parts: list[DataFrame], decode: Callable[..., Iterator[list]], schema: str) -> DataFrame:
    """Rows that decode makes of the bytes of the parts, each a one-row DataFrame."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for columns in decode(*row):
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, target.types)], schema=target)

    return one.mapInArrow(run, schema)


def numbers(data: bytes, kind: str) -> np.ndarray:
    a = np.frombuffer(data, NUMPY[kind])
    return a.astype(bool) if kind == "bool" else a


def lines(data: bytes) -> list[str]:
    text = data.decode()
    return text[:-1].split("\n") if text else []


def vlen_strings(data: bytes) -> list[str]:
    """A count, then each string's length and bytes, all lengths 32-bit little-endian."""
    (n,) = struct.unpack_from("<I", data)
    out, at = [], 4
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        out.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out


def unpacked(data: bytes, codecs: list[dict], kind: str):
    """A chunk's elements, by its codecs undone from the last."""
    for codec in reversed(codecs):
        name = codec["name"]
        if name == "gzip":
            data = gzip.decompress(data)
        elif name == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "vlen-utf8":
            return vlen_strings(data)
        elif name not in ("bytes", "crc32c"):
            raise NotImplementedError(f"chunks of the codec {name}")
        elif name == "crc32c":
            data = data[:-4]
    return numbers(data, kind)


def sharded(data: bytes, node: dict, config: dict):
    """All elements of a shard in C order: an index of (place, size) of its chunks, then the chunks, the last ones padded."""
    shape, inner, kind = node["shape"], config["chunk_shape"], node["data_type"]
    grid = [-(-a // b) for a, b in zip(shape, inner)]
    index = np.frombuffer(data, "<u8", 2 * int(np.prod(grid))).reshape(-1, 2)
    out = np.full(shape, node.get("fill_value") if kind != "string" else "", object if kind == "string" else NUMPY[kind] if kind != "bool" else bool)
    for k, (at, size) in enumerate(index.tolist()):
        if at == 0xFFFFFFFFFFFFFFFF:
            continue
        place = np.unravel_index(k, grid)
        chunk = np.array(unpacked(data[at : at + size], config["codecs"], kind), out.dtype).reshape(inner)
        where = tuple(slice(p * i, min((p + 1) * i, s)) for p, i, s in zip(place, inner, shape))
        out[where] = chunk[tuple(slice(0, w.stop - w.start) for w in where)]
    return out.ravel()
