"""Writing data sets in the flat-file and Zarr layouts, for other programs.

These layouts keep each array as one file in order, so the driver streams it: sorted on the executors, a partition at a
time, in pieces. Parquet (store.save) is the format to work with.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Reader, q, vc
from ..functions.columns import model_type
from .arrays import BATCH, NUMPY
from .store import Store

INDEX = "UInt64"


def pieces(df: DataFrame, column: str = "value") -> Iterator[list]:
    """The column's values in df's order, BATCH at a time."""
    rows = (r[column] for r in df.toLocalIterator(prefetchPartitions=True))
    while batch := list(islice(rows, BATCH)):
        yield batch


def as_bytes(batches: Iterable[list], kind: str) -> Iterator[bytes]:
    for b in batches:
        yield np.array(b, NUMPY[kind.lower()]).tobytes()


class FlatSink:
    """Arrays as a JSON descriptor and bytes beside it."""

    def __init__(self, store: Store, root: str):
        self.store, self.root, self.known, self.axes = store, root, {}, []
        self.json("daf.json", {"version": [1, 0]})

    def json(self, path: str, value) -> None:
        self.known[path] = json.dumps(value) + "\n"
        self.store.write(f"{self.root}/{path}", self.known[path])

    def finish(self) -> None:
        """Writes the archive of all JSON files that readers over HTTP begin with."""
        self.json("axes/metadata.json", sorted(self.axes))
        archive = io.BytesIO()
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(self.known):
                z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), self.known[path])
        self.store.stream(f"{self.root}/metadata.zip", [archive.getvalue()])

    def scalar(self, name: str, kind: str, value) -> None:
        self.json(f"scalars/{name}.json", {"type": kind, "value": int(value) if kind == "Bool" else value})

    def axis(self, name: str, size: int, batches) -> None:
        self.axes.append(name)
        self.store.stream(f"{self.root}/axes/{name}.txt", self.lines(batches))

    def lines(self, batches) -> Iterator[bytes]:
        for b in batches:
            if any("\n" in x for x in b):
                raise ValueError("a value with a newline")
            yield "".join(f"{x}\n" for x in b).encode()

    def dense(self, path: str, kind: str, shape: list[int], batches) -> None:
        end = "txt" if kind == "String" else "data"
        self.store.stream(f"{self.root}/{path}.{end}", self.lines(batches) if kind == "String" else as_bytes(batches, kind))
        self.json(f"{path}.json", {"format": "dense", "eltype": kind})

    def sparse(self, path: str, kind: str, sizes: dict[str, int], parts: dict[str, Iterable]) -> None:
        for name, batches in parts.items():
            self.store.stream(f"{self.root}/{path}.{name}", as_bytes(batches, kind if name == "nzval" else INDEX))
        self.json(f"{path}.json", {"format": "sparse", "eltype": kind, "indtype": INDEX})


class ZarrSink:
    """Arrays of one chunk in Zarr version 3 groups."""

    def __init__(self, store: Store, root: str):
        self.store, self.root, self.groups = store, root, set()
        self.finish = lambda: None
        for g in ("", "scalars", "axes", "vectors", "matrices"):
            self.group(g)

    def group(self, path: str) -> None:
        if path not in self.groups:
            self.groups.add(path)
            if path:
                self.group(path.rpartition("/")[0])
            self.store.write("/".join(filter(None, (self.root, path, "zarr.json"))), json.dumps({"zarr_format": 3, "node_type": "group"}))

    def dense(self, path: str, kind: str, shape: list[int], batches) -> None:
        self.group(path.rpartition("/")[0])
        text = kind == "String"
        codec = {"name": "vlen-utf8", "configuration": {}} if text else {"name": "bytes", "configuration": {"endian": "little"}}
        node = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind.lower(), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shape}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [codec], "fill_value": "" if text else False if kind == "Bool" else 0, "attributes": {}}
        self.store.stream("/".join([self.root, path, "c", *["0"] * len(shape)]), self.texts(int(np.prod(shape)), batches) if text else as_bytes(batches, kind))
        self.store.write(f"{self.root}/{path}/zarr.json", json.dumps(node))

    def texts(self, n: int, batches) -> Iterator[bytes]:
        yield struct.pack("<I", n)
        for b in batches:
            yield b"".join(struct.pack("<I", len(x)) + x for x in (v.encode() for v in b))

    def scalar(self, name: str, kind: str, value) -> None:
        self.dense(f"scalars/{name}", kind, [1], [[value]])

    def axis(self, name: str, size: int, batches) -> None:
        self.dense(f"axes/{name}", "String", [size], batches)

    def sparse(self, path: str, kind: str, sizes: dict[str, int], parts: dict[str, Iterable]) -> None:
        self.group(path)
        for name, batches in parts.items():
            self.dense(f"{path}/{name}", kind if name == "nzval" else INDEX, [sizes[name]], batches)


def export(ds: Reader, sink) -> None:
    """Writes all of ds. Matrices whose background is zero become sparse ones; other backgrounds are written out."""
    for name in ds.scalars_set():
        v = ds.get_scalar(name)
        sink.scalar(name, "Bool" if isinstance(v, bool) else "Int64" if isinstance(v, int) else "Float64" if isinstance(v, float) else "String", v)
    places = {}
    for axis in ds.axes_set():
        from ..dataset import numbered

        frame, size = ds.axis_frame(axis), ds.axis_length(axis)
        order = frame.orderBy("pos")
        places[axis] = numbered(frame.select("entry", F.col("pos").alias("__old")), "__old").select("entry", "pos")
        sink.axis(axis, size, pieces(order, "entry"))
        for name in ds.vectors_set(axis):
            sink.dense(f"vectors/{axis}/{name}", model_type(frame.schema[vc(name)].dataType), [size], pieces(order.select(q(vc(name)).alias("value"))))
    for (rows, cols), named in sorted(ds._matrices().items()):
        for name in sorted(named):
            m, path = named[name], f"matrices/{rows}/{cols}/{name}"
            kind = model_type(m.df.schema["value"].dataType)
            cells = m.df if m.background in (None, 0) and not isinstance(m.df.schema["value"].dataType, T.StringType) else ds.query(f"@ {rows} @ {cols} :: {name}").dense()
            r = places[rows].select(F.col("entry").alias("row"), F.col("pos").alias("r"))
            c = places[cols].select(F.col("entry").alias("col"), F.col("pos").alias("c"))
            placed = cells.join(r, "row").join(c, "col").select("r", "c", "value")
            n_rows, n_cols = ds.axis_length(rows), ds.axis_length(cols)
            if m.background is None or cells is not m.df:
                sink.dense(path, kind, [n_cols, n_rows], pieces(placed.orderBy("c", "r")))
                continue
            stored = placed.where(F.col("value") != F.lit(0).cast(placed.schema["value"].dataType))
            counts = {x["c"]: x["n"] for x in stored.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
            pointers = 1 + np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(n_cols)])])
            order = stored.orderBy("c", "r")
            total = int(pointers[-1]) - 1
            sink.sparse(path, kind, {"colptr": n_cols + 1, "rowval": total, "nzval": total}, {"colptr": [pointers], "rowval": pieces(order.select((F.col("r") + 1).alias("value"))), "nzval": pieces(order)})
    sink.finish()


def write_files(ds: Reader, path: str) -> None:
    store = Store(ds.spark)
    if store.exists(f"{path}/daf.json"):
        raise FileExistsError(path)
    export(ds, FlatSink(store, path.rstrip("/")))


def write_zarr(ds: Reader, path: str) -> None:
    store = Store(ds.spark)
    if store.exists(f"{path}/zarr.json"):
        raise FileExistsError(path)
    export(ds, ZarrSink(store, path.rstrip("/")))


def files_to_zarr(spark, source: str, path: str) -> None:
    from .flat_files import read_files

    write_zarr(read_files(spark, source), path)


def zarr_to_files(spark, source: str, path: str) -> None:
    from .zarr import read_zarr

    write_files(read_zarr(spark, source), path)
