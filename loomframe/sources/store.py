"""Data sets on disk, and opening them by address."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..dataset import Dataset, Lazy, Matrix, Reader, read_only

CATALOG = "_catalog.json"


class Store:
    """Small files through Hadoop's file systems, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside, then put in its place in one step."""
        fs, p = self._at(path)
        _, beside = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        how = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        how[0] = getattr(options, "Rename").OVERWRITE
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), how)

    def stream(self, path: str, parts) -> None:
        """A file of parts of bytes, one after the other."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            for part in parts:
                out.write(bytearray(part))
        finally:
            out.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a session on one machine may leave it out."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (top or "/tmp/checkpoints").rstrip("/")


def save(ds: Reader, path: str, overwrite: bool = False) -> None:
    """Writes ds: a Parquet folder per axis and per matrix, and a catalog, last, that names them with their schemas and the
    axes' lengths, so that nothing is read to plan a query. Cells are kept by ranges of rows, in order, so that what is
    reduced by row is nearly done where it is read. A crash leaves the catalog before it, whose folders are still there."""
    store = Store(ds.spark)
    path = path.rstrip("/")
    if store.exists(f"{path}/{CATALOG}") and not overwrite:
        raise FileExistsError(path)
    run = uuid.uuid4().hex[:8]
    catalog = {"schemas": {}, "lengths": {}, "version": 1, "name": ds.name, "scalars": {n: [type(v).__name__, repr(v) if isinstance(v, float) else v] for n, v in ds._scalars().items()}, "axes": {}, "matrices": []}
    old = json.loads(store.read(f"{path}/{CATALOG}")) if store.exists(f"{path}/{CATALOG}") else None
    for k, axis in enumerate(ds.axes_set()):
        catalog["axes"][axis] = folder = f"axes/{run}-{k}"
        frame = ds.axis_frame(axis)
        frame.write.parquet(f"{path}/{folder}")
        catalog["schemas"][folder] = frame.schema.jsonValue()
        catalog["lengths"][axis] = ds.spark.read.schema(frame.schema).parquet(f"{path}/{folder}").count()  # of the files' footers
    for k, ((rows, cols), name, m) in enumerate((key, n, m) for key, named in sorted(ds._matrices().items()) for n, m in sorted(named.items())):
        folder = f"matrices/{run}-{k}"
        m.df.repartitionByRange("row").sortWithinPartitions("row", "col").write.parquet(f"{path}/{folder}")
        catalog["schemas"][folder] = m.df.schema.jsonValue()
        catalog["matrices"].append({"rows": rows, "cols": cols, "name": name, "folder": folder, "background": m.background})
    store.write(f"{path}/{CATALOG}", json.dumps(catalog, indent=1, sort_keys=True))
    for folder in [*(old or {"axes": {}})["axes"].values(), *(x["folder"] for x in (old or {"matrices": []})["matrices"])]:
        store.delete(f"{path}/{folder}")


def load(spark: SparkSession, path: str, mode: str = "r") -> Reader:
    """The data set that save() wrote. Its axes and matrices are scans that take what a query needs."""
    store, path = Store(spark), path.rstrip("/")
    if not store.exists(f"{path}/{CATALOG}"):
        raise FileNotFoundError(path)
    catalog = json.loads(store.read(f"{path}/{CATALOG}"))
    ds = Dataset(spark, catalog["name"])
    kinds = {"bool": bool, "int": int, "float": float, "str": str}
    ds.scalars = {n: kinds[k](v) for n, (k, v) in catalog["scalars"].items()}

    def scan(folder: str):
        schema = catalog.get("schemas", {}).get(folder)
        return (spark.read.schema(T.StructType.fromJson(schema)) if schema else spark.read).parquet(f"{path}/{folder}")

    for a, folder in catalog["axes"].items():
        ds.axes[a] = scan(folder)
    ds.__dict__["_lengths"] = {a: (ds.axes[a], n) for a, n in catalog.get("lengths", {}).items()}
    for m in catalog["matrices"]:
        ds.matrices.setdefault((m["rows"], m["cols"]), Lazy())[m["name"]] = Matrix(scan(m["folder"]), m["background"])
    return read_only(ds) if mode == "r" else ds


class ParquetDataset(Dataset):
    """A data set at a path: loaded as it is, changed in memory, and written by flush()."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r+"):
        super().__init__(spark, path.rstrip("/").rsplit("/", 1)[-1])
        self.path = path
        there = Store(spark).exists(f"{path.rstrip('/')}/{CATALOG}")
        if mode == "w" and there:
            raise FileExistsError(path)
        if mode == "r+" and not there:
            raise FileNotFoundError(path)
        if there and mode not in ("w", "w+"):
            old = load(spark, path, "r+")
            self.scalars, self.axes, self.matrices = old.scalars, old.axes, old.matrices
            self.__dict__["_lengths"] = old.__dict__["_lengths"]

    def flush(self) -> None:
        save(self, self.path, overwrite=True)
        new = load(self.spark, self.path, "r+")
        self.axes, self.matrices = new.axes, new.matrices
        self.__dict__["_lengths"] = new.__dict__["_lengths"]


def open_dataset(spark: SparkSession, uri: str = "", mode: str = "r", name: str | None = None) -> Reader:
    """A data set by address: nothing or memory:// is an empty one in memory; a folder with a catalog is Parquet; one with
    daf.json is the flat-file layout; .daf.zarr is a Zarr folder."""
    from . import flat_files, zarr

    if not uri or uri.startswith("memory://"):
        return Dataset(spark, name or uri.removeprefix("memory://") or "memory")
    if uri.endswith(".h5df") or ".h5df#" in uri:
        raise NotImplementedError(f"HDF5 data sets: {uri}")
    if uri.startswith(("http://", "https://")):
        if ".zip" in uri:
            raise NotImplementedError(f"a zip archive over HTTP: {uri}")
        if mode != "r":
            raise ValueError("data sets over HTTP are read-only")
        return flat_files.read_http(spark, uri, name)
    if ".daf.zarr" in uri:
        return zarr.read_zarr(spark, uri, name)
    if mode == "r" and Store(spark).exists(f"{uri.rstrip('/')}/daf.json"):
        return flat_files.read_files(spark, uri, name)
    return load(spark, uri) if mode == "r" else ParquetDataset(spark, uri, mode)


__all__ = ["ParquetDataset", "Store", "load", "open_dataset", "save"]
