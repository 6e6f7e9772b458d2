"""The flat-file layout of data sets: daf.json, scalars, axes, vectors and matrices as plain files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset, Matrix, Reader, q, read_only, vc
from .arrays import BATCH, WIDE, Folder, Site, elements, lines, numbers


def read_files(spark: SparkSession, path: str, name: str | None = None) -> Reader:
    """The data set in a folder. Small descriptors are read at once, and each array when a query needs it."""
    return read_from(Folder(spark, path), spark, name or path.rstrip("/").rsplit("/", 1)[-1])


def read_http(spark: SparkSession, url: str, name: str | None = None) -> Reader:
    return read_from(Site(spark, url), spark, name or url)


def chunks(n: int) -> Iterator[slice]:
    for at in range(0, n, BATCH):
        yield slice(at, min(at + BATCH, n))


def numbered_lines(source, path: str) -> DataFrame:
    def decode(data: bytes):
        all_ = lines(data)
        for s in chunks(len(all_)):
            yield [np.arange(s.start, s.stop), all_[s]]

    return elements([source.bytes(path, "a")], decode, "pos long, entry string")


def part_type(meta: dict, part: str, default: str) -> str:
    """Element type of a component: of its own descriptor, or the older single one."""
    own = meta.get(part)
    return (own["eltype"] if isinstance(own, dict) else default).lower()


def read_from(source, spark: SparkSession, name: str) -> Reader:
    version = source.json("daf.json")["version"]
    if version[0] != 1 or version[1] > 1:
        raise ValueError(f"data sets of version {version}")
    ds = Dataset(spark, name)
    for f in source.names("scalars"):
        if f.endswith(".json"):
            x = source.json(f"scalars/{f}")
            kind = x["type"].lower()
            ds.scalars[f[:-5]] = bool(x["value"]) if kind == "bool" else float(x["value"]) if kind.startswith("float") else x["value"]
    for f in source.names("axes"):
        if f.endswith(".txt"):
            ds.axes[f[:-4]] = numbered_lines(source, f"axes/{f}").select("entry", "pos")
    for axis in list(ds.axes):
        frame = ds.axes[axis]
        for f in source.names(f"vectors/{axis}"):
            if f.endswith(".json"):
                values, blank = vector(source, f"vectors/{axis}/{f[:-5]}", source.json(f"vectors/{axis}/{f}"))
                frame = frame.join(values.withColumnRenamed("value", vc(f[:-5])), "pos", "left")
                if blank is not None:
                    frame = frame.withColumn(vc(f[:-5]), F.coalesce(q(vc(f[:-5])), F.lit(blank)))
        ds.axes[axis] = frame.select("entry", "pos", *(q(c) for c in frame.columns if c.startswith("v_")))
    for rows in source.names("matrices"):
        for cols in source.names(f"matrices/{rows}"):
            for f in source.names(f"matrices/{rows}/{cols}"):
                if f.endswith(".json") and f[:-5] not in ds._matrices().get((cols, rows), {}):
                    cells, background = matrix(source, f"matrices/{rows}/{cols}/{f[:-5]}", source.json(f"matrices/{rows}/{cols}/{f}"), ds.axes[rows])
                    ds.matrices.setdefault((rows, cols), {})[f[:-5]] = Matrix(named(cells, ds.axes[rows], ds.axes[cols]), background)
    return read_only(ds)


def named(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells by places as cells by entries."""
    r, c = rows.select(F.col("entry").alias("row"), F.col("pos").alias("r")), cols.select(F.col("entry").alias("col"), F.col("pos").alias("c"))
    return cells.join(r, "r").join(c, "c").select("row", "col", "value")


def blank_of(kind: str):
    return "" if kind == "string" else False if kind == "bool" else 0


def vector(source, base: str, meta: dict) -> tuple[DataFrame, object]:
    """(pos, value) of what a vector stores, and the value of the rest."""
    kind = part_type(meta, "nzval", meta.get("eltype", "bool"))
    if meta["format"] == "dense":
        if kind == "string":
            return numbered_lines(source, f"{base}.txt").select("pos", F.col("entry").alias("value")), None

        def dense(data: bytes):
            a = numbers(data, kind)
            for s in chunks(len(a)):
                yield [np.arange(s.start, s.stop), a[s]]

        return elements([source.bytes(f"{base}.data", "a")], dense, f"pos long, value {WIDE[kind]}"), None
    index = part_type(meta, "nzind", meta.get("indtype", "int64"))
    end = "nztxt" if kind == "string" else "nzval"
    parts = [source.bytes(f"{base}.nzind", "a")]
    if source.exists(f"{base}.{end}") or kind != "bool":
        parts.append(source.bytes(f"{base}.{end}", "b"))

    def sparse(places: bytes, values: bytes | None = None):
        at = numbers(places, index).astype(np.int64) - 1
        v = np.ones(len(at), bool) if values is None else lines(values) if kind == "string" else numbers(values, kind)
        for s in chunks(len(at)):
            yield [at[s], v[s]]

    return elements(parts, sparse, f"pos long, value {WIDE[kind]}"), blank_of(kind)


def matrix(source, base: str, meta: dict, rows: DataFrame) -> tuple[DataFrame, object]:
    """(r, c, value) of what a matrix stores, by columns, and the value of the rest."""
    kind = part_type(meta, "nzval", meta.get("eltype", "bool"))
    if meta["format"] == "dense":
        # columns follow each other; the length of one is the rows axis's
        height = rows.agg(F.count(F.lit(1)).alias("h"))
        part = source.bytes(f"{base}.txt" if kind == "string" else f"{base}.data", "a")

        def dense(data: bytes, h: int):
            a = lines(data) if kind == "string" else numbers(data, kind)
            for s in chunks(len(a)):
                at = np.arange(s.start, s.stop)
                yield [at % h, at // h, a[s]]

        return elements([part, height], dense, f"r long, c long, value {WIDE[kind]}"), None
    first, second = part_type(meta, "colptr", meta.get("indtype", "int64")), part_type(meta, "rowval", meta.get("indtype", "int64"))
    end = "nztxt" if kind == "string" else "nzval"
    parts = [source.bytes(f"{base}.colptr", "a"), source.bytes(f"{base}.rowval", "b")]
    if source.exists(f"{base}.{end}") or kind != "bool":
        parts.append(source.bytes(f"{base}.{end}", "d"))

    def sparse(pointers: bytes, places: bytes, values: bytes | None = None):
        ptr, r = numbers(pointers, first).astype(np.int64), numbers(places, second).astype(np.int64) - 1
        c = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        v = np.ones(len(r), bool) if values is None else lines(values) if kind == "string" else numbers(values, kind)
        for s in chunks(len(r)):
            yield [r[s], c[s], v[s]]

    return elements(parts, sparse, f"r long, c long, value {WIDE[kind]}"), blank_of(kind)


__all__ = ["read_files", "read_http"]
