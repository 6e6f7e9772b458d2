"""Zarr version 3 folders of data sets: flat or sharded arrays, dense or as components of sparse ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset, Matrix, Reader, q, read_only, vc
from .arrays import NUMPY, WIDE, Folder, elements, sharded, unpacked
from .flat_files import blank_of, chunks, named


def loaded(node: dict, data: bytes | None):
    """All elements of an array of one chunk, in C order; an absent chunk is of fill values."""
    shape, kind = node["shape"], node["data_type"]
    if data is None:
        return np.full(int(np.prod(shape)), node.get("fill_value"), object if kind == "string" else bool if kind == "bool" else NUMPY[kind])
    first = node["codecs"][0]
    if first["name"] == "sharding_indexed":
        return sharded(data, node, first["configuration"])
    return unpacked(data, node["codecs"], kind)


def read_zarr(spark: SparkSession, path: str, name: str | None = None) -> Reader:
    """The data set in a Zarr folder. An array of several outer chunks is decoded a chunk a row; what is in one chunk is
    decoded in one task. Zip archives and version 2 are refused."""
    if ".zip" in path:
        raise NotImplementedError(f"Zarr in a zip archive: {path}")
    folder = Folder(spark, path)
    if not folder.exists("zarr.json"):
        raise ValueError(f"not a Zarr version 3 folder: {path}")
    ds = Dataset(spark, name or path.rstrip("/").rsplit("/", 1)[-1])

    def array(base: str) -> tuple[dict, bool]:
        """The array's node, and whether it has one chunk."""
        node = folder.json(f"{base}/zarr.json")
        if node["node_type"] != "array":
            raise ValueError(f"not an array: {base}")
        outer = node["chunk_grid"]["configuration"]["chunk_shape"]
        return node, all(a <= b for a, b in zip(node["shape"], outer))

    def part(base: str, column: str):
        """An array of one chunk, and that chunk's bytes as a row."""
        node, _ = array(base)
        key = "/".join(["c", *["0"] * len(node["shape"])])
        there = folder.exists(f"{base}/{key}")
        df = folder.bytes(f"{base}/{key}", column) if there else spark.range(1).select(F.lit(None).cast("binary").alias(column))
        return node, df

    def many(base: str):
        """An array of several chunks as (pos, value), pos counting in C order; chunks that are not stored are of fill
        values."""
        node, _ = array(base)
        shape, outer = node["shape"], node["chunk_grid"]["configuration"]["chunk_shape"]
        grid = [-(-a // b) for a, b in zip(shape, outer)]
        keys = spark.range(int(np.prod(grid))).select(F.col("id").alias("k"))
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder.root}/{base}/c") if folder.exists(f"{base}/c") else None
        content = F.lit(None).cast("binary").alias("a")
        if found is not None:
            place, at = F.regexp_extract("path", r"/c/([0-9/]+)$", 1), F.lit(0).cast("bigint")
            for axis, n in enumerate(grid):
                at = at * n + F.split(place, "/")[axis].cast("bigint")
            keys, content = keys.join(found.select(at.alias("k"), F.col("content").alias("a")), "k", "left"), F.col("a")

        def decode(k: int, data: bytes | None):
            values = np.asarray(loaded(node | {"shape": outer}, data), object if node["data_type"] == "string" else None).reshape(outer)
            corner = [p * o for p, o in zip(np.unravel_index(k, grid), outer)]
            inside = tuple(slice(0, min(o, n - c)) for o, n, c in zip(outer, shape, corner))
            values = values[inside]
            places = np.ravel_multi_index([x + c for x, c in zip(np.indices(values.shape), corner)], shape).ravel()
            values = values.ravel()
            for s in chunks(len(values)):
                yield [places[s], values[s]]

        return node, elements([keys.select("k", content)], decode, f"pos long, value {WIDE[node['data_type']]}")

    def values_of(base: str):
        """(pos, value) of an array, and its type."""
        node, one = array(base)
        if not one:
            node, df = many(base)
            return df, node["data_type"]
        node, df = part(base, "a")

        def dense(data):
            a = loaded(node, data)
            for s in chunks(len(a)):
                yield [np.arange(s.start, s.stop), a[s]]

        return elements([df], dense, f"pos long, value {WIDE[node['data_type']]}"), node["data_type"]

    def vector(base: str):
        if folder.json(f"{base}/zarr.json")["node_type"] == "array":
            return values_of(base)[0], None
        all_true = not folder.exists(f"{base}/nzval/zarr.json")
        if array(f"{base}/nzind")[1] and (all_true or array(f"{base}/nzval")[1]):
            index, places = part(f"{base}/nzind", "a")
            node, values = ({"data_type": "bool"}, None) if all_true else part(f"{base}/nzval", "b")
            kind = node["data_type"]

            def sparse(at, v=None):
                at = np.asarray(loaded(index, at)).astype(np.int64) - 1
                v = np.ones(len(at), bool) if all_true else loaded(node, v)
                for s in chunks(len(at)):
                    yield [at[s], v[s]]

            return elements([places] if values is None else [places, values], sparse, f"pos long, value {WIDE[kind]}"), blank_of(kind)
        at = values_of(f"{base}/nzind")[0].select("pos", (F.col("value") - 1).cast("bigint").alias("at"))
        if all_true:
            return at.select(F.col("at").alias("pos"), F.lit(True).alias("value")), False
        values, kind = values_of(f"{base}/nzval")
        return at.join(values, "pos").select(F.col("at").alias("pos"), "value"), blank_of(kind)

    def matrix(base: str):
        if folder.json(f"{base}/zarr.json")["node_type"] == "array":
            height = array(base)[0]["shape"][1]  # stored as columns by rows
            return values_of(base)[0].select((F.col("pos") % height).alias("r"), F.floor(F.col("pos") / height).cast("bigint").alias("c"), "value"), None
        all_true = not folder.exists(f"{base}/nzval/zarr.json")
        names = ["colptr", "rowval"] + ["nzval"] * (not all_true)
        if all(array(f"{base}/{n}")[1] for n in names):
            pointers, a = part(f"{base}/colptr", "a")
            places, b = part(f"{base}/rowval", "b")
            node, d = ({"data_type": "bool"}, None) if all_true else part(f"{base}/nzval", "d")
            kind = node["data_type"]

            def sparse(p, at, v=None):
                p, at = np.asarray(loaded(pointers, p)).astype(np.int64), np.asarray(loaded(places, at)).astype(np.int64)
                c = np.repeat(np.arange(len(p) - 1), np.diff(p))
                v = np.ones(len(at), bool) if all_true else loaded(node, v)
                for s in chunks(len(at)):
                    yield [at[s] - 1, c[s], v[s]]

            return elements([a, b] if d is None else [a, b, d], sparse, f"r long, c long, value {WIDE[kind]}"), blank_of(kind)
        # column c has the values from its pointer to the next one's
        starts = values_of(f"{base}/colptr")[0].select("pos", (F.col("value") - 1).cast("bigint").alias("at"))
        ends = starts.select((F.col("pos") - 1).alias("pos"), F.col("at").alias("end"))
        own = starts.join(ends, "pos").where("end > at").select(F.col("pos").alias("c"), F.explode(F.sequence("at", F.col("end") - 1)).alias("pos"))
        cells = own.join(values_of(f"{base}/rowval")[0].select("pos", (F.col("value") - 1).cast("bigint").alias("r")), "pos")
        if all_true:
            return cells.select("r", "c", F.lit(True).alias("value")), False
        values, kind = values_of(f"{base}/nzval")
        return cells.join(values, "pos").select("r", "c", "value"), blank_of(kind)

    def nodes(path: str) -> list[str]:
        return [n for n in folder.names(path) if folder.exists(f"{path}/{n}/zarr.json")]

    for n in nodes("scalars"):
        ds.scalars[n] = vector(f"scalars/{n}")[0].first()["value"]
    for a in nodes("axes"):
        ds.axes[a] = vector(f"axes/{a}")[0].select(F.col("value").alias("entry"), "pos")
    for axis in list(ds.axes):
        frame = ds.axes[axis]
        for n in nodes(f"vectors/{axis}"):
            values, blank = vector(f"vectors/{axis}/{n}")
            frame = frame.join(values.withColumnRenamed("value", vc(n)), "pos", "left")
            if blank is not None:
                frame = frame.withColumn(vc(n), F.coalesce(q(vc(n)), F.lit(blank)))
        ds.axes[axis] = frame.select("entry", "pos", *(q(c) for c in frame.columns if c.startswith("v_")))
    for rows in nodes("matrices"):
        for cols in nodes(f"matrices/{rows}"):
            for n in nodes(f"matrices/{rows}/{cols}"):
                if n not in ds.matrices.get((cols, rows), {}):
                    cells, background = matrix(f"matrices/{rows}/{cols}/{n}")
                    ds.matrices.setdefault((rows, cols), {})[n] = Matrix(named(cells, ds.axes[rows], ds.axes[cols]), background)
    return read_only(ds)
