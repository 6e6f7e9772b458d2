"""Data sets in the shape of an annotated matrix: X, obs, var, layers, uns; and such matrices kept as Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset, Reader, numbered
from .store import Store


class AnnotatedMatrix:
    """A read-only facade. obs: the axis of rows (cell, or metacell); var: that of columns (gene); X: the matrix by the
    name given, UMIs if there is one, or the only one. All are lazy DataFrames."""

    def __init__(self, ds: Reader, obs: str | None = None, var: str | None = None, x: str | None = None):
        pick = lambda given, names: given or next((n for n in names if ds.has_axis(n)), None)
        self.ds, self.obs_axis, self.var_axis = ds, pick(obs, ("cell", "metacell")), pick(var, ("gene",))
        if self.obs_axis is None or self.var_axis is None:
            raise KeyError("no axes for obs and var")
        names = ds.matrices_set(self.obs_axis, self.var_axis)
        self.x = x or ("UMIs" if "UMIs" in names else names[0] if len(names) == 1 else None)

    @property
    def X(self) -> DataFrame:  # noqa: N802
        if self.x is None:
            raise KeyError("no matrix for X")
        return self.ds.get_matrix(self.obs_axis, self.var_axis, self.x)

    @property
    def layers(self) -> dict[str, DataFrame]:
        return {n: self.ds.get_matrix(self.obs_axis, self.var_axis, n) for n in self.ds.matrices_set(self.obs_axis, self.var_axis) if n != self.x}

    @property
    def obs(self) -> DataFrame:
        return self.ds.get_dataframe(self.obs_axis)

    @property
    def var(self) -> DataFrame:
        return self.ds.get_dataframe(self.var_axis)

    @property
    def obs_names(self) -> list[str]:
        return self.ds.axis_entries(self.obs_axis)

    @property
    def var_names(self) -> list[str]:
        return self.ds.axis_entries(self.var_axis)

    @property
    def n_obs(self) -> int:
        return self.ds.axis_length(self.obs_axis)

    @property
    def n_vars(self) -> int:
        return self.ds.axis_length(self.var_axis)

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs, self.n_vars

    @property
    def uns(self) -> dict[str, object]:
        return {n: self.ds.get_scalar(n) for n in self.ds.scalars_set()}


def as_anndata(ds: Reader, obs: str | None = None, var: str | None = None, x: str | None = None) -> AnnotatedMatrix:
    return AnnotatedMatrix(ds, obs, var, x)


def write_annotated(ds: Reader, path: str, obs: str | None = None, var: str | None = None, x: str | None = None) -> None:
    """Writes an annotated matrix as Parquet: obs and var (name, pos and a column a vector), X and layers/<name> (row, col,
    value of the stored cells), obsm/<name> and varm/<name> (row, col, value) for matrices on an axis <kind>_<name>_dim, and
    uns.json: the scalars, and the background of each matrix."""
    a, path = as_anndata(ds, obs, var, x), path.rstrip("/")
    store = Store(ds.spark)
    if store.exists(f"{path}/uns.json"):
        raise FileExistsError(path)
    backgrounds = {}

    def put(folder: str, rows: str, cols: str, name: str) -> None:
        m = ds.matrix(rows, cols, name)
        m.df.write.parquet(f"{path}/{folder}")
        backgrounds[folder] = m.background

    for kind, axis in (("obs", a.obs_axis), ("var", a.var_axis)):
        frame = ds.axis_frame(axis)
        frame.select(F.col("entry").alias("name"), "pos", *(F.col(f"`v_{v}`").alias(v) for v in ds.vectors_set(axis))).write.parquet(f"{path}/{kind}")
        for other in ds.axes_set():
            if other.startswith(f"{kind}_") and other.endswith("_dim"):
                for name in ds.matrices_set(axis, other):
                    put(f"{kind}m/{name}", axis, other, name)
    if a.x is not None:
        put("X", a.obs_axis, a.var_axis, a.x)
    for name in a.layers:
        put(f"layers/{name}", a.obs_axis, a.var_axis, name)
    store.write(f"{path}/uns.json", json.dumps({"uns": a.uns, "backgrounds": backgrounds}))


def read_annotated(spark: SparkSession, path: str, name: str | None = None) -> Dataset:
    """The annotated matrix that write_annotated(), or another program in this layout, wrote: axes obs and var, the matrix
    UMIs of X, a matrix for each layer, and for each obsm and varm one on the axis <kind>_<name>_dim. Tables without pos are
    in the order of their names. Nested uns are flattened by _; what is no scalar in them is left out."""
    store, path = Store(spark), path.rstrip("/")
    said = json.loads(store.read(f"{path}/uns.json")) if store.exists(f"{path}/uns.json") else {}
    ds = Dataset(spark, name or path.rsplit("/", 1)[-1])

    def flattened(prefix: str, values: dict) -> None:
        for k, v in values.items():
            if isinstance(v, dict):
                flattened(f"{prefix}{k}_", v)
            elif isinstance(v, (bool, int, float, str)):
                ds.set_scalar(f"{prefix}{k}", v)

    flattened("", said.get("uns", {}))
    for axis in ("obs", "var"):
        ds.add_axis(axis, spark.read.parquet(f"{path}/{axis}").withColumnRenamed("name", "entry"))
    held = lambda folder: said.get("backgrounds", {}).get(folder)
    if store.exists(f"{path}/X"):
        ds.set_matrix("obs", "var", "UMIs", spark.read.parquet(f"{path}/X"), held("X"))
    for layer in store.names(f"{path}/layers"):
        ds.set_matrix("obs", "var", layer, spark.read.parquet(f"{path}/layers/{layer}"), held(f"layers/{layer}"))
    for kind in ("obs", "var"):
        for m in store.names(f"{path}/{kind}m"):
            cells, axis = spark.read.parquet(f"{path}/{kind}m/{m}"), f"{kind}_{m}_dim"
            dims = cells.select(F.col("col").alias("entry"), F.col("col").cast("bigint").alias("__at")).distinct()
            ds.add_axis(axis, numbered(dims, "__at").select("entry", "pos"))
            ds.set_matrix(kind, axis, m, cells, held(f"{kind}m/{m}"))
    return ds
