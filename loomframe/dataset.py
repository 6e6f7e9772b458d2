"""Data sets: scalars, axes, vectors and matrices, each kept as lazy DataFrames under a catalog of names."""

from __future__ import annotations

from collections import UserDict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from inspect import isfunction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import guarded, model_type
from .plans.nodes import nodes_of

BAD_IN_NAMES = set('/\\:,\n\r\t\0')
VIRTUAL = ("name", "index")


class Lazy(UserDict):
    """A mapping whose values may be functions without arguments, called when they are first asked for, so that opening a
    data set touches none of its tables."""

    def __getitem__(self, key):
        value = self.data[key]
        if isfunction(value) or isinstance(value, partial):
            value = self.data[key] = value()
        return value


def checked_name(name: str, what: str = "name") -> str:
    if not name or name != name.strip() or set(name) & BAD_IN_NAMES:
        raise ValueError(f"invalid {what}: {name!r}")
    return name


def vc(name: str) -> str:
    """The column of an axis's frame that holds a vector."""
    return f"v_{name}"


def q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Matrix:
    """Cells (row, col, value). background: the value of cells that are not stored, or None if all are."""

    df: DataFrame
    background: object = None

    @property
    def is_sparse(self) -> bool:
        return self.background is not None


class Reader:
    """What every data set answers. Subclasses give _scalars, _axes, _matrices as mappings."""

    name: str
    spark: SparkSession
    writable = False

    # scalars: name -> value; axes: name -> frame (entry, pos, v_<vector>...); matrices: (rows, cols) -> name -> Matrix
    def _scalars(self) -> Mapping[str, object]:
        raise NotImplementedError

    def _axes(self) -> Mapping[str, DataFrame]:
        raise NotImplementedError

    def _matrices(self) -> Mapping[tuple[str, str], Mapping[str, Matrix]]:
        raise NotImplementedError

    # scalars
    def has_scalar(self, name: str) -> bool:
        return name in self._scalars()

    def scalars_set(self) -> list[str]:
        return sorted(self._scalars())

    def get_scalar(self, name: str, *default):
        got = self._scalars()
        if name in got:
            return got[name]
        if default:
            return default[0]
        raise KeyError(f"missing scalar: {name} in the data set: {self.name}")

    # axes
    def has_axis(self, axis: str) -> bool:
        return axis in self._axes()

    def axes_set(self) -> list[str]:
        return sorted(self._axes())

    def axis_frame(self, axis: str) -> DataFrame:
        """The axis as a DataFrame: entry, pos from 0, and a column v_<name> for each vector."""
        got = self._axes()
        if axis not in got:
            raise KeyError(f"missing axis: {axis} in the data set: {self.name}")
        return got[axis]

    def axis_length(self, axis: str) -> int:
        frame, memo = self.axis_frame(axis), self.__dict__.setdefault("_lengths", {})
        if memo.get(axis, (None,))[0] is not frame:
            memo[axis] = (frame, frame.select("pos").count())
        return memo[axis][1]

    def places(self, axis: str) -> DataFrame:
        """entry and __place: each entry's number from 0 in the axis's order, without gaps, which pos may have."""
        frame, memo = self.axis_frame(axis), self.__dict__.setdefault("_places", {})
        if memo.get(axis, (None,))[0] is not frame:
            known = frame.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b")).first()
            gapless = not known["n"] or (known["a"], known["b"]) == (0, known["n"] - 1)
            memo[axis] = (frame, frame.select("entry", F.col("pos").alias("__place")) if gapless else placed(frame))
        return memo[axis][1]

    def axis_entries(self, axis: str, indices: Sequence[int] | None = None) -> list[str]:
        """Entries in order (or those at 1-based indices); for axes that fit the driver."""
        frame = self.axis_frame(axis)
        if indices is not None:
            rows = {r["__place"] + 1: r["entry"] for r in self.places(axis).where(F.col("__place").isin([i - 1 for i in indices if i])).collect()}
            return ["" if not i else rows[i] for i in indices]
        return [r["entry"] for r in frame.select("entry", "pos").orderBy("pos").collect()]

    axis_vector = axis_entries

    def axis_indices(self, axis: str, entries: Sequence[str], allow_empty: bool = False, allow_missing: bool = False) -> list[int]:
        """1-based places of entries; 0 for an empty or missing one where that is allowed."""
        known = {r["entry"]: r["__place"] + 1 for r in self.places(axis).where(F.col("entry").isin(list(set(entries)))).collect()}
        out = []
        for e in entries:
            if e in known:
                out.append(known[e])
            elif (allow_empty and e == "") or allow_missing:
                out.append(0)
            else:
                raise KeyError(f"missing entry: {e} of the axis: {axis}")
        return out

    def axis_dict(self, axis: str) -> dict[str, int]:
        return {e: i + 1 for i, e in enumerate(self.axis_entries(axis))}

    # vectors
    def has_vector(self, axis: str, name: str) -> bool:
        return name in VIRTUAL or vc(name) in self.axis_frame(axis).columns

    def vectors_set(self, axis: str) -> list[str]:
        return sorted(c[2:] for c in self.axis_frame(axis).columns if c.startswith("v_"))

    def vector_column(self, axis: str, name: str) -> Column:
        """The column of with_vector()'s frame that holds a vector."""
        return F.col("entry") if name == "name" else (F.col("__place") + 1).cast("bigint") if name == "index" else q(vc(name))

    def with_vector(self, axis: str, name: str, frame: DataFrame | None = None) -> DataFrame:
        """The axis's frame, or what is left of it, with all that vector_column() reads."""
        frame = self.axis_frame(axis) if frame is None else frame
        return frame.join(self.places(axis), "entry") if name == "index" and "__place" not in frame.columns else frame

    def get_vector(self, axis: str, name: str, *default) -> DataFrame:
        """entry, pos, value; a default is a value for all entries, or a sequence in axis order."""
        frame = self.axis_frame(axis)
        if self.has_vector(axis, name):
            return self.with_vector(axis, name, frame).select("entry", "pos", self.vector_column(axis, name).alias("value"))
        if not default:
            raise KeyError(f"missing vector: {name} of the axis: {axis} in the data set: {self.name}")
        if isinstance(default[0], (list, tuple)):
            if len(default[0]) != self.axis_length(axis):
                raise ValueError("the default's length is not the axis's")
            values = self.spark.createDataFrame([(i, v) for i, v in enumerate(default[0])], ["pos", "value"])
            return frame.select("entry", "pos").join(values, "pos")
        return frame.select("entry", "pos", F.lit(default[0]).alias("value"))

    # matrices
    def _matrix(self, rows: str, cols: str, name: str) -> Matrix | None:
        got = self._matrices()
        if name in got.get((rows, cols), ()):
            return got[rows, cols][name]
        if name in got.get((cols, rows), ()):
            m = got[cols, rows][name]
            return Matrix(m.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), m.background)
        return None

    def has_matrix(self, rows: str, cols: str, name: str, relayout: bool = True) -> bool:
        got = self._matrices()
        return name in got.get((rows, cols), ()) or (relayout and name in got.get((cols, rows), ()))

    def matrices_set(self, rows: str, cols: str, relayout: bool = True) -> list[str]:
        got = self._matrices()
        return sorted({*got.get((rows, cols), ()), *(got.get((cols, rows), ()) if relayout else ())})

    def matrix(self, rows: str, cols: str, name: str, *default) -> Matrix:
        for axis in (rows, cols):
            self.axis_frame(axis)
        m = self._matrix(rows, cols, name)
        if m is not None:
            return m
        if default:
            empty = self.spark.createDataFrame([], f"row string, col string, value {_spark_type(default[0])}")
            return Matrix(empty, default[0])
        raise KeyError(f"missing matrix: {name} of the rows axis: {rows} and the columns axis: {cols} in the data set: {self.name}")

    def get_matrix(self, rows: str, cols: str, name: str, *default) -> DataFrame:
        """row, col, value of the cells that are stored."""
        return self.matrix(rows, cols, name, *default).df

    # queries
    def query(self, query):
        """A lazy result of a query in text or builder form; one that was asked for before is not planned again."""
        from .config import planned

        return planned(self, query)

    get_query = __getitem__ = query

    def has_query(self, query) -> bool:
        """Whether the query has an answer that is not empty: it fits the data set, and its first row can be computed."""
        nodes_of(query)  # text that is no query is an error
        try:
            result = self.query(query)
            return len((result.df if result.kind != "matrix" else result.dense()).limit(1).collect()) > 0
        except Exception:  # noqa: BLE001  any failure means that it can't
            return False

    def tbl(self, axis: str):
        from .tidy import Table

        return Table(self, axis)

    def get_dataframe(self, axis: str, columns: Iterable[str] | Mapping[str, str] | None = None) -> DataFrame:
        """One row per entry (or per entry of an axis query), one column per vector or query: name, then the columns."""
        from .tidy import frame_of

        return frame_of(self, axis, columns)

    def get_tidy(self, axis: str, columns=None) -> DataFrame:
        """name, key, value (as text) for each entry and column."""
        wide = self.get_dataframe(axis, columns)
        keys = [c for c in wide.columns if c != "name"]
        return wide.select("name", *(q(c).cast("string").alias(c) for c in keys)).unpivot("name", keys, "key", "value")

    def description(self) -> str:
        out = [f"name: {self.name}", f"type: {type(self).__name__}"]
        if self.scalars_set():
            out += ["scalars:", *(f"  {n}: {self.get_scalar(n)!r}" for n in self.scalars_set())]
        out += ["axes:", *(f"  {a}: {self.axis_length(a)} entries" for a in self.axes_set())]
        vectors = [(a, v, self.axis_frame(a).schema[vc(v)].dataType) for a in self.axes_set() for v in self.vectors_set(a)]
        out += ["vectors:"] if vectors else []
        out += [f"  {a}.{v}: {model_type(t)}" for a, v, t in vectors]
        cells = [(r, c, n, m) for (r, c), ms in sorted(self._matrices().items()) for n, m in sorted(ms.items())]
        out += ["matrices:"] if cells else []
        out += [f"  {r},{c}.{n}: {model_type(m.df.schema['value'].dataType)} {'sparse' if m.is_sparse else 'dense'}" for r, c, n, m in cells]
        return "\n".join(out)

    def is_leaf(self) -> bool:
        return True


def _spark_type(value) -> str:
    return "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "string" if isinstance(value, str) else "double"


class Dataset(Reader):
    """A data set in memory: a catalog of DataFrames. Nothing is computed until a result is used."""

    writable = True

    def __init__(self, spark: SparkSession, name: str = "memory"):
        self.spark, self.name = spark, name
        self.scalars: dict[str, object] = {}
        self.axes: Mapping[str, DataFrame] = Lazy()
        self.matrices: dict[tuple[str, str], Mapping[str, Matrix]] = {}
        self.versions: dict[tuple, int] = {}

    def _scalars(self):
        return self.scalars

    def _axes(self):
        return self.axes

    def _matrices(self):
        return self.matrices

    def _bump(self, *key) -> None:
        self.versions[key] = self.versions.get(key, 0) + 1

    def version(self, *key) -> int:
        """How often a property has changed."""
        return self.versions.get(key, 0)

    def set_scalar(self, name: str, value, overwrite: bool = False) -> None:
        checked_name(name)
        if value is None or not isinstance(value, (bool, int, float, str)):
            raise TypeError(f"not a scalar: {value!r}")
        if name in self.scalars and not overwrite:
            raise KeyError(f"existing scalar: {name}")
        self.scalars[name] = value
        self._bump("scalar", name)

    def delete_scalar(self, name: str, must_exist: bool = True) -> None:
        if name not in self.scalars and must_exist:
            raise KeyError(f"missing scalar: {name}")
        self.scalars.pop(name, None)
        self._bump("scalar", name)

    def add_axis(self, axis: str, entries: Sequence[str] | DataFrame, check: bool = True) -> None:
        """A new axis of a list of entries, or of a DataFrame with entry and, to order it, pos (else entries are ordered
        bytewise, over range partitions). Further columns become vectors."""
        checked_name(axis, "axis name")
        if axis in self.axes:
            raise KeyError(f"existing axis: {axis}")
        if isinstance(entries, DataFrame):
            frame = entries if "pos" in entries.columns else numbered(entries)
            vectors = [c for c in frame.columns if c not in ("entry", "pos")]
            frame = frame.select(F.col("entry").cast("string").alias("entry"), F.col("pos").cast("bigint").alias("pos"), *(filled(frame, c).alias(vc(c)) for c in vectors))
            if check:
                bad = frame.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entry").alias("d"), F.coalesce(F.sum((F.coalesce("entry", F.lit("")) == "").cast("int")), F.lit(0)).alias("e")).first()
                if bad["n"] != bad["d"] or bad["e"]:
                    raise ValueError(f"repeated, empty or missing entries of the axis: {axis}")
        else:
            entries = list(entries)
            if len(set(entries)) != len(entries) or any(not isinstance(e, str) or not e for e in entries):
                raise ValueError(f"repeated, empty or missing entries of the axis: {axis}")
            frame = self.spark.createDataFrame([(e, i) for i, e in enumerate(entries)], "entry string, pos long")
        self.axes[axis] = frame
        self._bump("axis", axis)

    def delete_axis(self, axis: str, must_exist: bool = True) -> None:
        """Removes the axis with its vectors and matrices."""
        if axis not in self.axes and must_exist:
            raise KeyError(f"missing axis: {axis}")
        self.axes.pop(axis, None)
        for key in [k for k in self.matrices if axis in k]:
            del self.matrices[key]
        self._bump("axis", axis)

    def set_vector(self, axis: str, name: str, values, overwrite: bool = False) -> None:
        """values: one value for all, a list in axis order, a mapping from all entries, a DataFrame (entry, value), or a
        Column over the axis's frame."""
        checked_name(name)
        if name in VIRTUAL:
            raise ValueError(f"reserved vector: {name}")
        frame = self.axis_frame(axis)
        if vc(name) in frame.columns:
            if not overwrite:
                raise KeyError(f"existing vector: {name} of the axis: {axis}")
            if isinstance(values, Column):
                frame = frame.withColumn("__new", values)
                values = F.col("__new")
            frame = frame.drop(vc(name))
        if isinstance(values, Column):
            frame = frame.withColumn(vc(name), values)
        elif isinstance(values, (DataFrame, Mapping, list, tuple)):
            if isinstance(values, Mapping):
                unknown = set(values) ^ set(self.axis_entries(axis))
                if unknown:
                    raise KeyError(f"entries that are not the axis's: {sorted(unknown)[:5]}")
                values = self.spark.createDataFrame(list(values.items()), ["entry", "value"])
            if isinstance(values, DataFrame):
                frame = frame.join(values.select("entry", filled(values, "value").alias(vc(name))), "entry", "left")
                frame = frame.withColumn(vc(name), F.coalesce(q(vc(name)), F.lit(""))) if dict(frame.dtypes)[vc(name)] == "string" else guarded(frame, q(vc(name)).isNull(), f"missing values of the vector: {name}")
            else:
                if len(values) != self.axis_length(axis):
                    raise ValueError(f"{len(values)} values for the {self.axis_length(axis)} entries of the axis: {axis}")
                rows = list(enumerate(_alike(values)))
                frame = frame.join(self.spark.createDataFrame(rows, f"pos long, `{vc(name)}` {_list_type(values)}"), "pos", "left")
        else:
            frame = frame.withColumn(vc(name), F.lit(values))
        self.axes[axis] = frame.select("entry", "pos", *(q(c) for c in frame.columns if c.startswith("v_")))
        self._bump("vector", axis, name)

    def delete_vector(self, axis: str, name: str, must_exist: bool = True) -> None:
        if not (name not in VIRTUAL and self.has_vector(axis, name)) and must_exist:
            raise KeyError(f"missing vector: {name} of the axis: {axis}")
        self.axes[axis] = self.axes[axis].drop(vc(name))
        self._bump("vector", axis, name)

    def set_matrix(self, rows: str, cols: str, name: str, cells, background=None, overwrite: bool = False, relayout: bool = True) -> None:
        """cells: a DataFrame (row, col, value), or a list of rows of values. background: the value of cells that the
        DataFrame lacks (None: it has all). relayout is accepted; cells have no orientation."""
        checked_name(name)
        for axis in (rows, cols):
            self.axis_frame(axis)
        if self.has_matrix(rows, cols, name) and not overwrite:
            raise KeyError(f"existing matrix: {name} of the rows axis: {rows} and the columns axis: {cols}")
        if not isinstance(cells, DataFrame):
            r, c = self.axis_entries(rows), self.axis_entries(cols)
            if len(cells) != len(r) or any(len(x) != len(c) for x in cells):
                raise ValueError("the matrix's shape is not the axes'")
            values = [v for x in cells for v in x]
            flat = [(a, b, v) for (a, b), v in zip(((a, b) for a in r for b in c), _alike(values))]
            cells = self.spark.createDataFrame(flat, f"row string, col string, value {_list_type(values)}")
        if rows != cols:
            self.matrices.get((cols, rows), {}).pop(name, None)
        self.matrices.setdefault((rows, cols), Lazy())[name] = Matrix(cells.select(F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col"), "value"), background)
        self._bump("matrix", rows, cols, name)

    def relayout_matrix(self, rows: str, cols: str, name: str) -> None:
        self.matrix(rows, cols, name)

    def delete_matrix(self, rows: str, cols: str, name: str, must_exist: bool = True) -> None:
        if not self.has_matrix(rows, cols, name) and must_exist:
            raise KeyError(f"missing matrix: {name}")
        for key in ((rows, cols), (cols, rows)):
            self.matrices.get(key, {}).pop(name, None)
        self._bump("matrix", rows, cols, name)


def memory_dataset(spark: SparkSession, name: str = "memory") -> Dataset:
    """An empty data set in memory."""
    return Dataset(spark, name)


def _list_type(values: Sequence) -> str:
    kinds = {type(v) for v in values}
    for kind, text in ((str, "string"), (float, "double"), (int, "bigint"), (bool, "boolean")):
        if kind in kinds:
            return text
    return "double"


def _alike(values: Sequence) -> list:
    """The values as one Python type, that of _list_type."""
    return [float(v) for v in values] if _list_type(values) == "double" else list(values)


def filled(df: DataFrame, name: str) -> Column:
    """A column whose missing strings are empty strings."""
    return F.coalesce(q(name), F.lit("")) if dict(df.dtypes)[name] == "string" else q(name)


#: Rows of one range when rows are numbered, about.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, order: str = "entry") -> DataFrame:
    """df with pos 0.. in the order of a column of distinct values.

    Rows are numbered within ranges of the column, and each range after the rows of those before. The ranges' bounds are
    fixed values from a sample that is taken at once, so that numbers do not depend on how a plan is cut into tasks or on
    tasks that run again.
    """
    n = df.count()
    ranges = min(500, n // RANGE_ROWS + 1)
    bounds = []
    if ranges > 1:
        sample = sorted(r[0] for r in df.select(q(order)).sample(min(1.0, 100 * ranges / n), seed=1).collect())
        bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    key = q(order)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)) if bounds else F.lit(0)
    parted = df.withColumn("__part", part)
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most 500 rows
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return parted.withColumn("__place", place).join(base, "__part").withColumn("pos", (F.col("__base") + F.col("__place")).cast("bigint")).drop("__part", "__place", "__base")


def placed(frame: DataFrame, order: str = "pos") -> DataFrame:
    """entry and __place, numbered from 0 in the order of a column of distinct values."""
    return numbered(frame.select("entry", q(order).alias("__order")), "__order").select("entry", F.col("pos").alias("__place"))


class ReadOnly(Reader):
    """A data set that refuses changes."""

    def __init__(self, base: Reader, name: str | None = None):
        self.base, self.spark, self.name = base, base.spark, name or base.name

    def axis_length(self, axis: str) -> int:
        return self.base.axis_length(axis)

    def places(self, axis: str) -> DataFrame:
        return self.base.places(axis)

    def _scalars(self):
        return self.base._scalars()

    def _axes(self):
        return self.base._axes()

    def _matrices(self):
        return self.base._matrices()


def read_only(base: Reader, name: str | None = None) -> ReadOnly:
    return base if isinstance(base, ReadOnly) and name is None else ReadOnly(base, name)


__all__ = ["Dataset", "Matrix", "ReadOnly", "Reader", "memory_dataset", "read_only"]
