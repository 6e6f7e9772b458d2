"""Queries as lazy plans: nodes are read phrase by phrase and become DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import inefficient
from ..dataset import Matrix, Reader, placed
from ..functions import eltwise
from ..functions.columns import SPARK, compared, guarded, is_real, truthy
from ..functions.reductions import Reduction
from .nodes import COMPARISONS, Node, QueryError, canonical_query, nodes_of, number

REDUCES = ("ReduceToScalar", "ReduceToColumn", "ReduceToRow")


@dataclass
class Result:
    """A query's lazy result. df: name; value; entry; entry and value; or row, col and value of the stored cells."""

    kind: str
    df: DataFrame
    order: DataFrame | None = None
    every_cell: Callable[[], DataFrame] | None = None
    background: object = None

    def dense(self) -> DataFrame:
        """A matrix with a row for every cell."""
        return self.every_cell() if self.every_cell is not None else self.df

    def collect(self):
        """Names, a value, entries, or a dict of values by entry (in axis order) or by (row, col)."""
        if self.kind == "scalar":
            rows = self.df.collect()
            if len(rows) != 1:
                raise QueryError("missing entry")
            return rows[0][0]
        if self.kind == "names":
            return [r[0] for r in self.df.orderBy("name").collect()]
        if self.kind == "matrix":
            return {(r["row"], r["col"]): r["value"] for r in self.dense().collect()}
        df = self.order if self.order is not None else self.df
        rows = df.orderBy(F.col("pos").asc_nulls_last(), "entry").collect()
        return [r["entry"] for r in rows] if self.kind == "axis" else {r["entry"]: r["value"] for r in rows}


@dataclass
class Scope:
    """An axis, as far as masks have left it."""

    axis: str | None
    frame: DataFrame
    masked: bool = False
    size: int | None = None

    def count(self, ds: Reader) -> int:
        if self.size is None:
            self.size = self.frame.select("entry").count() if self.masked or self.axis is None else ds.axis_length(self.axis)
        return self.size


@dataclass
class Vector:
    """Values in the column __v of a frame that still has the axis's other columns."""

    scope: Scope
    frame: DataFrame
    name: str | None = None
    as_axis: str | None = None

    @property
    def kind(self) -> T.DataType:
        return self.frame.schema["__v"].dataType


@dataclass
class Grid:
    """A matrix: stored cells (row, col, value) within the two scopes, and what the other cells hold."""

    rows: Scope
    cols: Scope
    cells: DataFrame
    background: object = None
    name: str | None = None

    @property
    def kind(self) -> T.DataType:
        return self.cells.schema["value"].dataType

    def transposed(self) -> Grid:
        return Grid(self.cols, self.rows, self.cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), self.background, self.name)

    def written_out(self) -> DataFrame:
        """dense() where a query cannot do without: its cells are as many as the axes say, however few are stored."""
        if self.background is not None:
            inefficient(f"the cells that are not stored of the matrix {self.name or ''} are written out")
        return self.dense()

    def dense(self) -> DataFrame:
        if self.background is None:
            return self.cells
        # every cell of a matrix, as its axes define it
        all_ = self.rows.frame.select(F.col("entry").alias("row")).crossJoin(self.cols.frame.select(F.col("entry").alias("col")))
        return all_.join(self.cells, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(self.background).cast(self.kind)).alias("value"))


def run_query(ds: Reader, query) -> Result:
    nodes = nodes_of(query)
    return Compiler(ds, nodes).result()


class Compiler:
    """Reads nodes from left to right; each method reads one phrase."""

    def __init__(self, ds: Reader, nodes: tuple[Node, ...]):
        self.ds, self.nodes, self.at = ds, nodes, 0
        self.picks: list[tuple[str, str]] = []  # entries that the query picks by name

    # reading
    def peek(self, *kinds: str) -> Node | None:
        if self.at < len(self.nodes) and self.nodes[self.at].kind in kinds:
            return self.nodes[self.at]
        return None

    def take(self, *kinds: str) -> Node | None:
        node = self.peek(*kinds)
        self.at += node is not None
        return node

    def need(self, *kinds: str) -> Node:
        return self.take(*kinds) or self.fail()

    def fail(self, why: str = "invalid query"):
        left = canonical_query(self.nodes[self.at :])
        raise QueryError(f"{why}: {canonical_query(self.nodes)!r}" + (f", at {left!r}" if left else ""))

    def value(self) -> Node | None:
        return self.take("IfMissing")

    def constant(self, node: Node, like: T.DataType | None = None) -> Column:
        """A default as a literal: of its own type, of the type of what it stands in for, or as its text reads."""
        kind = SPARK[node.param("type")] if node.param("type") else like.simpleString() if like else None
        text = node.name
        if kind is None:
            try:
                x = number(text)
                return F.lit(int(x)).cast("bigint") if x == x and abs(x) < 1e18 and text.lstrip("+-").isdigit() else F.lit(x)
            except QueryError:
                return F.lit(text)
        if kind == "string":
            return F.lit(text)
        if kind == "boolean":
            words = {"true": True, "1": True, "false": False, "0": False}
            if text.lower() not in words:
                self.fail(f"not a truth value: {text!r}")
            return F.lit(words[text.lower()])
        x = number(text)
        if kind not in ("float", "double") and not x.is_integer():
            if node.param("type"):
                self.fail(f"not a whole number: {text!r}")
            return F.lit(x)
        return F.lit(x if kind in ("float", "double") else int(x)).cast(kind)

    # results
    def result(self) -> Result:
        if not self.nodes:
            self.fail("empty query")
        got = self.phrase()
        if self.at < len(self.nodes):
            self.fail()
        return self.checked(self.finished(got))

    def checked(self, result: Result) -> Result:
        """The result, which fails when it is computed if an entry that is picked by name is not there."""
        for axis, entry in self.picks:
            every = result.every_cell
            result = replace(result, df=self.sure(result.df, axis, entry), order=None if result.order is None else self.sure(result.order, axis, entry), every_cell=None if every is None else lambda every=every, axis=axis, entry=entry: self.sure(every(), axis, entry))
        return result

    def finished(self, got) -> Result:
        if isinstance(got, Result):
            return got
        if isinstance(got, Scope):
            return Result("axis", got.frame.select("entry"), got.frame.select("entry", "pos"))
        if isinstance(got, Vector):
            order = got.frame.select("entry", "pos", F.col("__v").alias("value"))
            return Result("vector", order.select("entry", "value"), order)
        return Result("matrix", got.cells, every_cell=got.dense, background=got.background)

    def names(self, found) -> Result:
        spark = self.ds.spark
        return Result("names", spark.createDataFrame([(n,) for n in sorted(found)], "name string"))

    def scalar(self, df: DataFrame) -> Result:
        return Result("scalar", df)

    def phrase(self):
        ds = self.ds
        if node := self.take("Names"):
            return self.names(ds.axes_set())
        if node := self.take("LookupScalar"):
            if node.name is None:
                self.need("Names")
                return self.names(ds.scalars_set())
            default = self.value()
            if ds.has_scalar(node.name):
                got = F.lit(ds.get_scalar(node.name))
            elif default:
                got = self.constant(default)
            else:
                raise KeyError(f"missing scalar: {node.name} in the data set: {ds.name}")
            return self.after_scalar(ds.spark.range(1).select(got.alias("value")))
        if self.peek("LookupVector"):
            return self.after_scalar(self.picked_vector())
        if self.peek("LookupMatrix"):
            return self.after_scalar(self.picked_cell())
        rows = self.axis()
        if self.peek(*COMPARISONS):
            return self.after_vector(Vector(rows, rows.frame.withColumn("__v", F.col("entry")), "name"))
        if self.at == len(self.nodes):
            return rows
        if node := self.take("Names"):
            return self.names(ds.vectors_set(rows.axis))
        if self.peek("LookupVector"):
            node = self.nodes[self.at]
            if node.name is None:
                self.at += 1
                self.need("Names")
                return self.names(ds.vectors_set(rows.axis))
            return self.after_vector(self.vector(rows))
        if self.peek("LookupMatrix"):
            return self.after_vector(self.column_of(rows))
        if self.peek("Axis"):
            cols = self.axis()
            node = self.take("LookupMatrix")
            if node is None:
                self.fail()
            if node.name is None:
                self.need("Names")
                return self.names(ds.matrices_set(rows.axis, cols.axis))
            return self.after_matrix(self.grid(rows, cols, node))
        self.fail()

    # axes and masks
    def axis(self) -> Scope:
        node = self.need("Axis")
        scope = Scope(node.name, self.ds.axis_frame(node.name))
        while self.peek("BeginMask"):
            scope = self.mask(scope)
        return scope

    def mask(self, scope: Scope) -> Scope:
        frame, total, number_of = scope.frame, None, 0
        while not self.take("EndMask"):
            node = self.take("BeginMask") if total is None else self.take("AndMask", "OrMask", "XorMask")
            if node is None:
                self.fail()
            col = f"__m{number_of}"
            number_of += 1
            frame = self.operand(scope, frame, node, col)
            kind = frame.schema[col].dataType
            test = self.take(*COMPARISONS)
            c = compared(test.kind, F.col(col), kind, test.name) if test else truthy(F.col(col), kind)
            c = ~c if node.negated else c
            if total is None:
                total = c
            else:
                total = {"AndMask": lambda: total & c, "OrMask": lambda: total | c, "XorMask": lambda: total != c}[node.kind]()
        kept = frame.where(F.coalesce(total, F.lit(False)))
        return Scope(scope.axis, kept.drop(*(f"__m{i}" for i in range(number_of))), True)

    def operand(self, scope: Scope, frame: DataFrame, node: Node, col: str) -> DataFrame:
        """frame with a column of a mask's property: a vector, perhaps looked up further, or a slice of a matrix."""
        if self.peek("Axis", "SquareColumnIs", "SquareRowIs"):
            m, pick, other = self.sliced(scope.axis, node.name)
            return self.joined_slice(frame, m, pick, col, other)
        frame = self.property(frame, scope.axis, node.name, col)
        return self.chained(frame, col, node.name)[0]

    def property(self, frame: DataFrame, axis: str, name: str, col: str) -> DataFrame:
        """frame with a vector of its axis as a column, or its default if it is missing and a || follows."""
        default = self.value()
        if self.ds.has_vector(axis, name):
            return self.ds.with_vector(axis, name, frame).withColumn(col, self.ds.vector_column(axis, name))
        if default is None:
            raise KeyError(f"missing vector: {name} of the axis: {axis} in the data set: {self.ds.name}")
        return frame.withColumn(col, self.constant(default))

    # lookups by entry
    def target(self, axis: str | None, name: str) -> str:
        """The axis that a property's values name: as said, or the property's name, or that up to its last dot."""
        for guess in (axis, name, name.rpartition(".")[0]):
            if guess and (guess == axis or self.ds.has_axis(guess)):
                return guess
        raise QueryError(f"no axis for the values of {name!r}")

    def chained(self, frame: DataFrame, col: str, name: str) -> tuple[DataFrame, str | None, str]:
        """frame after all lookups that follow the column's values as entries; the axis named last, and the property.

        A row whose key is no entry is an error, unless ?? follows the key: then it goes, or takes the value given,
        which later lookups leave alone.
        """
        final = f"{col}__final"
        as_axis = None
        while self.peek("AsAxis", "IfNot", "LookupVector"):
            as_axis = None
            fallback = None
            said = False
            while node := self.take("AsAxis", "IfNot"):
                if node.kind == "AsAxis":
                    as_axis, said = self.target(node.name, name), True
                else:
                    fallback = node
            if not self.peek("LookupVector"):
                if fallback is not None:
                    frame = self.dropped(frame, col, fallback)
                break
            axis = as_axis if said else self.target(None, name)
            node = self.need("LookupVector")
            if node.name is None:
                self.fail()
            as_axis = None
            default = self.value()
            dim = self.ds.with_vector(axis, node.name)
            if self.ds.has_vector(axis, node.name):
                found = self.ds.vector_column(axis, node.name)
            elif default is not None:
                found = self.constant(default)
            else:
                raise KeyError(f"missing vector: {node.name} of the axis: {axis} in the data set: {self.ds.name}")
            dim = dim.select(F.col("entry").alias(f"{col}__k"), found.alias(f"{col}__w"))
            kind = dim.schema[f"{col}__w"].dataType
            frame = frame.join(dim, F.col(col) == F.col(f"{col}__k"), "left")
            done = F.coalesce(F.col(final), F.lit(False)) if final in frame.columns else F.lit(False)
            lost = F.col(f"{col}__k").isNull() & ~done
            value = F.col(f"{col}__w")
            if fallback is None:
                frame = guarded(frame, lost, f"values of {name} that are no entries of the axis {axis}")
                lost = F.lit(False)
            elif fallback.name is None:
                frame = frame.where(~lost)
                lost = F.lit(False)
            else:
                value = F.when(lost, self.constant(fallback, kind)).otherwise(value)
            if final in frame.columns:
                value = F.when(done, F.col(col).cast(kind)).otherwise(value)
            frame = frame.withColumns({col: value, final: done | lost}).drop(f"{col}__k", f"{col}__w")
            name = node.name
        return (frame.drop(final) if final in frame.columns else frame), as_axis, name

    def dropped(self, frame: DataFrame, col: str, fallback: Node) -> DataFrame:
        """Empty strings replaced by the value given, or their rows dropped."""
        if fallback.name is None:
            return frame.where(F.col(col) != "")
        return frame.withColumn(col, F.when(F.col(col) == "", self.constant(fallback, frame.schema[col].dataType)).otherwise(F.col(col)))

    # vectors
    def vector(self, scope: Scope) -> Vector:
        node = self.need("LookupVector")
        return Vector(scope, self.property(scope.frame, scope.axis, node.name, "__v"), node.name)

    def after_vector(self, v: Vector):
        """Everything that may follow a vector."""
        while self.at < len(self.nodes):
            if self.peek("AsAxis", "IfNot", "LookupVector"):
                frame, as_axis, name = self.chained(v.frame, "__v", v.name)
                v = replace(v, frame=frame, as_axis=as_axis, name=name)
            elif self.peek("LookupMatrix"):
                v = self.through_matrix(v)
            elif node := self.take(*COMPARISONS):
                v = replace(v, frame=v.frame.withColumn("__v", compared(node.kind, F.col("__v"), v.kind, node.name)))
            elif node := self.take("Eltwise"):
                v = self.eltwise_vector(v, node)
            elif node := self.take("GroupBy"):
                v = self.grouped(v, node)
            elif node := self.take("CountBy"):
                return self.after_matrix(self.counted(v, node))
            elif node := self.take(*REDUCES):
                return self.after_scalar(self.reduced(v, node))
            elif self.peek("Axis") and not v.scope.masked and self.nodes[self.at].name == v.scope.axis:
                self.at += 1
                entry = self.need("IsEqual").name
                return self.after_scalar(self.entry_of(v.frame, v.scope.axis, entry))
            else:
                self.fail()
        return v

    def sure(self, df: DataFrame, axis: str, entry: str) -> DataFrame:
        """df, which fails when it is computed if the axis has no such entry."""
        there = self.ds.axis_frame(axis).where(F.col("entry") == entry).agg(F.count(F.lit(1)).alias("__there"))
        there = guarded(there, F.col("__there") == 0, f"missing entry: {entry} of the axis: {axis}")
        return df.crossJoin(F.broadcast(there)).drop("__there")  # one row

    def entry_of(self, frame: DataFrame, axis: str, entry: str) -> DataFrame:
        """The value __v of one entry of an axis's frame."""
        got = frame.where(F.col("entry") == entry).agg(F.first("__v").alias("value"), F.count(F.lit(1)).alias("__n"))
        return guarded(got, F.col("__n") == 0, f"missing entry: {entry} of the axis: {axis}").select("value")

    def picked_vector(self) -> DataFrame:
        node = self.need("LookupVector")
        default = self.value()
        axis = self.need("Axis").name
        entry = self.need("IsEqual").name
        frame = self.ds.axis_frame(axis)
        if not self.ds.has_vector(axis, node.name) and default is not None:
            return self.sure(self.ds.spark.range(1).select(self.constant(default).alias("value")), axis, entry)
        return self.entry_of(self.property(frame, axis, node.name, "__v"), axis, entry)

    def eltwise_vector(self, v: Vector, node: Node) -> Vector:
        params, frame, over = dict(node.params), v.frame, None
        if node.name in eltwise.WHOLE:
            x = F.col("__v").cast("double")
            one = frame.agg((F.coalesce(F.sum(x), F.lit(0.0)) if node.name == "Fraction" else F.coalesce(F.max(F.abs(F.nanvl(x, F.lit(0.0)))), F.lit(0.0))).alias("__over"))
            frame, over = frame.crossJoin(F.broadcast(one)), F.col("__over")  # one row
        out = frame.withColumn("__v", eltwise.applied(node.name, params, F.col("__v"), v.kind, over))
        return replace(v, frame=out.drop("__over") if over is not None else out, name=None)

    def reduced(self, v: Vector, node: Node) -> DataFrame:
        default = self.value()
        op = Reduction.of(node.name, dict(node.params))
        got = op.reduced(v.frame, [], "__v", "pos")
        empty = F.coalesce(F.col("__n"), F.lit(0)) == 0
        value = F.col("reduced")
        if default is not None:
            return got.select(F.when(empty, self.constant(default, got.schema["reduced"].dataType)).otherwise(value).alias("value"))
        return guarded(got, empty, f"{node.name} of an empty vector").select(value.alias("value"))

    def grouped(self, v: Vector, node: Node) -> Vector:
        frame = self.property(v.frame, v.scope.axis, node.name, "__g")
        frame, as_axis, _ = self.chained(frame, "__g", node.name)
        reduce = self.need(*REDUCES)
        default = self.value()
        if as_axis is None and (late := self.take("AsAxis")):
            as_axis = self.target(late.name, node.name)
        op = Reduction.of(reduce.name, dict(reduce.params))
        nan = F.isnan("__g") if is_real(frame.schema["__g"].dataType) else None
        if nan is not None and default is None:
            frame = guarded(frame, nan, f"NaN among the groups of {node.name}")
        got = op.reduced(frame.withColumn("entry", label("__g", frame.schema["__g"].dataType)), ["entry"], "__v", "pos")
        kind = got.schema["reduced"].dataType
        if nan is not None and default is not None:
            got = got.withColumn("reduced", F.when(F.col("entry") == "NaN", self.constant(default, kind)).otherwise(F.col("reduced")))
        got = got.select("entry", F.col("reduced").alias("__v"))
        if as_axis is None:
            out = got.withColumn("pos", F.lit(None).cast("bigint"))
            return Vector(Scope(None, out, True), out)
        full = self.ds.axis_frame(as_axis).join(got, "entry", "left")
        if default is None:
            full = guarded(full, F.col("__v").isNull(), f"entries of the axis {as_axis} without any value")
        else:
            full = full.withColumn("__v", F.coalesce("__v", self.constant(default, kind)))
        return Vector(Scope(as_axis, self.ds.axis_frame(as_axis)), full)

    def counted(self, v: Vector, node: Node) -> Grid:
        frame = self.property(v.frame, v.scope.axis, node.name, "__c")
        frame, as_axis, _ = self.chained(frame, "__c", node.name)
        cells = frame.where(F.col("__v").isNotNull() & F.col("__c").isNotNull()).groupBy(label("__v", v.kind).alias("row"), label("__c", frame.schema["__c"].dataType).alias("col")).agg(F.count(F.lit(1)).alias("value"))
        default = self.value()
        sides = [self.labels(cells, side, axis) for side, axis in (("row", v.as_axis), ("col", as_axis))]
        return Grid(*sides, cells, 0 if default is None else number(default.name))

    def labels(self, cells: DataFrame, side: str, axis: str | None) -> Scope:
        if axis is not None:
            return Scope(axis, self.ds.axis_frame(axis))
        return Scope(None, cells.select(F.col(side).alias("entry")).distinct().withColumn("pos", F.lit(None).cast("bigint")))

    # matrices
    def grid(self, rows: Scope, cols: Scope, node: Node) -> Grid:
        default = self.value()
        if self.ds.has_matrix(rows.axis, cols.axis, node.name) or default is None:
            m = self.ds.matrix(rows.axis, cols.axis, node.name)
        else:
            m = self.constant_matrix(default)
        cells = m.df
        for side, scope in (("row", rows), ("col", cols)):
            if scope.masked:
                cells = cells.join(scope.frame.select(F.col("entry").alias(side)), side, "left_semi").select("row", "col", "value")
        return Grid(rows, cols, cells, m.background, node.name)

    def constant_matrix(self, default: Node) -> Matrix:
        one = self.ds.spark.range(1).select(self.constant(default).alias("value"))
        kind = one.schema["value"].dataType
        value = default.name if isinstance(kind, T.StringType) else number(default.name) if default.name.lower() not in ("true", "false") else default.name.lower() == "true"
        return Matrix(one.limit(0).select(F.lit("").alias("row"), F.lit("").alias("col"), "value"), value)

    def after_matrix(self, g: Grid):
        while self.at < len(self.nodes):
            if self.peek("AsAxis", "IfNot", "LookupVector"):
                g = self.through_axis(g)
            elif self.peek("LookupMatrix"):
                m, pick, _ = self.second_matrix(g.name)
                joined = g.written_out().join(m.df.where(pick).select(F.col("row").alias("__k"), F.col("value").alias("__w")), F.col("value") == F.col("__k"), "left")
                value = F.col("__w") if m.background is None else F.coalesce("__w", F.lit(m.background).cast(m.df.schema["value"].dataType))
                g = replace(g, cells=joined.select("row", "col", value.alias("value")), background=None)
            elif node := self.take(*COMPARISONS):
                background = None
                if g.background is not None:
                    one = self.ds.spark.range(1).select(F.lit(g.background).cast(g.kind).alias("v")).select(compared(node.kind, F.col("v"), g.kind, node.name).alias("v"))
                    background = one.first()[0]
                g = replace(g, cells=g.cells.withColumn("value", compared(node.kind, F.col("value"), g.kind, node.name)), background=background)
            elif node := self.take("Eltwise"):
                g = self.eltwise_grid(g, node)
            elif self.peek("GroupRowsBy", "GroupColumnsBy"):
                got = self.grouped_grid(g)
                if isinstance(got, Vector):
                    return self.after_vector(got)
                g = got
            elif node := self.take(*REDUCES):
                op, default = Reduction.of(node.name, dict(node.params)), self.value()
                if node.kind == "ReduceToScalar":
                    return self.after_scalar(self.reduced_all(g, op, node, default))
                return self.after_vector(self.reduced_rows(g if node.kind == "ReduceToColumn" else g.transposed(), op, default))
            elif self.peek("Axis", "SquareColumnIs", "SquareRowIs"):
                return self.after_vector(self.picked(g))
            else:
                self.fail()
        return g

    def through_axis(self, g: Grid) -> Grid:
        """Each cell's value as an entry of an axis; cells whose value is none stay without a value, or take that of ??."""
        axis, fallback, name = None, None, g.name or ""
        while node := self.take("AsAxis", "IfNot"):
            if node.kind == "AsAxis":
                axis = self.target(node.name, name)
            else:
                fallback = node
        node = self.need("LookupVector")
        axis = axis or self.target(None, name)
        dim = self.ds.with_vector(axis, node.name).select(F.col("entry").alias("__k"), self.ds.vector_column(axis, node.name).alias("__w"))
        cells = g.written_out()
        value = F.col("__w")
        if fallback is not None and fallback.name is not None:
            value = F.coalesce(value, self.constant(fallback, dim.schema["__w"].dataType))
        return replace(g, cells=cells.join(dim, F.col("value") == F.col("__k"), "left").select("row", "col", value.alias("value")), background=None, name=node.name)

    def second_matrix(self, name: str | None) -> tuple[Matrix, Column, str]:
        """:: m2 @ axis = C, or @| or @-: values are rows of m2; its column C (of a square matrix, column or row)."""
        node = self.need("LookupMatrix")
        rows = self.target(None, name or "")
        return self.sliced(rows, node.name)

    def through_matrix(self, v: Vector) -> Vector:
        m, pick, _ = self.second_matrix(v.name)
        right = m.df.where(pick).select(F.col("row").alias("__k"), F.col("value").alias("__w"))
        value = F.col("__w") if m.background is None else F.coalesce("__w", F.lit(m.background).cast(m.df.schema["value"].dataType))
        return replace(v, frame=v.frame.join(right, F.col("__v") == F.col("__k"), "left").withColumn("__v", value).drop("__k", "__w"))

    def sliced(self, axis: str, name: str) -> tuple[Matrix, Column, str]:
        """A matrix with the axis as rows, the condition for one column of it, and its columns axis."""
        default = self.value()
        if node := self.take("SquareColumnIs", "SquareRowIs"):
            m = self.ds.matrix(axis, axis, name) if default is None or self.ds.has_matrix(axis, axis, name) else self.constant_matrix(default)
            self.picks.append((axis, node.name))
            if node.kind == "SquareRowIs":
                m = Matrix(m.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), m.background)
            return m, F.col("col") == node.name, axis
        other = self.need("Axis").name
        entry = self.need("IsEqual").name
        m = self.ds.matrix(axis, other, name) if default is None or self.ds.has_matrix(axis, other, name) else self.constant_matrix(default)
        self.picks.append((other, entry))
        return m, F.col("col") == entry, other

    def joined_slice(self, frame: DataFrame, m: Matrix, pick: Column, col: str, other: str) -> DataFrame:
        kind = m.df.schema["value"].dataType
        right = m.df.where(pick).select(F.col("row").alias("__row"), F.col("value").alias(col))
        out = frame.join(right, F.col("entry") == F.col("__row"), "left").drop("__row")
        return out if m.background is None else out.withColumn(col, F.coalesce(col, F.lit(m.background).cast(kind)))

    def column_of(self, rows: Scope) -> Vector:
        node = self.need("LookupMatrix")
        m, pick, other = self.sliced(rows.axis, node.name)
        return Vector(rows, self.joined_slice(rows.frame, m, pick, "__v", other), node.name)

    def picked(self, g: Grid) -> Vector:
        """One column or row of a matrix as a vector of the other axis."""
        if node := self.take("SquareColumnIs", "SquareRowIs"):
            if node.kind == "SquareRowIs":
                g = g.transposed()
            axis, entry = g.cols.axis, node.name
        else:
            axis = self.need("Axis").name
            entry = self.need("IsEqual").name
            if axis == g.rows.axis and axis != g.cols.axis:
                g = g.transposed()
            elif axis != g.cols.axis:
                self.fail()
        self.picks.append((axis, entry))
        m = Matrix(g.cells, g.background)
        return Vector(g.rows, self.joined_slice(g.rows.frame, m, F.col("col") == entry, "__v", axis), g.name)

    def picked_cell(self) -> DataFrame:
        node = self.need("LookupMatrix")
        default = self.value()
        first = self.need("Axis").name
        row = self.need("IsEqual").name
        if square := self.take("SquareColumnIs", "SquareRowIs"):
            second, col = first, square.name
        else:
            second = self.need("Axis").name
            col = self.need("IsEqual").name
        if default is not None and not self.ds.has_matrix(first, second, node.name):
            return self.ds.spark.range(1).select(self.constant(default).alias("value"))
        m = self.ds.matrix(first, second, node.name)
        self.picks += [(first, row), (second, col)]
        found = m.df.where((F.col("row") == row) & (F.col("col") == col)).agg(F.max("value").alias("value"))
        return found if m.background is None else found.select(F.coalesce("value", F.lit(m.background).cast(m.df.schema["value"].dataType)).alias("value"))

    def eltwise_grid(self, g: Grid, node: Node) -> Grid:
        params, background = dict(node.params), None
        if g.background is not None:
            background = eltwise.of_background(node.name, params, g.background)
            if background is None:
                g = replace(g, cells=g.written_out(), background=None)
        cells, over = g.cells, None
        if node.name in eltwise.WHOLE:
            x = F.col("value").cast("double")
            by = cells.groupBy("col").agg((F.sum(x) if node.name == "Fraction" else F.max(F.abs(F.nanvl(x, F.lit(0.0))))).alias("__over"))
            cells, over = cells.join(by, "col"), F.col("__over")
        return replace(g, cells=cells.select("row", "col", eltwise.applied(node.name, params, F.col("value"), g.kind, over).alias("value")), background=background)

    def ordered(self, cells: DataFrame, side: str, scope: Scope, op: Reduction) -> DataFrame:
        """cells with pos, the place from 0 among the entries of a scope, where the operation needs it."""
        if not op.in_order:
            return cells
        return cells.join(self.places(scope).select(F.col("entry").alias(side), F.col("__place").alias("pos")), side)

    def places(self, scope: Scope) -> DataFrame:
        """entry and __place of what masks have left; labels of groups are in bytewise order."""
        if scope.axis is None:
            return placed(scope.frame, "entry")
        return placed(scope.frame) if scope.masked else self.ds.places(scope.axis)

    def reduced_rows(self, g: Grid, op: Reduction, default: Node | None) -> Vector:
        """One value per row: stored cells are aggregated, the others counted in."""
        n = g.cols.count(self.ds) if g.background is not None or default is not None else None
        cells = self.ordered(g.cells, "col", g.cols, op)
        got = op.reduced(cells, ["row"], "value", "pos", None if g.background is None else F.lit(n), g.background)
        kind = got.schema["reduced"].dataType
        out = g.rows.frame.join(got.select(F.col("row").alias("entry"), F.col("reduced").alias("__v")), "entry", "left")
        if n == 0:
            fill = self.constant(default, kind) if default is not None else None
        else:
            fill = None if g.background is None else self.filled(op, g.background, n, kind)
        if fill is not None:
            out = out.withColumn("__v", F.coalesce("__v", fill))
        elif g.background is not None or default is None:
            out = guarded(out, F.col("__v").isNull() & F.lit(n == 0), f"{op.name} over an empty axis")
        return Vector(g.rows, out)

    def filled(self, op: Reduction, background, n: int, kind: T.DataType) -> Column:
        return F.lit(op.of_constant(background, n)).cast(kind)

    def reduced_all(self, g: Grid, op: Reduction, node: Node, default: Node | None) -> DataFrame:
        total = g.rows.count(self.ds) * g.cols.count(self.ds) if g.background is not None else None
        cells, gap = g.cells, None
        if op.in_order:  # column by column
            rows = g.rows.count(self.ds)
            cells = self.ordered(cells, "col", g.cols, op).withColumnRenamed("pos", "__c")
            cells = self.ordered(cells, "row", g.rows, op)
            if g.background is not None:  # a column's first place that is not stored follows the stored ones without a gap
                before = F.row_number().over(Window.partitionBy("col").orderBy("pos")) - 1
                full = cells.withColumn("__b", before).groupBy("col").agg(F.sum((F.col("pos") == F.col("__b")).cast("bigint")).alias("__f"))
                columns = self.places(g.cols).join(full, F.col("entry") == F.col("col"), "left").select("__place", F.coalesce("__f", F.lit(0)).alias("__f"))
                gap = columns.where(F.col("__f") < rows).agg(F.min(F.col("__place") * rows + F.col("__f")).alias("__gap"))
            cells = cells.withColumn("pos", F.col("__c") * F.lit(rows) + F.col("pos"))
        got = op.reduced(cells, [], "value", "pos", None if total is None else F.lit(total), g.background, gap)
        kind = got.schema["reduced"].dataType
        value, empty = F.col("reduced"), F.coalesce(F.col("__n"), F.lit(0)) == 0
        if total:  # without a stored cell there still are cells
            return got.select(F.when(empty, self.filled(op, g.background, total, kind)).otherwise(value).alias("value"))
        if default is not None:
            return got.select(F.when(empty, self.constant(default, kind)).otherwise(value).alias("value"))
        return guarded(got, empty, f"{node.name} of an empty matrix").select(value.alias("value"))

    def grouped_grid(self, g: Grid) -> Grid | Vector:
        """Rows or columns of a matrix in groups: a group's cells of each column, or of each row, become one; reduced the
        other way, the operation runs again over the results."""
        node = self.need("GroupRowsBy", "GroupColumnsBy")
        by_rows = node.kind == "GroupRowsBy"
        if not by_rows:
            g = g.transposed()
        frame = self.property(g.rows.frame, g.rows.axis, node.name, "__g")
        frame, as_axis, _ = self.chained(frame, "__g", node.name)
        reduce = self.need("ReduceToColumn", "ReduceToRow")
        default = self.value()
        if as_axis is None and (late := self.take("AsAxis")):
            as_axis = self.target(late.name, node.name)
        op = Reduction.of(reduce.name, dict(reduce.params))
        nan = F.isnan("__g") if is_real(frame.schema["__g"].dataType) else None
        if nan is not None and default is None:
            frame = guarded(frame, nan, f"NaN among the groups of {node.name}")
        members = frame.select(F.col("entry").alias("row"), label("__g", frame.schema["__g"].dataType).alias("__label"), "pos")
        if op.in_order:  # places within the group
            members = members.withColumn("pos", (F.row_number().over(Window.partitionBy("__label").orderBy("pos")) - 1).cast("bigint"))
        sizes = members.groupBy("__label").agg(F.count(F.lit(1)).alias("__size"))
        total = None
        if g.background is not None:  # groups' sizes go along with their members, not with the cells
            members, total = members.join(sizes, "__label"), F.col("__size")
        joined = g.cells.join(members, "row")
        got = op.reduced(joined, ["__label", "col"], "value", "pos", total, g.background)
        kind = got.schema["reduced"].dataType
        cells = got.select(F.col("__label").alias("row"), "col", F.col("reduced").alias("value"))
        labels = Scope(None, sizes.select(F.col("__label").alias("entry"), F.lit(None).cast("bigint").alias("pos")))
        background = None
        if g.background is not None:
            background = op.of_constant(g.background, 1)
            if op.of_constant(g.background, 2) != background:  # depends on the size of the group
                grid = sizes.crossJoin(g.cols.frame.select(F.col("entry").alias("col")))
                fill = F.col("__size") * F.lit(float(op.of_constant(g.background, 1)))
                cells = grid.withColumnRenamed("__label", "row").join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("value", fill.cast(kind)).alias("value"))
                background = None
        if nan is not None and default is not None:  # the group of NaN has the default
            value = F.when(F.col("row") == "NaN", self.constant(default, kind)).otherwise(F.col("value"))
            if background is not None:
                bare = labels.frame.where(F.col("entry") == "NaN").select(F.col("entry").alias("row")).crossJoin(g.cols.frame.select(F.col("entry").alias("col")))  # one row of the matrix
                cells = cells.unionByName(bare.join(cells.select("row", "col"), ["row", "col"], "left_anti").withColumn("value", F.lit(None).cast(kind)))
            cells = cells.withColumn("value", value)
        if as_axis is not None:
            scope = Scope(as_axis, self.ds.axis_frame(as_axis))
            unused = scope.frame.join(labels.frame.select("entry"), "entry", "left_anti")
            cells = cells.join(scope.frame.select(F.col("entry").alias("row")), "row", "left_semi").select("row", "col", "value")
            if default is None:
                guard = guarded(unused, F.lit(True), f"entries of the axis {as_axis} without any value")
                more = guard.select(F.col("entry").alias("row"), F.lit("").alias("col"), F.lit(None).cast(kind).alias("value"))
            else:
                more = unused.select(F.col("entry").alias("row")).crossJoin(g.cols.frame.select(F.col("entry").alias("col"))).select("row", "col", self.constant(default, kind).alias("value"))
            cells, labels = cells.unionByName(more), scope
        out = Grid(labels, g.cols, cells, background)
        nested = (reduce.kind == "ReduceToColumn") == by_rows
        if nested:
            return self.reduced_rows(out, op, None)
        return out if by_rows else out.transposed()

    # scalars
    def after_scalar(self, df):
        if isinstance(df, Vector):
            return self.after_vector(df)
        while self.at < len(self.nodes):
            kind = df.schema["value"].dataType
            if node := self.take(*COMPARISONS):
                df = df.select(compared(node.kind, F.col("value"), kind, node.name).alias("value"))
            elif node := self.take("Eltwise"):
                if node.name in eltwise.WHOLE:
                    raise TypeError(f"{node.name} of a scalar")
                df = df.select(eltwise.applied(node.name, dict(node.params), F.col("value"), kind).alias("value"))
            else:
                self.fail()
        return self.scalar(df)


def label(col: str, kind: T.DataType) -> Column:
    """Group labels as text. Whole real numbers have all their digits and .0; others 15 digits at most, as a decimal or with
    an exponent, whichever is shorter."""
    if not is_real(kind):
        return F.col(col).cast("string")
    x = F.col(col).cast("double") + F.lit(0.0)  # no negative zero
    parts = F.split(F.format_string("%.14e", F.abs(x)), "e")
    digits, e = F.rtrim(F.regexp_replace(parts[0], r"\.", ""), F.lit("0")), F.coalesce(F.try_to_number(parts[1], F.lit("S999")).cast("int"), F.lit(0))
    n, sign = F.length(digits), F.when(x < 0, "-").otherwise("")
    power = F.concat(F.when(-e < 10, F.lit("e-0")).otherwise(F.lit("e-")), (-e).cast("string"))
    whole = F.concat(F.format_string("%.0f", F.abs(x)), F.lit(".0"))
    small = F.when(-e + 1 + n <= F.when(n == 1, 5).otherwise(n + 5), F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).when(n == 1, F.concat(digits, power)).otherwise(F.concat(digits.substr(F.lit(1), F.lit(1)), F.lit("."), digits.substr(F.lit(2), n), power))
    large = F.when(n > e + 1, F.concat(digits.substr(F.lit(1), e + 1), F.lit("."), digits.substr(e + 2, n))).otherwise(F.rpad(digits, e + 1, "0"))
    text = F.when(F.abs(x) == math.inf, F.lit("Inf")).when(x == F.rint(x), whole).when(e < 0, small).otherwise(large)
    return F.when(F.isnan(x), F.lit("NaN")).otherwise(F.concat(sign, text))


__all__ = ["Compiler", "Result", "run_query"]
