"""Copies of properties between data sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from ..dataset import Dataset, Reader, q, vc
from ..functions.columns import strict_cast

UNSET = object()


def _skip(exists: bool, overwrite: bool, insist: bool, what: str) -> bool:
    """Whether to leave what is there; an error if it may be neither kept nor replaced."""
    if exists and not overwrite:
        if insist:
            raise KeyError(f"existing {what}")
        return True
    return False


def relation(to: Reader, axis: str, source: Reader, source_axis: str) -> str:
    """same, subset (the destination has only some of the source's entries) or superset; anything else is an error."""
    a, b = to.axis_frame(axis).select("entry"), source.axis_frame(source_axis).select("entry")
    only_to = a.join(b, "entry", "left_anti").limit(1).count()
    only_source = b.join(a, "entry", "left_anti").limit(1).count()
    if only_to and only_source:
        raise ValueError(f"disjoint entries of the axis: {axis} and the source's: {source_axis}")
    return "superset" if only_to else "subset" if only_source else "same"


def copy_scalar(to: Dataset, source: Reader, name: str, rename: str | None = None, type: str | None = None, default=UNSET, overwrite: bool = False, insist: bool = True) -> None:
    name_to = rename or name
    if _skip(to.has_scalar(name_to), overwrite, insist, f"scalar: {name_to}"):
        return
    if source.has_scalar(name):
        value = source.get_scalar(name)
    elif default is UNSET:
        raise KeyError(f"missing scalar: {name} in the data set: {source.name}")
    elif default is None:
        return
    else:
        value = default
    kinds = {"Bool": bool, "String": str, "Float32": float, "Float64": float}
    to.set_scalar(name_to, kinds.get(type, int)(value) if type else value, True)


def copy_axis(to: Dataset, source: Reader, axis: str, rename: str | None = None, overwrite: bool = False, insist: bool = True) -> None:
    name = rename or axis
    if _skip(to.has_axis(name), overwrite, insist, f"axis: {name}"):
        return
    frame = source.axis_frame(axis).select("entry", "pos")
    if to.has_axis(name):
        to.delete_axis(name)
    to.add_axis(name, frame, check=False)


def copy_vector(to: Dataset, source: Reader, axis: str, name: str, reaxis: str | None = None, rename: str | None = None, type: str | None = None, default=UNSET, empty=None, overwrite: bool = False, insist: bool = True) -> None:
    """Values go by entry. Entries that the source lacks take empty, which then must be given; a vector that the source
    lacks takes default, None for not copying it."""
    axis_to, name_to = reaxis or axis, rename or name
    if _skip(to.has_vector(axis_to, name_to), overwrite, insist, f"vector: {name_to} of the axis: {axis_to}"):
        return
    if not source.has_vector(axis, name):
        if default is UNSET:
            raise KeyError(f"missing vector: {name} of the axis: {axis} in the data set: {source.name}")
        if default is not None:
            to.set_vector(axis_to, name_to, default, True)
        return
    how = relation(to, axis_to, source, axis)
    if how == "superset" and empty is None:
        raise ValueError(f"no empty value for the vector: {name} of entries that the source lacks")
    value = q(vc(name)) if name not in ("name", "index") else source.vector_column(axis, name)
    frame = source.axis_frame(axis)
    kind = frame.select(value.alias("v")).schema["v"].dataType
    value = strict_cast(value, kind, type) if type else value
    values = frame.select("entry", value.alias("value"))
    if how == "superset":
        values = to.axis_frame(axis_to).select("entry").join(values, "entry", "left").withColumn("value", F.coalesce("value", F.lit(empty)))
    to.set_vector(axis_to, name_to, values, True)


def copy_matrix(to: Dataset, source: Reader, rows: str, cols: str, name: str, rows_reaxis: str | None = None, cols_reaxis: str | None = None, rename: str | None = None, type: str | None = None, default=UNSET, empty=None, overwrite: bool = False, insist: bool = True) -> None:
    """Cells go by entries. Rows or columns that the source lacks hold empty: the background of a sparse matrix, if it is
    the same, else cells of their own."""
    rows_to, cols_to, name_to = rows_reaxis or rows, cols_reaxis or cols, rename or name
    if _skip(to.has_matrix(rows_to, cols_to, name_to), overwrite, insist, f"matrix: {name_to}"):
        return
    if not source.has_matrix(rows, cols, name):
        if default is UNSET:
            raise KeyError(f"missing matrix: {name} in the data set: {source.name}")
        if default is not None:
            m = source.matrix(rows, cols, name, default)
            to.set_matrix(rows_to, cols_to, name_to, m.df, m.background, True)
        return
    m = source.matrix(rows, cols, name)
    cells, background = m.df, m.background
    hows = [relation(to, a, source, b) for a, b in ((rows_to, rows), (cols_to, cols))]
    for side, axis, how in (("row", rows_to, hows[0]), ("col", cols_to, hows[1])):
        if how == "subset":
            cells = cells.join(to.axis_frame(axis).select(F.col("entry").alias(side)), side, "left_semi").select("row", "col", "value")
    if "superset" in hows:
        if empty is None:
            raise ValueError(f"no empty value for the matrix: {name} of entries that the source lacks")
        if background is None or background != empty:
            new_rows = to.axis_frame(rows_to).select(F.col("entry").alias("row")).join(source.axis_frame(rows).select(F.col("entry").alias("row"), F.lit(True).alias("old_row")), "row", "left")
            new_cols = to.axis_frame(cols_to).select(F.col("entry").alias("col")).join(source.axis_frame(cols).select(F.col("entry").alias("col"), F.lit(True).alias("old_col")), "col", "left")
            kind = cells.schema["value"].dataType
            more = new_rows.crossJoin(new_cols).where("old_row is null or old_col is null")  # the cells that must be said
            cells = cells.unionByName(more.select("row", "col", F.lit(empty).cast(kind).alias("value")))
    if type:
        cells = cells.withColumn("value", strict_cast(F.col("value"), cells.schema["value"].dataType, type))
    to.set_matrix(rows_to, cols_to, name_to, cells, background, True)


def copy_tensor(to: Dataset, source: Reader, main: str, rows: str, cols: str, name: str, rows_reaxis: str | None = None, cols_reaxis: str | None = None, rename: str | None = None, type: str | None = None, empty=None, overwrite: bool = False, insist: bool = True) -> None:
    """The matrices <entry>_<name> of all entries of the main axis; those that the source lacks are of empty, or left out."""
    for entry in to.axis_entries(main):
        copy_matrix(to, source, rows, cols, f"{entry}_{name}", rows_reaxis, cols_reaxis, f"{entry}_{rename or name}", type, None if empty is None else empty, empty, overwrite, insist)


def empty_data(vectors: Mapping[tuple[str, str], object] | None = None, matrices: Mapping[tuple[str, str, str], object] | None = None) -> dict[str, object]:
    """Empty values by axis|name and rows|cols|name."""
    return {"|".join(k): v for k, v in {**(vectors or {}), **(matrices or {})}.items()}


def copy_all(to: Dataset, source: Reader, empty: Mapping[str, object] | None = None, types: Mapping[str, str] | None = None, overwrite: bool = False, insist: bool = True) -> None:
    """All scalars, axes that are absent, vectors and matrices."""
    empty, types = dict(empty or {}), dict(types or {})
    for name in source.scalars_set():
        copy_scalar(to, source, name, type=types.get(name), overwrite=overwrite, insist=insist)
    for axis in source.axes_set():
        if not to.has_axis(axis):
            copy_axis(to, source, axis)
    for axis in source.axes_set():
        for name in source.vectors_set(axis):
            copy_vector(to, source, axis, name, type=types.get(f"{axis}|{name}"), empty=empty.get(f"{axis}|{name}"), overwrite=overwrite, insist=insist)
    for (rows, cols), named in source._matrices().items():
        for name in named:
            key = f"{rows}|{cols}|{name}"
            blank = empty.get(key, empty.get(f"{cols}|{rows}|{name}"))
            copy_matrix(to, source, rows, cols, name, type=types.get(key), empty=blank, overwrite=overwrite, insist=insist)
