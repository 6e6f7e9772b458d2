"""Views: axes and properties of a data set under other names, as queries that are only planned when read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from ..dataset import Matrix, Reader, q, vc
from ..plans.nodes import is_axis_query, query_axis_name

ALL = "*"
ALL_AXES = ALL_SCALARS = ALL
ALL_VECTORS = (ALL, ALL)
ALL_MATRICES = (ALL, ALL, ALL)
VIEW_ALL_AXES = {ALL_AXES: "="}
VIEW_ALL_SCALARS = {ALL_SCALARS: "="}
VIEW_ALL_VECTORS = {ALL_VECTORS: "="}
VIEW_ALL_MATRICES = {ALL_MATRICES: "="}
VIEW_ALL_DATA = {**VIEW_ALL_SCALARS, **VIEW_ALL_VECTORS, **VIEW_ALL_MATRICES}


class View(Reader):
    """axes: name -> "=" (as it is), None (hidden), an axis's name or an axis query; "*" stands for all others. data:
    scalar name, (axis, vector) or (rows, cols, matrix) -> "=", None or a query. Without axes, or data, all are as they are.
    Later keys win over earlier ones."""

    def __init__(self, base: Reader, axes: Mapping | None = None, data: Mapping | None = None, name: str | None = None):
        self.base, self.spark, self.name = base, base.spark, name or f"{base.name}.view"
        self._spec_axes, self._spec_data = dict(axes if axes is not None else VIEW_ALL_AXES), dict(data if data is not None else VIEW_ALL_DATA)
        self.source: dict[str, tuple[str, object]] = {}  # axis of the view -> axis of the base, frame of what is left of it
        for key, value in self._spec_axes.items():
            for axis in base.axes_set() if key == ALL else [key]:
                self._show(axis, axis if value == "=" else value)
        self._frames: dict[str, object] = {}
        self._values: dict[str, object] | None = None
        self._cells: dict | None = None

    def _show(self, axis: str, value: str | None) -> None:
        if value is None:
            self.source.pop(axis, None)
            return
        if self.base.has_axis(value):
            self.source[axis] = (value, None)
            return
        if not is_axis_query(value):
            raise ValueError(f"not an axis query: {value} for the axis: {axis} of the view: {self.name}")
        self.source[axis] = (query_axis_name(value), self.base.query(value).df)

    def _text(self, query: str, axes: tuple[str, ...], mark: str) -> str:
        """A query over the base: __axis__ stands for the axis, and one that begins with : or :: is about the axes."""
        text = query.strip()
        for k, axis in enumerate(axes):
            text = text.replace("__axis__" if k == 0 and len(axes) == 1 else f"__axis{k + 1}__", axis)
        if text.startswith("@") or (mark == "." and text.startswith(".")):
            return text
        return " ".join(f"@ {a}" for a in axes) + " " + (text if text.startswith(":") else f"{mark} {text}")

    def _scalars(self):
        if self._values is None:
            out = {}
            for key, value in self._spec_data.items():
                if isinstance(key, tuple):
                    continue
                for name in self.base.scalars_set() if key == ALL else [key]:
                    if value is None:
                        out.pop(name, None)
                    elif value == "=":
                        out[name] = self.base.get_scalar(name)
                    else:
                        got = self.base.query(value if value.lstrip()[:1] in "@.:" else f". {value}")
                        if got.kind != "scalar":
                            raise ValueError(f"not a scalar query: {value}")
                        out[name] = got.collect()
            self._values = out
        return self._values

    def _axes(self):
        return {a: self._frame(a) for a in self.source}

    def _frame(self, axis: str):
        if axis not in self._frames:
            source, left = self.source[axis]
            frame = self.base.axis_frame(source)
            out = frame.select("entry", "pos", *(q(c).alias(f"__{c}") for c in frame.columns if c.startswith("v_")))
            shown: dict[str, object] = {}
            for key, value in self._spec_data.items():
                if not isinstance(key, tuple) or len(key) != 2 or key[0] not in (ALL, axis):
                    continue
                names = self.base.vectors_set(source) if key[1] == ALL else [key[1]]
                for name in names:
                    if value is None:
                        shown.pop(name, None)
                    elif value == "=":
                        if not self.base.has_vector(source, name):
                            raise KeyError(f"missing vector: {name} of the axis: {source}")
                        shown[name] = q(f"__{vc(name)}")
                    else:
                        shown[name] = value
            for name, value in list(shown.items()):
                if isinstance(value, str):
                    got = self.base.query(self._text(value, (source,), ":"))
                    if got.kind != "vector":
                        raise ValueError(f"not a vector query: {value}")
                    col = f"__q{len(out.columns)}"
                    out = out.join(got.df.select("entry", F.col("value").alias(col)), "entry", "left")
                    shown[name] = F.col(col)
            if left is not None:
                out = out.join(left.select("entry"), "entry", "left_semi")
            out = out.select("entry", "pos", *(c.alias(vc(n)) for n, c in shown.items()))
            self._frames[axis] = out
        return self._frames[axis]

    def _matrices(self):
        if self._cells is None:
            out: dict[tuple[str, str], dict[str, Matrix]] = {}
            for key, value in self._spec_data.items():
                if not isinstance(key, tuple) or len(key) != 3:
                    continue
                rows = list(self.source) if key[0] == ALL else [key[0]]
                cols = list(self.source) if key[1] == ALL else [key[1]]
                for r in rows:
                    for c in cols:
                        if r not in self.source or c not in self.source:
                            continue
                        pair = (self.source[r][0], self.source[c][0])
                        for name in self.base.matrices_set(*pair, relayout=False) if key[2] == ALL else [key[2]]:
                            if value is None:
                                out.get((r, c), {}).pop(name, None)
                                out.get((c, r), {}).pop(name, None)
                                continue
                            if value == "=":
                                m = self.base.matrix(*pair, name)
                            else:
                                got = self.base.query(self._text(value, pair, "::"))
                                if got.kind != "matrix":
                                    raise ValueError(f"not a matrix query: {value}")
                                m = Matrix(got.df, got.background)
                            cells = m.df
                            for side, axis in (("row", r), ("col", c)):
                                if self.source[axis][1] is not None:
                                    cells = cells.join(self.source[axis][1].select(F.col("entry").alias(side)), side, "left_semi").select("row", "col", "value")
                            out.setdefault((r, c), {})[name] = Matrix(cells, m.background)
            self._cells = out
        return self._cells

    def axis_indices(self, axis, entries, allow_empty=False, allow_missing=False):
        order = {e: i + 1 for i, e in enumerate(self.axis_entries(axis))}
        missing = [e for e in entries if e not in order and not (allow_missing or (allow_empty and e == ""))]
        if missing:
            raise KeyError(f"missing entry: {missing[0]} of the axis: {axis}")
        return [order.get(e, 0) for e in entries]

    def is_leaf(self) -> bool:
        return False


def viewer(base: Reader, name: str | None = None, axes: Mapping | None = None, data: Mapping | None = None) -> Reader:
    """A view of base; without axes and data, base itself, guarded."""
    if axes is None and data is None:
        from ..dataset import read_only

        return read_only(base, name)
    return View(base, axes, data, name)

