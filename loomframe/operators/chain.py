"""Chains: several data sets seen as one, the last that has a property giving it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..dataset import Dataset, Matrix, Reader, ReadOnly, read_only, vc


class Chain(Reader):
    """A read-only chain. Properties are resolved by name, whole; no rows are joined but to bring an axis's vectors from
    several members together."""

    def __init__(self, members: Sequence[Reader], name: str | None = None, check: bool = True):
        if not members:
            raise ValueError("an empty chain")
        self.members = list(members)
        self.spark, self.name = members[0].spark, name or ";".join(m.name for m in members)
        self._frames: dict = {}
        if check:
            for axis in self.axes_set():
                self._same(axis)

    def _same(self, axis: str) -> None:
        """Every member's axis has the same entries in the same places."""
        frames = [m.axis_frame(axis) for m in self.members if m.has_axis(axis)]
        for other in frames[1:]:
            if other is frames[0]:
                continue
            a, b = (f.select("entry", "pos") for f in (frames[0], other))
            if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
                raise ValueError(f"different entries of the axis: {axis} in the chain: {self.name}")

    def _scalars(self):
        return {k: v for m in self.members for k, v in m._scalars().items()}

    def _axes(self):
        names = {a for m in self.members for a in m._axes()}
        return {a: self._frame(a) for a in names}

    def _frame(self, axis: str):
        holders = [m for m in self.members if m.has_axis(axis)]
        frames = tuple(m.axis_frame(axis) for m in holders)
        if self._frames.get(axis, (None,))[0] != tuple(map(id, frames)):
            owner = {c: k for k, f in enumerate(frames) for c in f.columns if c.startswith("v_")}
            out = frames[0].select("entry", "pos", *(F.col(f"`{c}`") for c in owner if owner[c] == 0))
            for k in range(1, len(frames)):
                mine = [c for c in owner if owner[c] == k]
                if mine:
                    out = out.join(frames[k].select("entry", *(F.col(f"`{c}`") for c in mine)), "entry")
            self._frames[axis] = (tuple(map(id, frames)), out, frames)
        return self._frames[axis][1]

    def _matrices(self):
        out: dict[tuple[str, str], dict[str, Matrix]] = {}
        for m in self.members:
            for (r, c), named in m._matrices().items():
                for n, x in named.items():
                    out.get((c, r), {}).pop(n, None)
                    out.setdefault((r, c), {})[n] = x
        return out

    def is_leaf(self) -> bool:
        return False


class WriteChain(Chain):
    """A chain whose last member takes the changes."""

    writable = True

    def __init__(self, members: Sequence[Reader], name: str | None = None):
        if not members or not members[-1].writable:
            raise TypeError("the last of a chain must be writable")
        super().__init__(members, name)
        self.writer: Dataset = members[-1]

    def _earlier(self, has) -> bool:
        return any(has(m) for m in self.members[:-1])

    def _with_axis(self, axis: str) -> None:
        if not self.writer.has_axis(axis):
            self.writer.add_axis(axis, self.axis_frame(axis).select("entry", "pos"), check=False)

    def set_scalar(self, name, value, overwrite=False):
        if self.has_scalar(name) and not overwrite:
            raise KeyError(f"existing scalar: {name}")
        self.writer.set_scalar(name, value, True)

    def add_axis(self, axis, entries, check=True):
        if self.has_axis(axis):
            raise KeyError(f"existing axis: {axis}")
        self.writer.add_axis(axis, entries, check)

    def set_vector(self, axis, name, values, overwrite=False):
        if name not in ("name", "index") and self.has_vector(axis, name) and not overwrite:
            raise KeyError(f"existing vector: {name} of the axis: {axis}")
        self._with_axis(axis)
        self.writer.set_vector(axis, name, values, True)

    def set_matrix(self, rows, cols, name, cells, background=None, overwrite=False, relayout=True):
        if self.has_matrix(rows, cols, name) and not overwrite:
            raise KeyError(f"existing matrix: {name}")
        self._with_axis(rows)
        self._with_axis(cols)
        self.writer.set_matrix(rows, cols, name, cells, background, True)

    def relayout_matrix(self, rows, cols, name):
        self.matrix(rows, cols, name)

    def _delete(self, what: str, name: str, has, delete, must_exist: bool):
        if self._earlier(has):
            raise KeyError(f"the {what}: {name} is in an earlier member of the chain: {self.name}")
        delete(must_exist=must_exist)

    def delete_scalar(self, name, must_exist=True):
        self._delete("scalar", name, lambda m: m.has_scalar(name), lambda **k: self.writer.delete_scalar(name, **k), must_exist)

    def delete_axis(self, axis, must_exist=True):
        self._delete("axis", axis, lambda m: m.has_axis(axis), lambda **k: self.writer.delete_axis(axis, **k), must_exist)

    def delete_vector(self, axis, name, must_exist=True):
        self._delete("vector", name, lambda m: m.has_axis(axis) and vc(name) in m.axis_frame(axis).columns, lambda **k: self.writer.delete_vector(axis, name, **k), must_exist)

    def delete_matrix(self, rows, cols, name, must_exist=True):
        self._delete("matrix", name, lambda m: m.has_matrix(rows, cols, name), lambda **k: self.writer.delete_matrix(rows, cols, name, **k), must_exist)


def chain_reader(members: Sequence[Reader], name: str | None = None) -> Reader:
    """The members as one read-only data set; a single one is only guarded."""
    members = list(members)
    if not members:
        raise ValueError("an empty chain")
    return read_only(members[0], name) if len(members) == 1 else Chain(members, name)


def chain_writer(members: Sequence[Reader], name: str | None = None) -> Reader:
    """The members as one data set; changes go to the last."""
    members = list(members)
    if len(members) == 1 and members[0].writable:
        return members[0]
    return WriteChain(members, name)


__all__ = ["Chain", "ReadOnly", "WriteChain", "chain_reader", "chain_writer"]
