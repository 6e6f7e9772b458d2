"""Concatenation of data sets along axes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import functions as F

from ..dataset import Dataset, Reader, q, vc

SkipProperty, LastValue, CollectAxis = "SkipProperty", "LastValue", "CollectAxis"


def concatenate(to: Dataset, axis: str | Sequence[str], sources: Sequence[Reader], names: Sequence[str] | None = None, dataset_axis: str | None = "dataset", dataset_property: bool = True, prefix: bool | Sequence[bool] = False, prefixed: Mapping[str, Sequence[str]] | None = None, empty: Mapping[str, object] | None = None, merge: Mapping | None = None, overwrite: bool = False) -> None:
    """Puts the sources' entries of each axis one after the other, with their vectors and matrices.

    names: of the sources, unique; entries of a prefixed axis become <name>.<entry>, and so do vectors that refer to it:
    those named in prefixed, or, without that, those named as the axis or axis.<more>. A property that a source lacks
    takes its value of empty (axis|name, rows|cols|name). Other axes must be the same in all sources. merge says what
    becomes of scalars (name), and of vectors ((axis, name)) and matrices ((rows, cols, name)) of other axes: SkipProperty
    (the default), LastValue, or CollectAxis, along the dataset axis; "*" in a key stands for any name.
    """
    axes = [axis] if isinstance(axis, str) else list(axis)
    names = list(names or (s.name for s in sources))
    if len(set(names)) != len(names) or len(names) != len(sources):
        raise ValueError("the sources' names must be unique")
    prefixes = dict(zip(axes, [prefix] * len(axes) if isinstance(prefix, bool) else prefix))
    empty, merge = dict(empty or {}), dict(merge or {})
    if dataset_axis is not None:
        to.add_axis(dataset_axis, names)

    def renamed(c, name: str, a: str):
        return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit(f"{name}."), c)) if prefixes[a] else c

    def refers(a: str, vector: str) -> str | None:
        """The prefixed axis that a vector's values are entries of."""
        for target in axes:
            if prefixes[target]:
                said = (prefixed or {}).get(a)
                if vector in said if said is not None else vector == target or vector.startswith(f"{target}."):
                    return target
        return None

    for a in axes:
        vectors = sorted({v for s in sources for v in s.vectors_set(a)})
        parts, at = [], 0
        for s, name in zip(sources, names):
            frame = s.axis_frame(a)
            cols = [renamed(F.col("entry"), name, a).alias("entry"), (F.col("pos") + at).alias("pos")]
            for v in vectors:
                if s.has_vector(a, v):
                    target = refers(a, v)
                    cols.append((renamed(q(vc(v)), name, target) if target else q(vc(v))).alias(v))
                elif f"{a}|{v}" in empty:
                    cols.append(F.lit(empty[f"{a}|{v}"]).alias(v))
                else:
                    raise KeyError(f"missing vector: {v} of the axis: {a} in the data set: {name}, and no empty value")
            if dataset_axis is not None and dataset_property:
                cols.append(F.lit(name).alias(dataset_axis))
            parts.append(frame.select(*cols))
            at += (frame.agg(F.max("pos")).first()[0] or 0) + 1  # pos stays in order; places() has no gaps
        to.add_axis(a, reduce(lambda x, y: x.unionByName(y), parts))

    others = sorted({a for s in sources for a in s.axes_set()} - set(axes))
    for a in others:
        holders = [s for s in sources if s.has_axis(a)]
        first = holders[0].axis_frame(a).select("entry", "pos")
        for s in holders[1:]:
            other = s.axis_frame(a).select("entry", "pos")
            if first.exceptAll(other).limit(1).count() or other.exceptAll(first).limit(1).count():
                raise ValueError(f"different entries of the axis: {a}, which is not concatenated")
        to.add_axis(a, first, check=False)

    pairs = sorted({(r, c, n) for s in sources for (r, c), named in s._matrices().items() for n in named})
    done = set()
    for r, c, n in pairs:
        if (c, r, n) in done:
            continue
        done.add((r, c, n))
        if r in axes and c in axes:
            continue  # cells between entries of different sources are not known
        if r in axes or c in axes:
            side, a = ("row", r) if r in axes else ("col", c)
            parts, backgrounds = [], set()
            for s, name in zip(sources, names):
                key = next((k for k in (f"{r}|{c}|{n}", f"{c}|{r}|{n}") if k in empty), None)
                if s.has_matrix(r, c, n):
                    m = s.matrix(r, c, n)
                    parts.append(m.df.withColumn(side, renamed(F.col(side), name, a)))
                    backgrounds.add(m.background)
                elif key is not None:
                    backgrounds.add(empty[key])
                else:
                    raise KeyError(f"missing matrix: {n} in the data set: {name}, and no empty value")
            if len(backgrounds) > 1:
                if None in backgrounds and len(parts) == len(sources):
                    parts = []
                    for s, name in zip(sources, names):
                        parts.append(s.query(f"@ {r} @ {c} :: {n}").dense().withColumn(side, renamed(F.col(side), name, a)))
                    backgrounds = {None}
                elif len(backgrounds - {None}) == 1 and len(parts) < len(sources):
                    backgrounds -= {None}  # stored cells say the rest
                else:
                    raise ValueError(f"different values of cells that are not stored in the matrix: {n}")
            to.set_matrix(r, c, n, reduce(lambda x, y: x.unionByName(y), parts), backgrounds.pop(), overwrite)
        else:
            _merge(to, sources, names, (r, c, n), merge, empty, dataset_axis, overwrite)
    for a in others:
        for v in sorted({v for s in sources if s.has_axis(a) for v in s.vectors_set(a)}):
            _merge(to, sources, names, (a, v), merge, empty, dataset_axis, overwrite)
    for scalar in sorted({n for s in sources for n in s.scalars_set()}):
        _merge(to, sources, names, scalar, merge, empty, dataset_axis, overwrite)


def action(key, merge: Mapping) -> str:
    """What merge says of a key: itself first, else the most specific key with * that fits."""
    if key in merge:
        return merge[key]
    parts = (key,) if isinstance(key, str) else key
    fits = []
    for k, v in merge.items():
        other = (k,) if isinstance(k, str) else k
        if len(other) == len(parts) and all(b in ("*", a) for a, b in zip(parts, other)):
            fits.append((sum(b != "*" for b in other), v))
    return max(fits, key=lambda x: x[0])[1] if fits else SkipProperty


def _merge(to, sources, names, key, merge, empty, dataset_axis, overwrite) -> None:
    how = action(key, merge)
    if how == SkipProperty:
        return
    if isinstance(key, str):
        held = [(n, s.get_scalar(key)) for s, n in zip(sources, names) if s.has_scalar(key)]
        if how == LastValue:
            to.set_scalar(key, held[-1][1], overwrite)
            return
        known = dict(held)
        if len(known) < len(names) and key not in empty:
            raise KeyError(f"missing scalar: {key}, and no empty value")
        to.set_vector(dataset_axis, key, [known.get(n, empty.get(key)) for n in names], overwrite)
    elif len(key) == 2:
        a, v = key
        held = [(n, s.get_vector(a, v)) for s, n in zip(sources, names) if s.has_axis(a) and s.has_vector(a, v)]
        if how == LastValue:
            to.set_vector(a, v, held[-1][1].select("entry", "value"), overwrite)
            return
        blank = empty.get(f"{a}|{v}")
        if len(held) < len(names) and blank is None:
            raise KeyError(f"missing vector: {v} of the axis: {a}, and no empty value")
        cells = reduce(lambda x, y: x.unionByName(y), [df.select(F.col("entry").alias("row"), F.lit(n).alias("col"), "value") for n, df in held])
        to.set_matrix(a, dataset_axis, v, cells, blank if len(held) < len(names) else None, overwrite)
    else:
        r, c, n = key
        if how == CollectAxis:
            raise ValueError(f"cannot collect the matrix: {n} in three dimensions")
        m = [s for s in sources if s.has_matrix(r, c, n)][-1].matrix(r, c, n)
        to.set_matrix(r, c, n, m.df, m.background, overwrite)
