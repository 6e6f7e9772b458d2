"""Reordering axes, reconstructing an axis from a vector, and groups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset, Reader, numbered, q, vc
from ..functions.fnv import group_hashes


def reorder_axes(*sets: Dataset, **permutations: Sequence[int] | DataFrame) -> None:
    """Gives each axis a new order in all sets: new place i holds the entry of the 1-based place permutation[i], or a
    DataFrame (entry, pos) says each entry's place. Only places change; cells refer to entries."""
    for ds in sets:
        if not ds.is_leaf() or not ds.writable:
            raise TypeError(f"not a data set of its own: {ds.name}")
        for axis, order in permutations.items():
            frame = ds.axis_frame(axis)
            if not isinstance(order, DataFrame):
                if sorted(order) != list(range(1, ds.axis_length(axis) + 1)):
                    raise ValueError(f"not a permutation of the axis: {axis}")
                places = ds.spark.createDataFrame([(p - 1, i) for i, p in enumerate(order)], "pos long, __to long")
                ranked = numbered(frame.select("entry", F.col("pos").alias("__old")), "__old").select("entry", "pos")
                order = ranked.join(places, "pos").select("entry", F.col("__to").alias("pos"))
            out = frame.drop("pos").join(order.select("entry", "pos"), "entry")
            history = ds.__dict__.setdefault("_reordered", {})
            history.setdefault(axis, frame.select("entry", "pos"))
            ds.axes[axis] = out.select("entry", "pos", *(q(c) for c in out.columns if c.startswith("v_")))
            ds._bump("axis", axis)


def reset_reorder_axes(*sets: Dataset) -> None:
    """Undoes reorder_axes since the last commit_reorder_axes."""
    for ds in sets:
        for axis, before in ds.__dict__.pop("_reordered", {}).items():
            frame = ds.axis_frame(axis).drop("pos").join(before, "entry")
            ds.axes[axis] = frame.select("entry", "pos", *(q(c) for c in frame.columns if c.startswith("v_")))
            ds._bump("axis", axis)


def commit_reorder_axes(*sets: Dataset) -> None:
    for ds in sets:
        ds.__dict__.pop("_reordered", None)


def reconstruct_axis(ds: Dataset, existing_axis: str, implicit_axis: str, rename_axis: str | None = None, empty_implicit: object = "", implicit_properties: Iterable[str] | None = None, skipped_properties: Iterable[str] = (), properties_defaults: Mapping[str, object] | None = None) -> dict[str, object]:
    """Makes an axis of the distinct values, other than empty, of a vector of an existing axis, in bytewise order.

    Vectors of the existing axis that have one value for each entry of the new one move there (implicit_properties: just
    those, which must; skipped_properties: not those). Returns, by moved property, its value where the implicit one is
    empty: given by properties_defaults or the single one there, or None. The implicit vector becomes text.
    """
    frame = ds.axis_frame(existing_axis)
    if not ds.has_vector(existing_axis, implicit_axis):
        raise KeyError(f"missing vector: {implicit_axis} of the axis: {existing_axis}")
    new_axis = rename_axis or implicit_axis
    key = q(vc(implicit_axis)).cast("string")
    is_empty = key == F.lit(str(empty_implicit)) if empty_implicit is not None else F.lit(False)
    candidates = list(implicit_properties) if implicit_properties is not None else [v for v in ds.vectors_set(existing_axis) if v != implicit_axis]
    candidates = [v for v in candidates if v not in set(skipped_properties)]
    keyed = frame.withColumn("__key", key).withColumn("__empty", is_empty)
    one = {v: (F.min_by(q(vc(v)), "pos"), F.min(q(vc(v))), F.max(q(vc(v)))) for v in candidates}
    members = keyed.where(~F.col("__empty")).groupBy("__key").agg(*(x.alias(f"{p}{k}") for k, v in enumerate(candidates) for p, x in zip("alh", one[v])))
    # one row: which vectors have one value in every group; and what they hold where the key is empty
    single = members.agg(*(F.coalesce(F.bool_and(F.col(f"l{k}").eqNullSafe(F.col(f"h{k}"))), F.lit(True)).alias(f"s{k}") for k in range(len(candidates))), F.count(F.lit(1)).alias("n")).first()
    blank = keyed.where("__empty").agg(*(x.alias(f"{p}{k}") for k, v in enumerate(candidates) for p, x in (("l", one[v][1]), ("h", one[v][2]))), F.count(F.lit(1)).alias("n")).first()
    moved, empties = [], {}
    for k, v in enumerate(candidates):
        if not single[f"s{k}"]:
            if implicit_properties is not None:
                raise ValueError(f"several values of {v} for one of the axis: {new_axis}")
            continue
        value = (properties_defaults or {}).get(v)
        if blank["n"] and value is None:
            if blank[f"l{k}"] != blank[f"h{k}"]:
                if implicit_properties is not None:
                    raise ValueError(f"several values of {v} without one of the axis: {new_axis}")
                continue
            value = blank[f"l{k}"]
        moved.append((k, v))
        empties[v] = value
    entries = numbered(members.select(F.col("__key").alias("entry"), *(F.col(f"a{k}").alias(v) for k, v in moved)))
    ds.add_axis(new_axis, entries, check=False)
    for _, v in moved:
        ds.delete_vector(existing_axis, v)
    ds.set_vector(existing_axis, implicit_axis, F.when(is_empty, F.lit("")).otherwise(key), True)
    return empties


def compact_groups(ds: Reader, axis: str, name: str) -> DataFrame:
    """entry, group: group ids numbered from 1 in the order first seen; 0 stays 0. The number of groups meets only in
    range partitions."""
    values = ds.get_vector(axis, name)
    first = values.where("value <> 0").groupBy("value").agg(F.min("pos").alias("__first"))
    ranks = numbered(first, "__first").select("value", (F.col("pos") + 1).alias("group"))
    return values.join(ranks, "value", "left").select("entry", "pos", F.coalesce("group", F.lit(0)).cast("bigint").alias("group"))


def collect_group_members(ds: Reader, axis: str, name: str) -> DataFrame:
    """group, members: 1-based places of each group's entries, in order. A group's members form one value."""
    values = ds.get_vector(axis, name).where("value <> 0").join(ds.places(axis), "entry")
    return values.groupBy(F.col("value").alias("group")).agg(F.array_sort(F.collect_list(F.col("__place") + 1)).alias("members"))


def group_names(ds: Reader, axis: str, name: str, prefix: str) -> DataFrame:
    """group, name: the prefix and the 32-bit FNV-1a hash, in hex, of the group's distinct entries in bytewise order,
    joined by the byte 1. No group's members form one value."""
    members = ds.get_vector(axis, name).where("value <> 0").select(F.col("value").alias("group"), "entry")
    return group_hashes(members).select("group", F.concat(F.lit(prefix), F.lpad(F.lower(F.hex("hash")), 8, "0")).alias("name"))
