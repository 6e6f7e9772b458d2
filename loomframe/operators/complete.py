"""Data sets that name, in scalars of their own, the data set they were made from."""

from __future__ import annotations

import json
from collections.abc import Mapping

from ..dataset import Reader
from .chain import chain_reader, chain_writer
from .view import viewer

BASE, VIEW = "base_daf_repository", "base_daf_view"


def complete_chain(base: Reader, base_path: str, leaf, axes: Mapping | None = None, data: Mapping | None = None, name: str | None = None) -> Reader:
    """A chain of base, or a view of it, and leaf, which remembers where base is and the view."""
    leaf.set_scalar(BASE, base_path, True)
    if axes is not None or data is not None:
        said = {"axes": axes, "data": None if data is None else [["|".join(k) if isinstance(k, tuple) else k, v] for k, v in data.items()]}
        leaf.set_scalar(VIEW, json.dumps(said), True)
        base = viewer(base, None, axes, data)
    return chain_writer([base, leaf], name)


def complete_path(ds: Reader) -> str | None:
    return ds.get_scalar(BASE, None)


def complete_dataset(spark, path: str, name: str | None = None) -> Reader:
    """The data set at a path on top of all those that it and they name as their bases."""
    from ..sources.store import open_dataset

    leaf = open_dataset(spark, path)
    base_path = complete_path(leaf)
    if base_path is None:
        return leaf
    base = complete_dataset(spark, base_path)
    if (said := leaf.get_scalar(VIEW, None)) is not None:
        spec = json.loads(said)
        data = None if spec["data"] is None else {tuple(k.split("|")) if "|" in k else k: v for k, v in spec["data"]}
        base = viewer(base, None, spec["axes"], data)
    return chain_reader([base, leaf], name)
