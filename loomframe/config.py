"""Settings, handlers of inefficient actions, and kept query results."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import SparkSession

HANDLERS: dict[str, Callable[[str], None]] = {"ignore": lambda message: None, "warn": lambda message: warnings.warn(message, stacklevel=3)}


@dataclass
class Settings:
    """kept_queries: results that keep() holds at once; kept_plans: plans that a data set holds at once."""

    kept_queries: int = 64
    kept_plans: int = 256
    generation: int = 0
    inefficient: str = "warn"
    kept: dict = field(default_factory=dict)


settings = Settings()


def _fail(message: str) -> None:
    raise RuntimeError(message)


HANDLERS["error"] = _fail


def register_handler(name: str, fn: Callable[[str], None]) -> None:
    HANDLERS[name] = fn


def inefficient_action_handler(name: str) -> str:
    """Sets what happens on inefficient actions, and returns what did before."""
    if name not in HANDLERS:
        raise KeyError(name)
    before, settings.inefficient = settings.inefficient, name
    return before


def inefficient(message: str) -> None:
    HANDLERS[settings.inefficient](message)


def identity(ds) -> str:
    """A name of the data set that no other ever has."""
    return ds.__dict__.setdefault("_identity", uuid.uuid4().hex)


def planned(ds, query):
    """The query's lazy result, planned once under the versions of everything in ds and the users' operations; data sets
    without versions plan each time."""
    from .functions import registry
    from .plans.compile import run_query
    from .plans.nodes import canonical_query, nodes_of

    versions, nodes = getattr(ds, "versions", None), nodes_of(query)
    if versions is None:
        return run_query(ds, nodes)
    key = (canonical_query(nodes), settings.generation, registry.changes(), tuple(sorted(versions.items(), key=str)))
    plans = ds.__dict__.setdefault("_plans", {})
    if key not in plans:
        while len(plans) >= settings.kept_plans:
            plans.pop(next(iter(plans)))
        plans[key] = run_query(ds, nodes)
    return plans[key]


def keep(ds, query):
    """The query's result, persisted in memory and on disk under the versions of everything in ds; older ones go first.
    Data sets without versions are not kept."""
    from .plans.nodes import canonical_query, nodes_of

    versions = getattr(ds, "versions", None)
    if versions is None:
        return ds.query(query)
    key = (identity(ds), canonical_query(nodes_of(query)), tuple(sorted(versions.items(), key=str)))
    if key not in settings.kept:
        while len(settings.kept) >= settings.kept_queries:
            settings.kept.pop(next(iter(settings.kept))).df.unpersist()
        result = ds.query(query)
        result.df.persist(StorageLevel.MEMORY_AND_DISK)
        settings.kept[key] = result
    return settings.kept[key]


def empty_cache(clear: Iterable | None = None) -> None:
    """Lets go of kept results and plans: all, or those of the data sets given."""
    if clear is None:
        settings.generation += 1
    else:
        clear = list(clear)
        for d in clear:
            d.__dict__.pop("_plans", None)
    ids = None if clear is None else {identity(d) for d in clear}
    for key in [k for k in settings.kept if ids is None or k[0] in ids]:
        settings.kept.pop(key).df.unpersist()


def set_num_threads(spark: SparkSession, n: int) -> None:
    """Shuffle partitions of the session; its cores are the cluster's to give."""
    spark.conf.set("spark.sql.shuffle.partitions", n)


def get_num_threads(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism
