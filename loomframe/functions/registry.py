"""What operations there are, what parameters they take, and how users add their own."""

from __future__ import annotations

import inspect
from collections.abc import Callable

# The parameters of the operations that queries know.
REDUCTIONS = {
    "Sum": ("type",), "Mean": ("type",), "Min": (), "Max": (), "Count": ("type",), "Var": ("type",), "Std": ("type",),
    "VarN": ("type", "eps"), "StdN": ("type", "eps"), "Median": ("type",), "Quantile": ("type", "p"),
    "GeoMean": ("type", "eps"), "Mode": (),
}
ELTWISE = {
    "Abs": ("type",), "Exp": ("type",), "Sqrt": ("type",), "Log": ("type", "base", "eps"), "Round": ("type",),
    "Clamp": ("type", "min", "max"), "Convert": ("type",), "Fraction": ("type",), "Significant": ("high", "low"),
}
STRINGS = ("Count", "Mode")

_own: dict[str, dict[str, tuple[Callable, str]]] = {"reduction": {}, "eltwise": {}}
_changes = 0


def changes() -> int:
    """How often users' operations have changed."""
    return _changes


def _register(family: str, name: str, fn: Callable, overwrite: bool) -> None:
    caller = inspect.stack()[2]
    place = f"{caller.filename}:{caller.lineno}"
    known = {**(REDUCTIONS if family == "reduction" else ELTWISE), **_own[family]}
    if name in known and not overwrite:
        first = _own[family][name][1] if name in _own[family] else "the library"
        raise ValueError(f"conflicting registrations of the {family} {name}: first in {first}, second in {place}")
    _own[family][name] = (fn, place)
    _changed()


def _changed() -> None:
    global _changes
    _changes += 1


def register_reduction(name: str, fn: Callable, overwrite: bool = False) -> None:
    """Adds a reduction: fn(values, **params) gives an aggregate Column of the column of values. Cells that a sparse
    matrix does not store are added before it runs."""
    _register("reduction", name, fn, overwrite)


def register_eltwise(name: str, fn: Callable, overwrite: bool = False) -> None:
    """Adds an element-wise operation: fn(values, **params) gives a Column."""
    _register("eltwise", name, fn, overwrite)


def register_query_operation(kind: str, name: str, fn: Callable, overwrite: bool = False) -> None:
    _register(kind, name, fn, overwrite)


def unregister(family: str, name: str) -> None:
    _own[family].pop(name, None)
    _changed()


def own(family: str, name: str) -> Callable | None:
    return _own[family][name][0] if name in _own[family] else None


def reduction_names() -> list[str]:
    return sorted({*REDUCTIONS, *_own["reduction"]})


def eltwise_names() -> list[str]:
    return sorted({*ELTWISE, *_own["eltwise"]})


registered_reductions, registered_eltwise = reduction_names, eltwise_names


def accepted(family: str, name: str) -> frozenset[str]:
    fn = own(family, name)
    if fn is None:
        return frozenset((REDUCTIONS if family == "reduction" else ELTWISE)[name])
    return frozenset(list(inspect.signature(fn).parameters)[1:]) | {"type"}
