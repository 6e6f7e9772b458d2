"""Queries built in Python: Axis("cell") | LookupVector("age") | IsGreater(2)."""

from __future__ import annotations

from dataclasses import dataclass

from .functions import registry
from .plans.nodes import TYPES, Node, canonical_query, checked, nodes_of


@dataclass(frozen=True)
class Query:
    """Nodes in order. Queries compose by |, with other queries or query text."""

    nodes: tuple[Node, ...] = ()

    def __or__(self, other) -> Query:
        nodes = (*self.nodes, *nodes_of(other))
        checked(nodes)
        return Query(nodes)

    def __ror__(self, other) -> Query:
        return Query(nodes_of(other)) | self

    @property
    def canonical(self) -> str:
        return canonical_query(self.nodes)

    def __str__(self) -> str:
        return self.canonical


def text(value) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def one(kind: str, name=None, params: dict | None = None, negated: bool = False) -> Query:
    return Query((Node(kind, None if name is None else text(name), tuple(sorted((k, text(v)) for k, v in (params or {}).items() if v is not None)), negated),))


def _lookup(kind: str):
    def build(name=None) -> Query:
        return one(kind) | one("Names") if name == "?" else one(kind, name)

    build.__name__ = kind
    return build


def _named(kind: str, optional: bool = False, negated: bool = False):
    def build(*name) -> Query:
        if len(name) > 1 or not (name or optional):
            raise TypeError(f"{kind} takes one value")
        return one(kind, *name, negated=negated)

    build.__name__ = kind
    return build


def Names() -> Query:
    return one("Names")


def Axis(name: str) -> Query:
    return Query((Node("Names", "axes"),)) if name == "?" else one("Axis", name)


def EndMask() -> Query:
    return one("EndMask")


def IfMissing(value, type: str | None = None) -> Query:
    return one("IfMissing", value, {"type": TYPES[type.lower()] if type else None})


LookupScalar, LookupVector, LookupMatrix = map(_lookup, ("LookupScalar", "LookupVector", "LookupMatrix"))
AsAxis, IfNot = _named("AsAxis", True), _named("IfNot", True)
BeginMask, AndMask, OrMask, XorMask = map(_named, ("BeginMask", "AndMask", "OrMask", "XorMask"))
BeginNegatedMask, AndNegatedMask, OrNegatedMask, XorNegatedMask = (_named(k, negated=True) for k in ("BeginMask", "AndMask", "OrMask", "XorMask"))
IsLess, IsLessEqual, IsEqual, IsNotEqual, IsGreater, IsGreaterEqual, IsMatch, IsNotMatch = map(_named, ("IsLess", "IsLessEqual", "IsEqual", "IsNotEqual", "IsGreater", "IsGreaterEqual", "IsMatch", "IsNotMatch"))
SquareColumnIs, SquareRowIs, GroupBy, GroupRowsBy, GroupColumnsBy, CountBy = map(_named, ("SquareColumnIs", "SquareRowIs", "GroupBy", "GroupRowsBy", "GroupColumnsBy", "CountBy"))


@dataclass(frozen=True)
class Operation(Query):
    """An operation that its place will make element-wise, or a reduction to a scalar, row or column."""


def _operation(name: str, family: str):
    kind = "Eltwise" if family == "eltwise" else "ReduceToScalar"

    def build(**params) -> Operation:
        known = registry.accepted(family, name)
        if unknown := set(params) - known:
            raise TypeError(f"the operation {name} takes no parameters {sorted(unknown)}")
        if params.get("type"):
            params["type"] = TYPES[params["type"].lower()]
        return Operation(one(kind, name, params).nodes)

    build.__name__ = name
    return build


Abs, Clamp, Convert, Exp, Fraction, Log, Round, Significant, Sqrt = (_operation(n, "eltwise") for n in ("Abs", "Clamp", "Convert", "Exp", "Fraction", "Log", "Round", "Significant", "Sqrt"))
Count, GeoMean, Max, Mean, Median, Min, Mode, Quantile, Std, StdN, Sum, Var, VarN = (_operation(n, "reduction") for n in ("Count", "GeoMean", "Max", "Mean", "Median", "Min", "Mode", "Quantile", "Std", "StdN", "Sum", "Var", "VarN"))


def _reduce(kind: str, operation: Query) -> Query:
    (node,) = operation.nodes
    if node.kind != "ReduceToScalar":
        raise TypeError(f"not a reduction: {operation}")
    return Query((Node(kind, node.name, node.params),))


def ReduceToColumn(operation: Query) -> Query:
    return _reduce("ReduceToColumn", operation)


def ReduceToRow(operation: Query) -> Query:
    return _reduce("ReduceToRow", operation)


def ReduceToScalar(operation: Query) -> Query:
    return _reduce("ReduceToScalar", operation)
