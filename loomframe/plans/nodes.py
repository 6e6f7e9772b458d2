"""Query text: tokens, nodes and canonical text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from ..functions.registry import accepted, eltwise_names, reduction_names


class QueryError(ValueError):
    """A query that is not well-formed or does not fit the data set."""


@dataclass(frozen=True)
class Node:
    """One operation of a query. kind: what it is; name: its property, axis, value or operation; params: the rest."""

    kind: str
    name: str | None = None
    params: tuple[tuple[str, str], ...] = ()
    negated: bool = False

    def param(self, key: str, default=None):
        return dict(self.params).get(key, default)


# The operators' spellings and what they stand for.
OPERATORS = {
    "?": "Names", "@": "Axis", "=@": "AsAxis", ".": "LookupScalar", ":": "LookupVector", "::": "LookupMatrix",
    "||": "IfMissing", "??": "IfNot", "[": "BeginMask", "]": "EndMask", "&": "AndMask", "|": "OrMask", "^": "XorMask",
    "<": "IsLess", "<=": "IsLessEqual", "=": "IsEqual", "!=": "IsNotEqual", ">": "IsGreater", ">=": "IsGreaterEqual",
    "~": "IsMatch", "!~": "IsNotMatch", "@|": "SquareColumnIs", "@-": "SquareRowIs", "/": "GroupBy", "-/": "GroupRowsBy",
    "|/": "GroupColumnsBy", "*": "CountBy", "%": "Eltwise", ">>": "ReduceToScalar", ">|": "ReduceToColumn", ">-": "ReduceToRow",
}
SPELLED = {kind: text for text, kind in OPERATORS.items()}
TYPES = {t.lower(): t for t in "Bool Int8 Int16 Int32 Int64 UInt8 UInt16 UInt32 UInt64 Float32 Float64 String".split()} | {"int": "Int64"}
COMPARISONS = ("IsLess", "IsLessEqual", "IsEqual", "IsNotEqual", "IsGreater", "IsGreaterEqual", "IsMatch", "IsNotMatch")

_SPELLINGS = sorted((*OPERATORS, "!"), key=len, reverse=True)
_TOKEN = re.compile(
    r"(?P<skip>\s+|\#[^\r\n]*)"
    r"|(?P<empty>'')"
    rf"|(?P<op>{'|'.join(map(re.escape, _SPELLINGS))})"
    r'|"(?P<quoted>(?:[^"\\]|\\.)*)"'
    r"|(?P<bare>(?:\\.|[0-9A-Za-z_.+\-]|[^\x00-\x7F])+)",
    re.S,
)
_SAFE = re.compile(r"[0-9A-Za-z_.+\-]|[^\x00-\x7F]")


def tokens(text: str) -> list[tuple[bool, str, int]]:
    """(is an operator, text, place) of each token."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at position {at + 1} in query {text!r}")
        if m["op"]:
            out.append((True, m["op"], at + 1))
        elif m["empty"]:
            out.append((False, "", at + 1))
        elif m["quoted"] is not None or m["bare"]:
            out.append((False, re.sub(r"\\(.)", r"\1", m["quoted"] if m["bare"] is None else m["bare"], flags=re.S), at + 1))
        at = m.end()
    return out


def escape_value(value: str) -> str:
    """value as a query may hold it."""
    if value == "":
        return "''"
    out = "".join(c if _SAFE.match(c) else "\\" + c for c in value)
    return "\\" + out if out[0] == "." else out


def unescape_value(value: str) -> str:
    return "" if value == "''" else re.sub(r"\\(.)", r"\1", value, flags=re.S)


def number(text: str) -> float:
    """A number as queries write it; e, pi, nan and inf are words for one."""
    import math

    words = {"e": math.e, "pi": math.pi, "nan": math.nan, "inf": math.inf, "+inf": math.inf, "-inf": -math.inf}
    try:
        return words[text.lower()] if text.lower() in words else float(text)
    except ValueError:
        raise QueryError(f"not a number: {text!r}") from None


class _Reader:
    def __init__(self, text: str):
        self.text, self.all, self.at = text, tokens(text), 0

    def fail(self, what: str):
        place = self.all[self.at][2] if self.at < len(self.all) else len(self.text) + 1
        raise QueryError(f"{what} at position {place} in query {self.text!r}")

    def value(self) -> str | None:
        if self.at < len(self.all) and not self.all[self.at][0]:
            self.at += 1
            return self.all[self.at - 1][1]
        return None

    def need(self, what: str) -> str:
        got = self.value()
        return got if got is not None else self.fail(f"expected {what}")

    def operator(self, *which: str) -> bool:
        if self.at < len(self.all) and self.all[self.at][0] and self.all[self.at][1] in which:
            self.at += 1
            return True
        return False

    def params(self, of: str, known: frozenset[str]) -> tuple[tuple[str, str], ...]:
        out: dict[str, str] = {}
        while (key := self.value()) is not None:
            self.operator(":")
            value = self.need(f"a value of the parameter {key!r}")
            if key in out:
                self.fail(f"repeated parameter {key!r} of {of}")
            if key not in known:
                self.fail(f"the operation {of} takes no parameter {key!r}")
            if key == "type":
                if value.lower() not in TYPES:
                    self.fail(f"unknown type {value!r}")
                value = TYPES[value.lower()]
            else:
                number(value)
            out[key] = value
        return tuple(sorted(out.items()))

    def node(self) -> Node:
        is_operator, text, _ = self.all[self.at]
        if not is_operator:
            self.fail(f"expected an operator, got the value {text!r}")
        if text not in OPERATORS:
            self.fail(f"unexpected operator {text!r}")
        self.at += 1
        kind = OPERATORS[text]
        if kind in ("Names", "EndMask"):
            return Node(kind)
        if kind == "Axis":
            return Node("Names", "axes") if self.operator("?") else Node(kind, self.need("an axis name"))
        if kind in ("LookupScalar", "LookupVector", "LookupMatrix", "AsAxis", "IfNot"):
            return Node(kind, self.value())
        if kind in ("BeginMask", "AndMask", "OrMask", "XorMask"):
            negated = self.operator("!")
            return Node(kind, self.need("a property"), negated=negated)
        if kind in ("IsMatch", "IsNotMatch"):
            parts = []
            while self.at < len(self.all) and self.all[self.at][1:2] != ("]",):
                if self.all[self.at][0] and parts and self.all[self.at][1] in ("&", "^", "|", ">>", ">|", ">-", "%"):
                    break
                parts.append(self.all[self.at][1])
                self.at += 1
            return Node(kind, "".join(parts)) if parts else self.fail("expected a pattern")
        if kind == "IfMissing":
            value = self.need("a value")
            word = self.value()
            if word is not None and word.lower() == "type":
                word = self.need("a type")
            if word is None:
                return Node(kind, value)
            if word.lower() not in TYPES:
                self.fail(f"unknown type {word!r}")
            return Node(kind, value, (("type", TYPES[word.lower()]),))
        if kind == "Eltwise" or kind.startswith("ReduceTo"):
            family = "eltwise" if kind == "Eltwise" else "reduction"
            name = self.need("an operation")
            if name not in (eltwise_names() if family == "eltwise" else reduction_names()):
                self.fail(f"unknown {family} operation {name!r}")
            return Node(kind, name, self.params(name, accepted(family, name)))
        return Node(kind, self.need("a value"))


@lru_cache(1024)
def parse_query(text: str) -> tuple[Node, ...]:
    """The nodes of a query's text; the last 1024 are kept."""
    reader, out = _Reader(text), []
    while reader.at < len(reader.all):
        out.append(reader.node())
    checked(tuple(out), text)
    return tuple(out)


def checked(nodes: tuple[Node, ...], text: str = "") -> None:
    if sum(n.kind == "Names" for n in nodes) > 1:
        raise QueryError(f"more than one ? in query {text!r}")
    for kind in ("Names",):
        if any(n.kind == kind for n in nodes) and any(n.kind == "BeginMask" for n in nodes):
            raise QueryError(f"names of a masked axis in query {text!r}")


def canonical_query(nodes: tuple[Node, ...]) -> str:
    """Text that parses to the nodes."""
    out = []
    for n in nodes:
        if n.kind == "Names":
            out.append("@ ?" if n.name == "axes" else "?")
            continue
        parts = [SPELLED[n.kind] + (" !" if n.negated else "")]
        if n.name is not None:
            parts.append(escape_value(n.name))
        parts += [f"type {v}" if k == "type" and n.kind == "IfMissing" else f"{k}: {escape_value(v)}" for k, v in n.params]
        out.append(" ".join(parts))
    return " ".join(out)


def nodes_of(query) -> tuple[Node, ...]:
    """Nodes of a query given as text, nodes or a builder's query."""
    if isinstance(query, str):
        return parse_query(query)
    return tuple(getattr(query, "nodes", query))


def is_axis_query(query) -> bool:
    nodes = nodes_of(query)
    return bool(nodes) and nodes[-1].kind in ("Axis", "EndMask") and sum(n.kind == "Axis" for n in outside_masks(nodes)) == 1


def outside_masks(nodes) -> list[Node]:
    out, depth = [], 0
    for n in nodes:
        depth += n.kind == "BeginMask"
        if not depth:
            out.append(n)
        depth -= n.kind == "EndMask"
    return out


def query_axis_name(query) -> str:
    names = [n.name for n in outside_masks(nodes_of(query)) if n.kind == "Axis"]
    if len(names) != 1:
        raise QueryError(f"not a query of one axis: {query!r}")
    return names[0]


def query_result_dimensions(query) -> int:
    """0 for a scalar, 1 for a vector, 2 for a matrix, -1 for names; picks of entries lower it. A reduction of groups has a
    value a group: a vector's groups make a vector, a matrix's a matrix, or a vector if its other side is reduced too."""
    dims, previous = 0, None
    for n in outside_masks(nodes_of(query)):
        if n.kind == "Names":
            return -1
        if n.kind == "Axis":
            dims += 1
        elif n.kind in ("ReduceToColumn", "ReduceToRow", "ReduceToScalar"):
            by = next((p.kind for p in reversed(previous or []) if p.kind in ("GroupBy", "GroupRowsBy", "GroupColumnsBy")), None)
            if by in ("GroupRowsBy", "GroupColumnsBy"):
                dims = 1 if (by == "GroupRowsBy") == (n.kind == "ReduceToColumn") else 2
            elif by is None:
                dims = 0 if n.kind == "ReduceToScalar" or dims < 2 else 1
        elif n.kind == "CountBy":
            dims = 2
        elif n.kind in ("SquareColumnIs", "SquareRowIs"):
            dims = 1
        elif n.kind == "IsEqual" and previous and previous[-1].kind == "Axis" and len(previous) > 1:
            dims = max(0, dims - 2) if dims > 1 else 0
        previous = [*(previous or []), n]
        if n.kind.startswith("ReduceTo"):
            previous = []
    return dims


def query_requires_relayout(query) -> bool:
    """Cells have no orientation here."""
    return False
