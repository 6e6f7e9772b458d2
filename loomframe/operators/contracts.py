"""Contracts: what a computation expects of a data set, and whether it kept to that."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import wraps

from ..dataset import Reader, vc
from ..functions.columns import model_type

RequiredInput, OptionalInput, CreatedOutput, GuaranteedOutput, OptionalOutput = "RequiredInput", "OptionalInput", "CreatedOutput", "GuaranteedOutput", "OptionalOutput"
INPUTS, MANDATORY = (RequiredInput, OptionalInput), (RequiredInput, CreatedOutput, GuaranteedOutput)
OUTPUTS = (CreatedOutput, GuaranteedOutput, OptionalOutput)
# Number types from narrow to wide, in the order of merging.
WIDTH = "Bool Int8 UInt8 Int16 UInt16 Int32 UInt32 Int64 UInt64 Float32 Float64 String".split()


class ContractError(ValueError):
    """A data set, or a computation, that breaks a contract."""


@dataclass(frozen=True)
class Expected:
    expectation: str
    type: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Contract:
    """axes: name -> Expected; data: scalar name, (axis, vector), (rows, cols, matrix) or (main, rows, cols, matrix) of a
    tensor -> Expected. relaxed lets a computation use what is not declared."""

    name: str = ""
    axes: Mapping[str, Expected] = field(default_factory=dict)
    data: Mapping[object, Expected] = field(default_factory=dict)
    relaxed: bool = False

    def __post_init__(self):
        for key in self.data:
            for axis in key[:-1] if isinstance(key, tuple) else ():
                if axis not in self.axes:
                    raise ContractError(f"the axis: {axis} of {key} is not in the contract: {self.name}")


def contract_scalar(name, expectation, type=None, description=""):
    return {name: Expected(expectation, type, description)}


def contract_vector(axis, name, expectation, type=None, description=""):
    return {(axis, name): Expected(expectation, type, description)}


def contract_matrix(rows, cols, name, expectation, type=None, description=""):
    return {(rows, cols, name): Expected(expectation, type, description)}


def tensor_contract(main, rows, cols, name, expectation, type=None, description=""):
    return {(main, rows, cols, name): Expected(expectation, type, description)}


def axis_contract(axis, expectation, description=""):
    return {axis: Expected(expectation, None, description)}


def create_contract(name: str = "", axes=(), data=(), relaxed: bool = False) -> Contract:
    """A contract of the parts that the functions above make."""
    merged = lambda parts: {k: v for p in ([parts] if isinstance(parts, Mapping) else parts) for k, v in p.items()}
    return Contract(name, merged(axes), merged(data), relaxed)


def enforced() -> bool:
    return os.environ.get("LOOMFRAME_ENFORCE_CONTRACTS", "").lower() in ("1", "true", "yes", "on")


class Contracted(Reader):
    """A data set under a contract: keeps track of what is used, and refuses what is not declared."""

    def __init__(self, computation: str, contract: Contract, base: Reader, overwrite: bool = False):
        self.computation, self.contract, self.base, self.overwrite = computation, contract, base, overwrite
        self.spark, self.name, self.writable = base.spark, f"{base.name}.for.{computation}", base.writable
        self.used: set = set()

    def _scalars(self):
        return self.base._scalars()

    def _axes(self):
        return self.base._axes()

    def _matrices(self):
        return self.base._matrices()

    def _expected(self, key):
        known = self.contract.axes if key[0] == "axis" else self.contract.data
        name = key[1] if key[0] in ("axis", "scalar") else key[1:]
        found = known.get(name)
        if found is None and key[0] == "matrix":
            found = known.get((name[1], name[0], name[2]))
            for other, e in known.items():
                if isinstance(other, tuple) and len(other) == 4 and set(other[1:3]) == set(name[:2]) and name[2].endswith(f"_{other[3]}"):
                    found = found or e
                    self.used.add(other)
        return name, found

    def _access(self, *key, change: bool = False) -> None:
        name, found = self._expected(key)
        if found is None:
            if not self.contract.relaxed and not (key[0] == "vector" and name[1] in ("name", "index")):
                raise ContractError(f"undeclared {key[0]}: {name} used by the computation: {self.computation}")
            return
        if change and found.expectation in INPUTS:
            raise ContractError(f"the computation: {self.computation} changes its input {key[0]}: {name}")
        self.used.add(name)
        if key[0] == "matrix":
            self.used.add((name[1], name[0], name[2]))

    def get_scalar(self, name, *default):
        self._access("scalar", name)
        return super().get_scalar(name, *default)

    def has_scalar(self, name):
        self._access("scalar", name)
        return super().has_scalar(name)

    def axis_frame(self, axis):
        self._access("axis", axis)
        return super().axis_frame(axis)

    def vector_column(self, axis, name):
        self._access("vector", axis, name)
        return super().vector_column(axis, name)

    def has_vector(self, axis, name):
        self._access("vector", axis, name)
        return super().has_vector(axis, name)

    def matrix(self, rows, cols, name, *default):
        self._access("matrix", rows, cols, name)
        return super().matrix(rows, cols, name, *default)

    def _change(self, verb, *key):
        self._access(*key, change=True)
        return getattr(self.base, verb)

    def set_scalar(self, name, value, overwrite=False):
        self._change("set_scalar", "scalar", name)(name, value, overwrite or self.overwrite)

    def add_axis(self, axis, entries, check=True):
        self._change("add_axis", "axis", axis)(axis, entries, check)

    def set_vector(self, axis, name, values, overwrite=False):
        self._change("set_vector", "vector", axis, name)(axis, name, values, overwrite or self.overwrite)

    def set_matrix(self, rows, cols, name, cells, background=None, overwrite=False, relayout=True):
        self._change("set_matrix", "matrix", rows, cols, name)(rows, cols, name, cells, background, overwrite or self.overwrite)

    def delete_scalar(self, name, must_exist=True):
        self._change("delete_scalar", "scalar", name)(name, must_exist)

    def delete_vector(self, axis, name, must_exist=True):
        self._change("delete_vector", "vector", axis, name)(axis, name, must_exist)

    def delete_matrix(self, rows, cols, name, must_exist=True):
        self._change("delete_matrix", "matrix", rows, cols, name)(rows, cols, name, must_exist)


def contractor(computation: str, contract: Contract, ds: Reader, overwrite: bool = False) -> Reader:
    """ds under the contract, or ds itself unless LOOMFRAME_ENFORCE_CONTRACTS says that contracts are enforced."""
    return Contracted(computation, contract, ds, overwrite) if enforced() else ds


def _found(ds: Reader, key):
    """The model type of what a contract's key names, or None."""
    base = ds.base if isinstance(ds, Contracted) else ds
    if not isinstance(key, tuple):
        if not base.has_scalar(key):
            return None
        v = base.get_scalar(key)
        return "Bool" if isinstance(v, bool) else "Int64" if isinstance(v, int) else "Float64" if isinstance(v, float) else "String"
    if any(not base.has_axis(a) for a in key[:-1]):
        return None
    if len(key) == 2:
        frame = base.axis_frame(key[0])
        return model_type(frame.schema[vc(key[1])].dataType) if vc(key[1]) in frame.columns else None
    if len(key) == 3:
        return model_type(base.matrix(*key).df.schema["value"].dataType) if base.has_matrix(*key) else None
    kinds = [_found(base, (key[1], key[2], f"{e}_{key[3]}")) for e in base.axis_entries(key[0])]
    return kinds[0] if kinds and all(kinds) else None


def fits(found: str, wanted: str | None) -> bool:
    """Whether a type is the wanted one, or a narrower number."""
    if wanted is None or found == wanted:
        return True
    if "String" in (found, wanted):
        return False
    return WIDTH.index(found) <= WIDTH.index(wanted)


def _verify(ds: Reader, contract: Contract, output: bool, overwrite: bool) -> None:
    base = ds.base if isinstance(ds, Contracted) else ds
    when = "after" if output else "before"
    found = [(key, e, "axis" if base.has_axis(key) else None) for key, e in contract.axes.items()]
    found += [(key, e, _found(ds, key)) for key, e in contract.data.items()]
    # what is missing hides what is there already, that what is of another type, and that what is not used
    for key, e, kind in found:
        must = e.expectation == RequiredInput or (output and e.expectation in (CreatedOutput, GuaranteedOutput))
        if must and kind is None:
            raise ContractError(f"missing {key} ({e.expectation}) {when} the computation: {contract.name}")
    for key, e, kind in found:
        if not output and e.expectation == CreatedOutput and kind is not None and not overwrite:
            raise ContractError(f"existing {key} ({e.expectation}) before the computation: {contract.name}")
    for key, e, kind in found:
        if kind not in (None, "axis") and not fits(kind, e.type) and (output or e.expectation in INPUTS):
            raise ContractError(f"{key} is {kind}, not {e.type}, {when} the computation: {contract.name}")
    for key, e, _ in found:
        if output and isinstance(ds, Contracted) and e.expectation == RequiredInput and key not in ds.used:
            raise ContractError(f"unused {key} ({e.expectation}) of the computation: {contract.name}")


def verify_input(ds: Reader, contract: Contract | None = None, overwrite: bool = False) -> None:
    _verify(ds, contract or ds.contract, False, overwrite or getattr(ds, "overwrite", False))


def verify_output(ds: Reader, contract: Contract | None = None) -> None:
    _verify(ds, contract or ds.contract, True, True)


def verify_contract(contract: Contract, ds: Reader, output: bool = False) -> None:
    """Checks a data set against a contract without a computation."""
    _verify(ds.base if isinstance(ds, Contracted) else ds, contract, output, True)


def merge_expectations(a: str, b: str) -> str:
    """What two computations, one after the other, expect together."""
    if a == b:
        return a
    pair = {a, b}
    if pair == {RequiredInput, OptionalInput}:
        return RequiredInput
    if a in OUTPUTS and b in INPUTS:
        return GuaranteedOutput if (a, b) == (OptionalOutput, RequiredInput) else a
    if pair <= set(OUTPUTS):
        return CreatedOutput if CreatedOutput in pair and pair != {CreatedOutput, GuaranteedOutput} else GuaranteedOutput
    raise ContractError(f"cannot merge the expectations {a} and {b}")


def _merge(key, a: Expected, b: Expected) -> Expected:
    kind = a.type or b.type
    if a.type and b.type and a.type != b.type:
        if "String" in (a.type, b.type):
            raise ContractError(f"different types of {key}: {a.type} and {b.type}")
        kind = min(a.type, b.type, key=WIDTH.index)
    if a.description and b.description and a.description != b.description:
        raise ContractError(f"different descriptions of {key}")
    return Expected(merge_expectations(a.expectation, b.expectation), kind, a.description or b.description)


def merge_contracts(*contracts: Contract, name: str = "") -> Contract:
    """The contract of computations that run one after the other."""
    axes, data = {}, {}
    for c in contracts:
        for into, part in ((axes, c.axes), (data, c.data)):
            for k, e in part.items():
                into[k] = _merge(k, into[k], e) if k in into else e
    return Contract(name or "+".join(c.name for c in contracts), axes, data, any(c.relaxed for c in contracts))


def contract_description(contract: Contract) -> str:
    lines = [f"contract: {contract.name}" + (" (relaxed)" if contract.relaxed else "")]
    for title, part in (("axes", contract.axes), ("data", contract.data)):
        if part:
            lines.append(f"{title}:")
            lines += [f"  {', '.join(k) if isinstance(k, tuple) else k}: {e.expectation}" + (f" {e.type}" if e.type else "") + (f" - {e.description}" if e.description else "") for k, e in part.items()]
    return "\n".join(lines)


contract_docs = contract_description


def computation(name: str, contract: Contract, *more: Contract) -> Callable:
    """Decorates a function of one data set (or of as many as there are contracts), so that contracts are verified before
    and after it, if they are enforced."""

    def decorate(fn: Callable) -> Callable:
        contracts = [replace(c, name=c.name or name) for c in (contract, *more)]

        @wraps(fn)
        def run(*args, overwrite: bool = False, **kwargs):
            sets = [contractor(name, c, ds, overwrite) for c, ds in zip(contracts, args)]
            for ds in sets:
                if isinstance(ds, Contracted):
                    verify_input(ds)
            out = fn(*sets, *args[len(contracts) :], **kwargs)
            for ds in sets:
                if isinstance(ds, Contracted):
                    verify_output(ds)
            return out

        run.contracts = tuple(contracts)
        return run

    return decorate


def function_contract(fn: Callable, index: int = 0) -> Contract:
    return fn.contracts[index]


def adapter(ds: Reader, fn: Callable, input_axes=None, input_data=None, output_axes=None, output_data=None, capture: str = "memory", empty=None, overwrite: bool = False):
    """Runs fn on a view of ds, and copies a view of what fn made back. Returns what fn returns."""
    from ..dataset import Dataset
    from .chain import chain_writer
    from .copies import copy_all
    from .view import viewer

    made = Dataset(ds.spark, f"{ds.name}.{capture}")
    seen = chain_writer([viewer(ds, None, input_axes, input_data), made])
    out = fn(seen)
    copy_all(ds, viewer(seen, None, output_axes, output_data), empty, overwrite=overwrite, insist=False)
    return out
