"""Rules on columns where Spark's own differ from the model's: truth, comparison with NaN, strict casts, logarithms."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The model's element types, Spark's, and the ranges of the whole ones.
SPARK = {"Bool": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Float32": "float", "Float64": "double", "String": "string"}
RANGES = {f"{u}Int{b}": ((0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1)) for u in ("", "U") for b in (8, 16, 32, 64)}


def model_type(kind: T.DataType) -> str:
    names = {"boolean": "Bool", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "String"}
    text = kind.simpleString()
    if text in names:
        return names[text]
    if text.startswith("decimal"):
        return "UInt64"
    raise TypeError(f"unsupported element type: {text}")


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_real(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def failing(value: Column, bad: Column, message: str) -> Column:
    """value, or an error where bad holds. It only fails where it is used; see guarded() for checks that must run."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message))).otherwise(value)


def guarded(df, bad: Column, message: str):
    """df; evaluating it fails if bad holds for a row. A filter, as a projected check would be pruned when unused."""
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def numeric(c: Column, kind: T.DataType) -> Column:
    """Numbers for arithmetic: truth values count as 0 and 1; strings are refused."""
    if is_string(kind):
        raise TypeError("unsupported input type: String")
    return c.cast("bigint") if isinstance(kind, T.BooleanType) else c


def truthy(c: Column, kind: T.DataType) -> Column:
    """Strings that are not empty, numbers that are not 0; NaN and missing are false."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if is_string(kind):
        return F.coalesce(c != "", F.lit(False))
    out = c != 0
    return F.coalesce(out & ~F.isnan(c) if is_real(kind) else out, F.lit(False))


def compared(kind: str, c: Column, of: T.DataType, text: str) -> Column:
    """The comparison of a column with a query's value; NaN equals nothing and is unordered (null)."""
    if kind in ("IsMatch", "IsNotMatch"):
        if not is_string(of):
            raise TypeError("patterns match strings only")
        if re.search(r"\\K|\(\?\(|\(\?R\)|\(\?&|\(\*", text):
            raise ValueError(f"pattern not supported: {text!r}")
        return c.rlike(text) if kind == "IsMatch" else ~c.rlike(text)
    if is_string(of):
        value = F.lit(text)
    elif isinstance(of, T.BooleanType):
        words = {"0": False, "1": True, "false": False, "true": True}
        if text.lower() not in words:
            raise ValueError(f"not a truth value: {text!r}")
        value = F.lit(words[text.lower()])
    else:
        from ..plans.nodes import number

        x = number(text)
        value = F.lit(int(x)) if x.is_integer() and not is_real(of) and abs(x) < 2**63 else F.lit(x)
        nan = F.isnan(c) if is_real(of) else F.lit(False)
        if math.isnan(x):
            nan = F.lit(True)
        if kind == "IsEqual":
            return (c == value) & ~nan
        if kind == "IsNotEqual":
            return (c != value) | nan
        out = {"IsLess": c < value, "IsLessEqual": c <= value, "IsGreater": c > value, "IsGreaterEqual": c >= value}[kind]
        return F.when(~nan, out)
    return {"IsLess": c < value, "IsLessEqual": c <= value, "IsEqual": c == value, "IsNotEqual": c != value, "IsGreater": c > value, "IsGreaterEqual": c >= value}[kind]


def strict_cast(c: Column, of: T.DataType, to: str) -> Column:
    """A cast that fails where it would change the value: fractions, non-finite or out-of-range numbers to whole types,
    other numbers than 0 and 1 to Bool."""
    if is_string(of):
        if to == "String":
            return c
        raise TypeError("unsupported input type: String")
    if to == "String":
        return c.cast("string")
    if isinstance(of, T.BooleanType):
        return c.cast(SPARK[to]) if to == "Bool" else c.cast("int").cast(SPARK[to])
    if to == "Bool":
        return failing(c == 1, ~c.isin(0, 1), "InexactError: a number other than 0 and 1 to Bool")
    if to in RANGES:
        low, high = RANGES[to]
        bad = (c < F.lit(float(low))) | (c >= F.lit(float(high) + 1))
        if is_real(of):
            bad = bad | F.isnan(c) | (F.abs(c) == float("inf")) | (c != F.rint(c))
        return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"InexactError: a number to {to}")).cast(SPARK[to])).otherwise(c.try_cast(SPARK[to]))
    return c.cast(SPARK[to])


def logarithm(c: Column, base: float = math.e, eps: float = 0.0) -> Column:
    """log(c + eps) to the base; minus infinity at 0, an error below."""
    if base <= 0 or eps < 0:
        raise ValueError("Log takes a base over 0 and an eps of 0 or more")
    x = c.cast("double") + F.lit(float(eps))
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.raise_error(F.lit("DomainError: logarithm of a negative number")).cast("double")).when(F.isnan(x), x).otherwise(F.ln(x) / F.lit(math.log(base)))


def divided(a: Column, b: Column) -> Column:
    """a / b by the rules of floating-point numbers."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))
