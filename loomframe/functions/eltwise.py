"""The element-wise operations, on columns and on the value of cells that are not stored."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import registry
from .columns import SPARK, divided, is_real, logarithm, numeric, strict_cast

#: Operations that look at a whole vector, or at a matrix column by column.
WHOLE = ("Fraction", "Significant")


def checked(name: str, params: dict[str, str]) -> dict[str, float]:
    """The operation's numbers, with its defaults."""
    from ..plans.nodes import number

    out = {k: number(v) for k, v in params.items() if k != "type"}
    if name == "Log":
        out = {"base": math.e, "eps": 0.0} | out
        if out["base"] <= 0 or out["eps"] < 0:
            raise ValueError("Log takes a base over 0 and an eps of 0 or more")
    if name == "Clamp":
        out = {"min": -math.inf, "max": math.inf} | out
        if not out["min"] < out["max"]:
            raise ValueError("Clamp takes a min under its max")
    if name == "Significant":
        if "high" not in out:
            raise ValueError("Significant needs the parameter high")
        out = {"low": out["high"]} | out
        if not 0 < out["high"] or not 0 <= out["low"] <= out["high"]:
            raise ValueError("Significant takes 0 <= low <= high and a high over 0")
    if name == "Convert" and "type" not in params:
        raise ValueError("Convert needs the parameter type")
    return out


def applied(name: str, params: dict[str, str], c: Column, kind: T.DataType, over: Column | None = None) -> Column:
    """The operation on a column. over: for operations on a whole, the aggregate of it (sum, or largest magnitude)."""
    fn = registry.own("eltwise", name)
    n = checked(name, params) if fn is None else {}
    if fn is not None:
        from ..plans.nodes import number

        out = fn(c, **{k: number(v) for k, v in params.items() if k != "type"})
        return out.cast(SPARK[params["type"]]) if "type" in params else out
    x = numeric(c, kind)
    to = params.get("type")
    double = T.DoubleType()
    if name == "Convert":
        return strict_cast(c, kind, to)
    if name == "Abs":
        return strict_cast(F.abs(x), kind if not isinstance(kind, T.BooleanType) else T.LongType(), to) if to else F.abs(x)
    if name == "Round":
        return strict_cast(F.rint(x.cast("double")), double, to or "Int64")
    if name == "Clamp":
        low, high = n["min"], n["max"]
        d = x.cast("double")
        out = F.when(F.isnan(d), d).otherwise(F.least(F.greatest(d, F.lit(low)), F.lit(high)))
        whole = not is_real(kind) and all(math.isinf(v) or float(v).is_integer() for v in (low, high))
        out = out.cast(kind) if whole and not isinstance(kind, T.BooleanType) else out
        return strict_cast(out, double, to) if to else out
    if name == "Exp":
        out = F.exp(x.cast("double"))
    elif name == "Sqrt":
        out = F.sqrt(x.cast("double"))
    elif name == "Log":
        out = logarithm(x, n["base"], n["eps"])
    elif name == "Fraction":
        out = F.when(over == 0, F.lit(0.0)).otherwise(divided(x, over))
    elif name == "Significant":
        if not is_real(kind) and not all(float(n[k]).is_integer() for k in ("high", "low")):
            raise ValueError("InexactError: Significant of whole numbers takes whole parameters")
        return F.when(F.isnan(x.cast("double")), x).when((over < n["high"]) | (F.abs(x) < n["low"]), F.lit(0).cast(kind if not isinstance(kind, T.BooleanType) else "bigint")).otherwise(x)
    else:
        raise ValueError(f"unknown element-wise operation {name}")
    return strict_cast(out, double, to) if to else out


def of_background(name: str, params: dict[str, str], b: float):
    """The operation's value where cells hold b without being stored; None if that can't be said without the column."""
    if registry.own("eltwise", name) is not None:
        return None
    n = checked(name, params)
    if name in WHOLE:
        return 0.0 if b == 0 else None
    if name == "Abs":
        return abs(b)
    if name == "Convert":
        return b
    if name == "Round":
        return float(round(b))
    if name == "Clamp":
        return min(max(b, n["min"]), n["max"])
    if name == "Exp":
        return math.exp(b)
    if name == "Sqrt":
        return math.sqrt(b) if b >= 0 else math.nan
    if b + n["eps"] < 0:
        raise ValueError("DomainError: logarithm of a negative number")
    return math.log(b + n["eps"]) / math.log(n["base"]) if b + n["eps"] else -math.inf
