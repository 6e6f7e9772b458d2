"""The reductions, over stored values and over a number of equal values that are not stored."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import registry
from .columns import divided, is_real, is_string, numeric, strict_cast

SAMPLED = ("Median", "Quantile")


@dataclass(frozen=True)
class Reduction:
    """An operation with its checked parameters."""

    name: str
    type: str | None = None
    eps: float = 0.0
    p: float = 0.5
    fn: object = None
    options: tuple = ()

    @classmethod
    def of(cls, name: str, params: dict[str, str]) -> Reduction:
        from ..plans.nodes import number

        fn = registry.own("reduction", name)
        if fn is not None:
            options = {k: number(v) for k, v in params.items() if k != "type"}
            return cls(name, params.get("type"), fn=fn, options=tuple(options.items()))
        if name == "Quantile" and "p" not in params:
            raise ValueError("Quantile needs the parameter p")
        p, eps = number(params.get("p", "0.5")), number(params.get("eps", "0"))
        if not 0 <= p <= 1:
            raise ValueError(f"Quantile takes a p from 0 to 1, not {p}")
        if eps < 0:
            raise ValueError(f"{name} takes an eps of 0 or more, not {eps}")
        return cls(name, params.get("type"), eps, p)

    @property
    def in_order(self) -> bool:
        return self.name == "Mode"

    def reduced(self, df: DataFrame, keys: list[str], value: str = "value", pos: str = "pos", total: Column | None = None, background=None, gap: DataFrame | None = None) -> DataFrame:
        """keys and `reduced` for each group of df's rows.

        total: how many cells each group has (the same in all rows of a group), of which those that are not rows of df
        hold background; a group without any stored row is the caller's to add. pos orders a group's values for Mode
        (the first seen wins a tie): with cells that are not stored, it is the place from 0 among the group's cells, and
        without keys gap is one row with __gap, the first place that is not stored.
        """
        kind = df.schema[value].dataType
        v = F.col(value)
        if is_string(kind) and self.name not in registry.STRINGS and self.fn is None:
            raise TypeError(f"unsupported input type: String for {self.name}")
        if total is not None:
            df = df.withColumn("__total", total.cast("bigint"))
        if self.name == "Mode":
            return self._mode(df, keys, kind, value, pos, background, gap)
        if self.fn is not None or self.name in SAMPLED:
            return self._sampled(df, keys, kind, value, total, background)
        x = v if is_string(kind) else numeric(v, kind)
        d = x.cast("double")
        nan = F.max(F.isnan(v)) if is_real(kind) else F.lit(False)
        b = None if background is None else float(background)
        some = F.max("__total") - F.count(F.lit(1)) if total is not None else F.lit(0).cast("bigint")
        n = F.count(F.lit(1)) + some
        fill = (some * F.lit(b)) if b is not None else F.lit(0.0)
        if self.name == "Sum":
            whole = not is_real(kind) and (b is None or b.is_integer())
            out = F.sum(x) + (some * F.lit(int(b)) if whole and b is not None else (F.lit(0) if whole else fill))
        elif self.name == "Count":
            out = n
        elif self.name == "Mean":
            out = (F.sum(d) + fill) / n
        elif self.name in ("Min", "Max"):
            best, pick = (F.min, F.least) if self.name == "Min" else (F.max, F.greatest)
            out = best(v)
            if b is not None:
                out = F.when(some > 0, pick(best(v), F.lit(b).cast(kind) if not isinstance(kind, T.BooleanType) else F.lit(bool(b)))).otherwise(best(v))
            if is_real(kind):
                out = F.when(nan, F.lit(math.nan)).otherwise(out)
        elif self.name in ("Var", "Std", "VarN", "StdN"):
            mean = (F.sum(d) + fill) / n
            stored = F.count(F.lit(1))
            apart = F.var_pop(d) * stored
            if b is not None:  # the spread between the stored values' mean and the background
                apart = apart + stored * some / n.cast("double") * F.pow(F.avg(d) - F.lit(b), F.lit(2))
            var = apart / n
            spread = F.sqrt(var) if self.name.startswith("Std") else var
            out = divided(spread, mean + F.lit(self.eps)) if self.name.endswith("N") else spread
        elif self.name == "GeoMean":
            shifted = d + F.lit(self.eps)
            logs = F.when(shifted < 0, F.raise_error(F.lit("DomainError: geometric mean of a negative number")).cast("double")).when(shifted == 0, F.lit(-math.inf)).when(F.isnan(shifted), shifted).otherwise(F.ln(shifted))
            total = F.sum(logs)
            if b is not None:
                at = b + self.eps
                if at < 0:
                    raise ValueError("DomainError: geometric mean of a negative number")
                total = total + F.when(some > 0, some * F.lit(-math.inf if at == 0 else math.log(at))).otherwise(F.lit(0.0))
            out = F.exp(total / n) - F.lit(self.eps)
        else:
            raise ValueError(f"unknown reduction {self.name}")
        got = df.groupBy(*keys).agg(out.alias("reduced"), n.alias("__n")) if keys else df.agg(out.alias("reduced"), n.alias("__n"))
        if self.name not in ("Min", "Max", "Count", "Sum") or self.type:
            got = got.withColumn("reduced", self._typed(F.col("reduced"), got.schema["reduced"].dataType))
        return got

    def _typed(self, c: Column, of: T.DataType) -> Column:
        return strict_cast(c, of, self.type) if self.type else c

    def _sampled(self, df, keys, kind, value, total, background):
        """Operations that need the values themselves: those not stored count as one row that stands for many."""
        rows = df.select(*keys, F.col(value), F.lit(1).cast("bigint").alias("__times"))
        if total is not None:
            fill = (df.groupBy(*keys) if keys else df.groupBy()).agg((F.max("__total") - F.count(F.lit(1))).alias("__times"))
            rows = rows.unionByName(fill.where("__times > 0").select(*keys, F.lit(background).cast(kind).alias(value), "__times"))
        v = F.col(value)
        if self.fn is not None:
            rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times")))) if total is not None else rows
            out = self.fn(v, **dict(self.options))
        else:
            d = numeric(v, kind).cast("double")
            out = F.percentile(d, F.lit(self.p), F.col("__times"))
            if is_real(kind):
                nan = F.max(F.isnan(v))
                bad = F.lit(math.nan) if self.name == "Median" else F.raise_error(F.lit("Quantile of NaN")).cast("double")
                out = F.when(nan, bad).otherwise(out)
        n = F.sum("__times").alias("__n")
        got = rows.groupBy(*keys).agg(out.alias("reduced"), n) if keys else rows.agg(out.alias("reduced"), n)
        return got.withColumn("reduced", self._typed(F.col("reduced"), got.schema["reduced"].dataType))

    def _mode(self, df, keys, kind, value, pos, background, gap):
        """The most frequent value; of equals the one first seen. Values are counted before groups meet, unless cells that are
        not stored may win a tie: their first place follows the stored cells that leave no gap before them."""
        v, at = F.col(value), F.col(pos) if pos in df.columns else F.lit(0)
        if "__total" not in df.columns:
            counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), F.min(at).alias("__p"))
            best, n = F.max_by(v, F.struct(F.col("__c"), -F.col("__p"))).alias("reduced"), F.sum("__c").alias("__n")
            return counts.groupBy(*keys).agg(best, n) if keys else counts.agg(best, n)
        df = df.withColumn("__b", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1 if keys else F.lit(-1))
        counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), F.min(at).alias("__p"), F.sum((at == F.col("__b")).cast("bigint")).alias("__f"), F.max("__total").alias("__total"))
        bare = v.eqNullSafe(F.lit(background).cast(kind))
        got = counts.groupBy(*keys).agg(
            F.max(F.when(~bare, F.struct("__c", (-F.col("__p")).alias("__p"), v.alias("v")))).alias("__best"),
            F.coalesce(F.max(F.when(bare, F.col("__c"))), F.lit(0)).alias("__bc"),
            F.min(F.when(bare, F.col("__p"))).alias("__bp"),
            F.sum("__f").alias("__gap"),
            F.sum("__c").alias("__c"),
            F.max("__total").alias("__n"),
        )
        if gap is not None:
            got = got.drop("__gap").crossJoin(F.broadcast(gap))  # one row on each side
        times = F.col("__n") - F.col("__c") + F.col("__bc")
        first = F.when(F.col("__n") > F.col("__c"), F.least("__gap", "__bp")).otherwise(F.col("__bp"))
        best = F.col("__best")
        wins = best.isNull() | (times > best["__c"]) | ((times == best["__c"]) & (first < -best["__p"]))
        return got.select(*keys, F.when(wins, F.lit(background).cast(kind)).otherwise(best["v"]).alias("reduced"), "__n")

    def of_constant(self, background, n: int):
        """The reduction of n equal numbers, for groups without any stored value."""
        b = float(background)
        if self.name in ("Mean", "Min", "Max", "Median", "Quantile"):
            return b
        if self.name == "Mode":
            return background
        if self.name == "Sum":
            return b * n
        if self.name == "Count":
            return n
        if self.name in ("Var", "Std"):
            return 0.0
        if self.name in ("VarN", "StdN"):
            return 0.0 if b + self.eps else math.nan
        if self.name == "GeoMean":
            return b
        return None
