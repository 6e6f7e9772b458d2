"""The largest values of each matrix column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import Reader


def top_k_per_col(ds: Reader, rows: str, cols: str, name: str, k: int, use_abs: bool = False) -> DataFrame:
    """col, rank (1..k), row_index (1-based), entry, value: the k largest stored values of each column that are not NaN,
    ties by row; columns with fewer have null rows to k."""
    m = ds.matrix(rows, cols, name)
    size = F.abs("value") if use_abs else F.col("value")
    cells = m.df.where(~F.isnan(F.col("value").cast("double"))).join(ds.places(rows).withColumnRenamed("entry", "row"), "row")
    rank = F.row_number().over(Window.partitionBy("col").orderBy(size.desc(), "__place"))
    best = cells.withColumn("rank", rank).where(F.col("rank") <= k)
    slots = ds.axis_frame(cols).select(F.col("entry").alias("col"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(best, ["col", "rank"], "left").select("col", "rank", (F.col("__place") + 1).alias("row_index"), F.col("row").alias("entry"), "value")
