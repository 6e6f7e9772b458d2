"""Small data sets to try queries on, made by rule: cells with genes and donors, their metacells with types, and both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset, Reader, memory_dataset
from ..operators.chain import chain_writer

# How many entries the axes have, and the types' colors.
CELLS, GENES, DONORS, EXPERIMENTS, METACELLS = 856, 683, 95, 23, 7
COLORS = {"memory-B": "steelblue", "MEBEMP-E": "#eebb6e", "MEBEMP-L": "plum", "MPP": "gold"}


def entries(spark: SparkSession, n: int, prefix: str, **vectors: Column) -> DataFrame:
    """An axis of n numbered entries; vectors are columns of their number, id."""
    return spark.range(n).select(F.format_string(f"{prefix}%03d", "id").alias("entry"), F.col("id").alias("pos"), *(c.alias(k) for k, c in vectors.items()))


def numbered_name(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}%03d", number)


def cells_of(spark: SparkSession, rows: tuple[str, int], cols: tuple[str, int], value: Column, kept: Column) -> DataFrame:
    """Cells of all pairs of numbered entries, i and j, that are kept; the axes are of a fixed, small size."""
    i, j = spark.range(rows[1]).select(F.col("id").alias("i")), spark.range(cols[1]).select(F.col("id").alias("j"))
    return i.crossJoin(j).where(kept).select(numbered_name(rows[0], F.col("i")).alias("row"), numbered_name(cols[0], F.col("j")).alias("col"), value.alias("value"))


def example_cells(spark: SparkSession, name: str = "cells!") -> Dataset:
    """Cells, genes, donors and experiments, with the sparse matrix UMIs of cells by genes."""
    i = F.col("id")
    ds = memory_dataset(spark, name)
    ds.set_scalar("organism", "human")
    ds.set_scalar("reference", "test")
    ds.add_axis("cell", entries(spark, CELLS, "C", donor=numbered_name("N", i * 7 % DONORS), experiment=numbered_name("X", i * 5 % EXPERIMENTS)), check=False)
    ds.add_axis("gene", entries(spark, GENES, "G", is_lateral=i % 3 == 0), check=False)
    ds.add_axis("donor", entries(spark, DONORS, "N", age=(20 + i * 11 % 60).cast("int"), sex=F.when(i % 2 == 0, "female").otherwise("male")), check=False)
    ds.add_axis("experiment", entries(spark, EXPERIMENTS, "X"), check=False)
    k = (F.col("i") * 31 + F.col("j") * 17) % 23
    ds.set_matrix("cell", "gene", "UMIs", cells_of(spark, ("C", CELLS), ("G", GENES), (k + 1).cast("int"), k < 4), 0)
    return ds


def example_metacells(spark: SparkSession, name: str = "metacells!") -> Dataset:
    """The same cells and genes, with metacells, their types, the genes' fractions in them and edges between them."""
    i = F.col("id")
    ds = memory_dataset(spark, name)
    ds.add_axis("cell", entries(spark, CELLS, "C", metacell=numbered_name("M", i % METACELLS)), check=False)
    ds.add_axis("gene", entries(spark, GENES, "G", is_marker=i % 5 == 0), check=False)
    types = list(COLORS)
    ds.add_axis("metacell", entries(spark, METACELLS, "M", type=F.element_at(F.array(*map(F.lit, types)), (i % len(types) + 1).cast("int"))), check=False)
    ds.add_axis("type", types)
    ds.set_vector("type", "color", list(COLORS.values()))
    ds.set_matrix("gene", "metacell", "fraction", cells_of(spark, ("G", GENES), ("M", METACELLS), ((F.col("i") + F.col("j")) % 10 / 10000).cast("float"), F.lit(True)))
    ds.set_matrix("metacell", "metacell", "edge_weight", cells_of(spark, ("M", METACELLS), ("M", METACELLS), (1 / (1 + F.abs(F.col("i") - F.col("j")))).cast("float"), F.lit(True)))
    return ds


def example_chain(spark: SparkSession, name: str = "chain!") -> Reader:
    """The metacells on top of the cells."""
    return chain_writer([example_cells(spark), example_metacells(spark)], name)


__all__ = ["example_cells", "example_chain", "example_metacells"]
