"""Star-schema tables as a data set of axes, vectors and matrices."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset, Lazy, Matrix, filled, vc


def axis_of(df: DataFrame, key: str, vectors: dict[str, object], order: str | None = None) -> DataFrame:
    """An axis's DataFrame of a table: entries are the key as text; pos is the key's order, or that of another column.

    Keys of whole numbers are their own pos, which needs no pass over the table; pos must only be distinct and ordered.
    """
    pos = F.col(order or key)
    if not dict(df.dtypes)[order or key] in ("int", "bigint", "smallint", "tinyint"):
        raise TypeError("an axis's order is a column of whole numbers")
    return df.select(F.col(key).cast("string").alias("entry"), pos.cast("bigint").alias("pos"), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in vectors.items()))


def from_tables(spark: SparkSession, sf_dir: str) -> Dataset:
    """The supplied tables as one data set; no table is touched, not even for its schema, until a query needs it.

    Axes region, nation, customer, supplier, part, order, user, event_type, document, vec; matrices quantity (part x
    supplier), spend (customer x priority), value (user x event_type), trade (nation x nation), embedding (vec x dim).
    """
    t = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    text = lambda c: F.col(c).cast("string")
    nations = lambda: t("nation").select("n_nationkey", F.col("n_name").alias("nation"))
    priorities = lambda: t("orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("pos"))
    kinds = lambda: t("events").groupBy("event_type").agg(F.min("event_id").alias("pos"))  # noqa: E731  a row a kind
    sums = lambda table, row, col, value: lambda: Matrix(t(table).groupBy(text(row).alias("row"), text(col).alias("col")).agg(F.sum(value).alias("value")), 0)
    ds = Dataset(spark, "tables")
    ds.set_scalar("organization", "star")
    ds.set_scalar("version", 1)
    ds.axes.update({
        "region": lambda: named(axis_of(t("region"), "r_name", {}, "r_regionkey")),
        "nation": lambda: named(axis_of(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", {"region": "r_name"}, "n_nationkey")),
        "customer": lambda: named(axis_of(t("customer").join(nations(), F.col("c_nationkey") == F.col("n_nationkey")), "c_custkey", {"nation": "nation", "acctbal": "c_acctbal", "segment": "c_mktsegment"})),
        "supplier": lambda: named(axis_of(t("supplier").join(nations(), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", {"nation": "nation", "acctbal": "s_acctbal"})),
        "part": lambda: named(axis_of(t("part"), "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"})),
        "order": lambda: named(axis_of(t("orders"), "o_orderkey", {"customer": text("o_custkey"), "status": "o_orderstatus", "priority": "o_orderpriority", "totalprice": "o_totalprice"})),
        "user": lambda: named(axis_of(t("events").select("user_id").distinct(), "user_id", {})),
        "event_type": lambda: named(axis_of(kinds(), "event_type", {}, "pos")),
        "priority": lambda: named(axis_of(priorities(), "o_orderpriority", {}, "pos")),
        "document": lambda: named(axis_of(t("documents"), "doc_id", {"lang": "lang", "source": "source", "n_chars": "n_chars"})),
        "vec": lambda: named(axis_of(t("embeddings"), "vec_id", {"label": "label"})),
    })
    ds.matrices["part", "supplier"] = Lazy(quantity=sums("lineitem", "l_partkey", "l_suppkey", "l_quantity"))
    ds.matrices["user", "event_type"] = Lazy(value=sums("events", "user_id", "event_type", "value"))
    ds.matrices["customer", "priority"] = Lazy(spend=sums("orders", "o_custkey", "o_orderpriority", "o_totalprice"))
    return ds


def named(frame: DataFrame) -> DataFrame:
    """An axis's DataFrame with its vectors' columns named as a data set has them; missing strings are empty."""
    return frame.select("entry", "pos", *(filled(frame, c).alias(vc(c)) for c in frame.columns if c not in ("entry", "pos")))


def with_trade(ds: Dataset, spark: SparkSession, sf_dir: str) -> Dataset:
    """ds with trade: extended prices from each customer's nation to each supplier's, a square matrix."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = t("nation").select("n_nationkey", "n_name")
    buyer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("row"))
    seller = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("col"))
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    cells = line.join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    ds.set_matrix("nation", "nation", "trade", cells.groupBy("row", "col").agg(F.sum("l_extendedprice").alias("value")), 0)
    return ds


def with_embedding(ds: Dataset, spark: SparkSession, sf_dir: str, dims: int | None = None) -> Dataset:
    """ds with the axis dim and the dense matrix embedding (vec x dim)."""
    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("row"), F.posexplode("embedding").alias("d", "value"))
    dims = dims if dims is not None else spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max(F.size("embedding"))).first()[0] or 0
    ds.add_axis("dim", [str(i) for i in range(dims)])
    ds.set_matrix("vec", "dim", "embedding", cells.select("row", F.col("d").cast("string").alias("col"), "value"))
    return ds
