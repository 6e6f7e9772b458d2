"""Names of groups: parts of a group that are hashed apart, many tasks, large groups."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from loomframe.dataset import memory_dataset
from loomframe.functions import fnv
from loomframe.operators.reshape import group_names


def plain(entries, prefix="G"):
    h = 0x811C9DC5
    for byte in b"\x01".join(sorted({e.encode() for e in entries if e is not None})):
        h = (h ^ byte) * 0x01000193 % 2**32
    return f"{prefix}{h:08x}"


def grouped(spark, frame):
    ds = memory_dataset(spark, "grouped")
    ds.axes["cell"] = frame.select("entry", F.monotonically_increasing_id().alias("pos"), F.col("group").alias("v_group"))
    return ds


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4095, 4097, 10_000])
def test_parts_of_a_text_give_its_hash(n):
    r = random.Random(n)
    text, more = r.randbytes(n), r.randbytes(100)
    for state in (fnv.OFFSET, fnv.START, 0, 2**32 - 1):
        assert fnv.applied(fnv.part_of(text), state) == fnv.hashed(text, state)
        assert fnv.applied(fnv.after(fnv.part_of(text), fnv.part_of(more)), state) == fnv.hashed(text + more, state)
    assert fnv.hashed(b"a\x01b") == fnv.hashed(b"\x01a\x01b", fnv.START) and fnv.hashed(b"a") == 0xE40C292C


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_groups_cut_by_tasks_and_batches(spark, batch, kind):
    r = random.Random(1)
    sizes = {1: 400, 2: 1, 3: 37, **{g: r.randrange(1, 4) for g in range(4, 120)}, 500: 300}
    members = [(f"{r.choice(['', 'é', '字', 'x y', '~'])}{r.randrange(10**r.randrange(1, 9))}", g) for g, n in sizes.items() for _ in range(n)]
    members += members[:50] + [(None, 1), (None, 600), ("zero", 0), ("none", None), ("", 700), ("long" * 9000, 2)]
    r.shuffle(members)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": batch, "spark.sql.shuffle.partitions": 13, "spark.sql.adaptive.coalescePartitions.enabled": False}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frame = spark.createDataFrame(members, "entry string, group int").select("entry", F.col("group").cast(kind))
        rows = group_names(grouped(spark, frame), "cell", "group", "G").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    want = {g: plain([e for e, h in members if h == g]) for g in {g for _, g in members if g}}
    assert len(rows) == len(want) and {int(float(x["group"])): x["name"] for x in rows} == want


def test_one_group_that_the_planner_knows(spark):
    """Of a constant, Catalyst drops the group from what it deals by."""
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, False)
    try:
        ds = grouped(spark, spark.range(3000).select(F.col("id").cast("string").alias("entry"), F.lit(7).alias("group")))
        rows = group_names(ds, "cell", "group", "G").collect()
    finally:
        spark.conf.unset(coalesce)
    assert [tuple(x) for x in rows] == [(7, plain(map(str, range(3000))))]


def test_a_large_group_takes_time_in_proportion(spark):
    """Time grew with the square of a group."""
    n = 200_000
    ds = grouped(spark, spark.range(n).select(F.concat(F.lit("cell"), "id").alias("entry"), (F.col("id") % 2 + 1).alias("group")))
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = {x["group"]: x["name"] for x in group_names(ds, "cell", "group", "G").collect()}
    finally:
        stop.cancel()
    assert got == {g: plain([f"cell{i}" for i in range(g - 1, n, 2)]) for g in (1, 2)}
