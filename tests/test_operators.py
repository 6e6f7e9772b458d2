"""Data sets, chains, views, copies, concatenation, reshaping, contracts and storage."""

import pytest
from pyspark.sql import functions as F

from loomframe.dataset import memory_dataset, read_only
from loomframe.operators import contracts as c
from loomframe.operators.chain import chain_reader, chain_writer
from loomframe.operators.concat import CollectAxis, concatenate
from loomframe.operators.copies import copy_all, copy_vector, empty_data
from loomframe.operators.reshape import collect_group_members, compact_groups, reconstruct_axis, reorder_axes, reset_reorder_axes
from loomframe.operators.topk import top_k_per_col
from loomframe.operators.view import VIEW_ALL_AXES, viewer
from loomframe.sources.store import load, open_dataset, save
from loomframe.tidy import UnsupportedOperationError


def small(spark, name="small", entries="ABC", ages=(10, 50, 70)):
    d = memory_dataset(spark, name)
    d.add_axis("cell", list(entries))
    d.set_vector("cell", "age", list(ages))
    return d


def test_writing_and_reading(spark):
    d = small(spark)
    with pytest.raises(KeyError, match="existing"):
        d.set_vector("cell", "age", 1)
    with pytest.raises(ValueError):
        d.add_axis("bad", ["a", "a"])
    with pytest.raises(ValueError):
        d.set_scalar("a/b", 1)
    assert d.axis_indices("cell", ["C", "", "Z"], allow_empty=True, allow_missing=True) == [3, 0, 0]
    assert d.axis_dict("cell") == {"A": 1, "B": 2, "C": 3}
    d.set_vector("cell", "age", F.col("v_age") + 1, overwrite=True)
    assert d["@ cell : age"].collect() == {"A": 11, "B": 51, "C": 71}
    assert d.version("vector", "cell", "age") == 2 and "cell.age: Int64" in d.description()
    assert not hasattr(read_only(d), "set_scalar")
    d.delete_axis("cell")
    assert d.axes_set() == []


def test_chains(spark):
    a, b = small(spark, "a"), memory_dataset(spark, "b")
    both = chain_writer([a, b])
    both.set_vector("cell", "age", [1, 2, 3], True)
    both.set_vector("cell", "kind", list("xyx"))
    assert both["@ cell [ kind = x ] : age"].collect() == {"A": 1, "C": 3} and a["@ cell : age >> Sum"].collect() == 130
    with pytest.raises(KeyError, match="earlier"):
        both.delete_vector("cell", "age")
    with pytest.raises(ValueError, match="different entries"):
        chain_reader([a, small(spark, "c", "ABD")])


def test_views(spark):
    d = small(spark)
    v = viewer(d, axes={"old": "@ cell [ age > 20 ]"}, data={("old", "years"): ": age % Convert type Float64", ("old", "rank"): ": index"})
    assert v["@ old : years"].collect() == {"B": 50.0, "C": 70.0} and v.vectors_set("old") == ["rank", "years"]
    assert viewer(d, axes={**VIEW_ALL_AXES, "cell": None}).axes_set() == []


def test_copies_and_concatenation(spark):
    a, b = small(spark, "A", ["c1", "c2"], [10, 20]), small(spark, "B", ["c1", "c3"], [30, 40])
    for d, n in ((a, 1), (b, 2)):
        d.set_scalar("n", n)
    to = memory_dataset(spark)
    concatenate(to, "cell", [a, b], prefix=True, merge={"*": CollectAxis})
    assert to["@ cell : age"].collect() == {"A.c1": 10, "A.c2": 20, "B.c1": 30, "B.c3": 40}
    assert to["@ cell : dataset"].collect() == {"A.c1": "A", "A.c2": "A", "B.c1": "B", "B.c3": "B"}
    assert to["@ dataset : n"].collect() == {"A": 1, "B": 2}
    with pytest.raises(ValueError, match="repeated"):
        concatenate(memory_dataset(spark), "cell", [a, b])
    more = memory_dataset(spark)
    more.add_axis("cell", ["c1", "c2", "c9"])
    with pytest.raises(ValueError, match="empty value"):
        copy_vector(more, a, "cell", "age")
    copy_all(more, a, empty_data({("cell", "age"): -1}))
    assert more["@ cell : age"].collect() == {"c1": 10, "c2": 20, "c9": -1}


def test_reshaping(spark):
    d = memory_dataset(spark)
    d.add_axis("cell", list("ABCDE"))
    d.set_vector("cell", "id", [5, 10, 5, 0, 10])
    assert [r["group"] for r in compact_groups(d, "cell", "id").orderBy("pos").collect()] == [1, 2, 1, 0, 2]
    assert {r["group"]: r["members"] for r in collect_group_members(d, "cell", "id").collect()} == {5: [1, 3], 10: [2, 5]}
    d.set_vector("cell", "donor", ["dA", "dB", "dA", "", "dB"])
    d.set_vector("cell", "donor_age", [30, 40, 30, 7, 40])
    assert reconstruct_axis(d, "cell", "donor", skipped_properties=["id"]) == {"donor_age": 7}
    assert d["@ donor : donor_age"].collect() == {"dA": 30, "dB": 40} and d.vectors_set("cell") == ["donor", "id"]
    reorder_axes(d, cell=[5, 4, 3, 2, 1])
    assert d["@ cell"].collect() == list("EDCBA")
    reset_reorder_axes(d)
    assert d["@ cell"].collect() == list("ABCDE")


def test_top_k(spark):
    d = memory_dataset(spark)
    d.add_axis("r", ["r1", "r2", "r3", "r4"])
    d.add_axis("c", ["c1", "c2", "c3"])
    d.set_matrix("r", "c", "m", [[1.0, 2, 3], [10, 20, 30], [100, 50, 5], [0, 40, 25]])
    got = {(x["col"], x["rank"]): (x["row_index"], x["value"]) for x in top_k_per_col(d, "r", "c", "m", 2).collect()}
    assert got == {("c1", 1): (3, 100.0), ("c1", 2): (2, 10.0), ("c2", 1): (3, 50.0), ("c2", 2): (4, 40.0), ("c3", 1): (2, 30.0), ("c3", 2): (4, 25.0)}
    assert sum(r["entry"] is None for r in top_k_per_col(d, "r", "c", "m", 5).collect()) == 3


def test_tidy(spark):
    d = small(spark)
    d.set_vector("cell", "kind", list("xyx"))
    t = d.tbl("cell")
    assert t.filter(F.col("age") > 20).collect()["name"].tolist() == ["B", "C"]
    assert t.arrange(F.desc("age")).pull("name") == ["C", "B", "A"]
    assert {r["kind"]: r["n"] for r in t.count("kind").collect()} == {"x": 2, "y": 1}
    assert t.slice_max("age", 1, by="kind").collect()["name"].tolist() == ["B", "C"]
    # orders last, groups count
    by_age = t.arrange(F.desc("age"))
    assert by_age.mutate(age=F.lit(0)).select("kind").pull("name") == ["C", "B", "A"] and by_age.slice_tail(1).pull("name") == ["A"] and by_age.slice_head(1).pull("name") == ["C"]
    assert by_age.arrange("kind").pull("name") == ["C", "A", "B"] and by_age.filter(F.col("age") < 60).pull("name") == ["B", "A"]
    assert t.filter(lambda over: F.col("age") > over(F.mean("age")), by="kind").pull("name") == ["C"] and t.filter(lambda over: F.col("age") > over(F.mean("age"))).pull("name") == ["B", "C"]
    assert t.group_by("kind").slice(2).pull("name") == ["C"] and t.slice(1, 3).pull("name") == ["A", "C"] and t.arrange(F.desc("age")).slice(1, by="kind").pull("name") == ["C", "B"]
    assert t.mutate(by="kind", top=lambda over: over(F.max("age"))).pull("top") == [70, 50, 70]
    assert t.mutate(keep="used", half=F.col("age") / 2).df.columns == ["name", "age", "half"] and t.mutate(keep="unused", half=F.col("age") / 2).df.columns == ["name", "kind", "half"] and t.transmute(half=F.col("age") / 2).df.columns == ["name", "half"]
    t.mutate(half=F.col("age") / 2).compute()
    assert d["@ cell : half >> Sum"].collect() == 65.0
    with pytest.raises(ValueError):
        t.filter(F.col("age") > 20).mutate(z=F.lit(1)).compute()
    with pytest.raises(UnsupportedOperationError):
        t.inner_join(t)
    assert sorted(map(tuple, d.get_tidy("cell", ["kind"]).collect())) == [("A", "kind", "x"), ("B", "kind", "y"), ("C", "kind", "x")]


def test_contracts(spark, monkeypatch):
    monkeypatch.setenv("LOOMFRAME_ENFORCE_CONTRACTS", "1")
    contract = c.create_contract("net", c.axis_contract("cell", c.RequiredInput), [c.contract_vector("cell", "age", c.RequiredInput, "Int64"), c.contract_vector("cell", "next", c.CreatedOutput, "Int64")])

    @c.computation("net", contract)
    def following(d):
        d.set_vector("cell", "next", d.get_vector("cell", "age").select("entry", (F.col("value") + 1).alias("value")))

    @c.computation("lazy", contract)
    def idle(d):
        return None

    @c.computation("sly", contract)
    def sly(d):
        return d.get_scalar("secret", 0)

    d = small(spark)
    with pytest.raises(c.ContractError, match="missing"):
        idle(d)
    with pytest.raises(c.ContractError, match="undeclared"):
        sly(d)
    following(d)
    assert d["@ cell : next"].collect() == {"A": 11, "B": 51, "C": 71}
    with pytest.raises(c.ContractError, match="existing"):
        following(d)
    merged = c.merge_contracts(contract, c.create_contract("use", c.axis_contract("cell", c.RequiredInput), c.contract_vector("cell", "next", c.RequiredInput)))
    assert merged.data["cell", "next"].expectation == c.CreatedOutput and "next" in c.contract_docs(merged)


def test_storage(spark, tmp_path):
    d = small(spark)
    d.set_scalar("pi", 3.14)
    d.set_matrix("cell", "cell", "m", spark.createDataFrame([("A", "B", 2.0)], "row string, col string, value double"), 0)
    save(d, f"{tmp_path}/set")
    back = load(spark, f"{tmp_path}/set")
    assert back["@ cell : age"].collect() == d["@ cell : age"].collect() and back[". pi"].collect() == 3.14 and back["@ cell @ cell :: m >> Sum"].collect() == 2.0
    with pytest.raises(FileExistsError):
        save(d, f"{tmp_path}/set")
    w = open_dataset(spark, f"{tmp_path}/set", "r+")
    w.set_vector("cell", "age", [1, 2, 3], True)
    w.flush()
    assert open_dataset(spark, f"{tmp_path}/set")["@ cell : age >> Sum"].collect() == 6
    assert open_dataset(spark).axes_set() == []


def test_numbers_follow_the_order_over_many_ranges(spark, monkeypatch):
    from loomframe import dataset

    monkeypatch.setattr(dataset, "RANGE_ROWS", 50)
    df = spark.range(1000).select(F.hex(F.xxhash64("id")).alias("entry")).repartition(7)
    got = [(r["entry"], r["pos"]) for r in dataset.numbered(df).collect()]
    assert sorted(got) == [(e, i) for i, e in enumerate(sorted(e for e, _ in got))]
