"""Queries over small data sets with known answers."""

import math

import pytest

from loomframe.dataset import memory_dataset
from loomframe.functions import registry


@pytest.fixture(scope="module")
def vectors(spark):
    d = memory_dataset(spark)
    d.add_axis("ax", [f"e{i}" for i in range(1, 7)])
    d.set_vector("ax", "x", [1.0, 2, 3, 4, 5, 6])
    d.set_vector("ax", "g", list("aabbcc"))
    d.set_vector("ax", "m", [3, 1, 3, 1, 2, 2])
    d.set_vector("ax", "odd", [math.nan, 1.5, -2.5, 0.5, 2.5, 0.0])
    d.set_scalar("pi", 3.14)
    return d


@pytest.fixture(scope="module")
def lookups(spark):
    p = memory_dataset(spark)
    p.add_axis("cell", list("ABC"))
    p.add_axis("metacell", list("XY"))
    p.add_axis("type", list("UV"))
    p.set_vector("cell", "metacell", ["X", "Y", ""])
    p.set_vector("metacell", "type", ["U", ""])
    p.set_vector("type", "color", ["red", "green"])
    return p


@pytest.fixture(scope="module")
def cells(spark):
    m = memory_dataset(spark)
    m.add_axis("cell", list("ABCD"))
    m.add_axis("gene", ["X", "Y"])
    m.add_axis("type", list("UVW"))
    m.set_vector("cell", "type", list("UUVV"))
    m.set_matrix("gene", "cell", "UMIs", spark.createDataFrame([("X", "A", 1.0), ("X", "B", 3.0), ("Y", "C", -2.0), ("Y", "D", 4.0)], "row string, col string, value double"), 0)
    m.set_matrix("cell", "cell", "distance", [[0, 1, 2, 3], [1, 0, 4, 5], [2, 4, 0, 6], [3, 5, 6, 0]])
    return m


def same(got, want):
    if isinstance(want, dict):
        return got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)
    if isinstance(want, float):
        return math.isclose(got, want, abs_tol=1e-9) or (math.isnan(got) and math.isnan(want))
    return got == want


@pytest.mark.parametrize("query, want", [
    ("@ ax : x / g >> Sum", {"a": 3.0, "b": 7.0, "c": 11.0}),
    ("@ ax : x / g >| Var", {"a": 0.25, "b": 0.25, "c": 0.25}),
    ("@ ax : m >> Mode", 3),
    ("@ ax [ x > 2 & g != c ]", ["e3", "e4"]),
    ("@ ax [ ! x > 2 | g = c ] : x", {"e1": 1.0, "e2": 2.0, "e5": 5.0, "e6": 6.0}),
    ("@ ax [ x > 9 ] : x >> Sum || 0", 0.0),
    (". pi", 3.14), (". ?", ["pi"]), (". no || 5 type Int32", 5), (": x @ ax = e3", 3.0),
    ("@ ax : x >> Quantile p 0.25", 2.25), ("@ ax : x % Fraction >> Sum", 1.0),
    ("@ ax : odd >> Min", math.nan), ("@ ax : odd >> Median", math.nan),
    ("@ ax [ odd < 1 ]", ["e3", "e4", "e6"]), ("@ ax [ odd != 1.5 ]", ["e1", "e3", "e4", "e5", "e6"]), ("@ ax [ odd ]", ["e2", "e3", "e4", "e5"]),
    ("@ ax [ name != e1 ] : odd % Round", {"e2": 2, "e3": -2, "e4": 0, "e5": 2, "e6": 0}),
    ("@ ax [ name = e6 ] : odd % Log", {"e6": -math.inf}),
    ("@ ax [ name != e1 & odd >= 0 ] : odd >> GeoMean", 0.0),
    ("@ ax : g * m", {(a, b): n for a, r in zip("abc", ([1, 0, 1], [1, 0, 1], [0, 2, 0])) for b, n in zip("123", r)}),
])
def test_vectors(vectors, query, want):
    assert same(vectors[query].collect(), want)


@pytest.mark.parametrize("query", ["@ ax [ x > 9 ] : x >> Sum", "@ ax : odd % Convert type Int32", "@ ax : odd % Log", "@ ax : g >> Sum", "@ ax : no", ": x @ ax = e9", "@ no", "@ ax : odd >> Quantile p 0.5"])
def test_errors(vectors, query):
    with pytest.raises(Exception):  # noqa: B017
        vectors[query].collect()
    assert not vectors.has_query(query) or query == "@ ax : odd % Log"


@pytest.mark.parametrize("query, want", [
    ("@ cell : metacell ?? none : type ?? other : color", {"A": "red", "B": "other", "C": "none"}),
    ("@ cell : metacell ?? : type ?? : color", {"A": "red"}),
    ("@ cell [ metacell ?? none : type = U ]", ["A"]),
])
def test_lookups(lookups, query, want):
    assert lookups[query].collect() == want


def test_a_value_that_is_no_entry_is_an_error_whatever_is_read(lookups):
    with pytest.raises(Exception, match="no entries"):
        lookups["@ cell : metacell : type"].df.select("entry").collect()
    with pytest.raises(Exception, match="no entries"):
        lookups["@ cell : metacell : type"].df.count()


@pytest.mark.parametrize("query, want", [
    ("@ gene @ cell :: UMIs >| Sum", {"X": 4.0, "Y": 2.0}), ("@ cell @ gene :: UMIs >- Sum", {"X": 4.0, "Y": 2.0}),
    ("@ gene @ cell :: UMIs >| Min", {"X": 0.0, "Y": -2.0}), ("@ gene @ cell :: UMIs >| Median", {"X": 0.5, "Y": 0.0}),
    ("@ gene @ cell :: UMIs >> Var", sum((x - 0.75) ** 2 for x in [1, 3, 0, 0, 0, 0, -2, 4]) / 8),
    ("@ gene @ cell :: UMIs >| Mode", {"X": 0.0, "Y": 0.0}), ("@ cell @ gene :: UMIs -/ type >| Mean", {"U": 1.0, "V": 0.5}),
    ("@ gene @ cell :: UMIs |/ type >| Sum", {("X", "U"): 4.0, ("X", "V"): 0.0, ("Y", "U"): 0.0, ("Y", "V"): 2.0}),
    ("@ cell @ gene :: UMIs -/ type =@ >- Sum || 9", {("U", "X"): 4.0, ("U", "Y"): 0.0, ("V", "X"): 0.0, ("V", "Y"): 2.0, ("W", "X"): 9.0, ("W", "Y"): 9.0}),
    ("@ cell :: UMIs @ gene = X", {"A": 1.0, "B": 3.0, "C": 0.0, "D": 0.0}), ("@ cell :: distance @| B", {"A": 1, "B": 0, "C": 4, "D": 5}),
    ("@ cell [ UMIs @ gene = X > 0 ]", ["A", "B"]), (":: UMIs @ gene = X @ cell = D", 0.0),
    ("@ gene @ cell [ type = U ] :: UMIs >| Sum", {"X": 4.0, "Y": 0.0}), ("@ gene @ cell :: UMIs < 1 >| Sum", {"X": 2, "Y": 3}),
    ("@ gene @ cell :: UMIs % Abs % Log base 2 eps 1 >| Sum", {"X": 3.0, "Y": math.log2(3) + math.log2(5)}),
    ("@ gene @ cell :: UMIs >| GeoMean eps 3", {"X": (4 * 6 * 3 * 3) ** 0.25 - 3, "Y": (3 * 3 * 1 * 7) ** 0.25 - 3}),
    ("@ cell : type / type =@ >> Count || 0", {"U": 2, "V": 2, "W": 0}),
])
def test_matrices(cells, query, want):
    assert same(cells[query].collect(), want)


def test_labels_of_real_groups(spark):
    from pyspark.sql import functions as F

    from loomframe.plans.compile import label

    want = {1e20: "100000000000000000000.0", -3.0: "-3.0", 0.0: "0.0", -0.0: "0.0", 0.1: "0.1", 0.1 + 0.2: "0.3", 1e-5: "1e-05", 1e-4: "1e-04", 1.5e-4: "0.00015", 1.25e-7: "1.25e-07", 12345678.5: "12345678.5", -0.001: "-0.001", 900.25: "900.25", 123456789.125: "123456789.125", math.inf: "Inf", -math.inf: "-Inf", math.nan: "NaN", 2.5e-100: "2.5e-100"}
    rows = spark.createDataFrame([(x,) for x in want], "x double")
    got = [r["t"] for r in rows.select(label("x", rows.schema["x"].dataType).alias("t")).collect()]
    assert sorted(got) == sorted(want.values())
    d = memory_dataset(spark)
    d.add_axis("a", list("ABCD"))
    d.set_vector("a", "g", [1e20, math.nan, 0.5, 0.5])
    d.set_matrix("a", "a", "m", spark.createDataFrame([("A", "A", 1.0), ("C", "B", 2.0), ("B", "C", 3.0)], "row string, col string, value double"), 0)
    assert d["@ a : index / g >> Sum || 9"].collect() == {"100000000000000000000.0": 1, "NaN": 9, "0.5": 7}
    assert d["@ a @ a :: m -/ g >- Max || 9"].collect() == {("100000000000000000000.0", "A"): 1.0, **{("100000000000000000000.0", c): 0.0 for c in "BCD"}, ("0.5", "B"): 2.0, **{("0.5", c): 0.0 for c in "ACD"}, **{("NaN", c): 9.0 for c in "ABCD"}}
    with pytest.raises(Exception, match="NaN"):
        d["@ a @ a :: m -/ g >- Max"].collect()


def test_mode_ties_go_to_the_first_place(spark):
    d = memory_dataset(spark)
    d.add_axis("r", ["a", "b", "c"])
    d.add_axis("k", ["w", "x", "y", "z"])
    d.set_vector("k", "odd", [True, False, True, False])
    d.set_matrix("r", "k", "m", spark.createDataFrame([("a", "y", 5.0), ("a", "z", 5.0), ("b", "w", 5.0), ("b", "x", 5.0), ("c", "w", 7.0), ("c", "y", 0.0), ("c", "z", 7.0)], "row string, col string, value double"), 0)
    assert d["@ r @ k :: m >| Mode"].collect() == {"a": 0.0, "b": 5.0, "c": 7.0}
    assert d["@ r @ k [ ! odd ] :: m >| Mode"].collect() == {"a": 0.0, "b": 5.0, "c": 0.0}
    assert d["@ k @ r :: m >- Mode"].collect() == {"a": 0.0, "b": 5.0, "c": 7.0}
    assert d["@ r @ k :: m >> Mode"].collect() == 0.0 and d["@ r [ name = b ] @ k :: m >> Mode"].collect() == 5.0 and d["@ r [ name = a ] @ k :: m >> Mode"].collect() == 0.0
    assert d["@ r @ k :: m |/ odd >| Mode"].collect() == {("a", "true"): 0.0, ("a", "false"): 0.0, ("b", "true"): 5.0, ("b", "false"): 5.0, ("c", "true"): 7.0, ("c", "false"): 0.0}


def test_own_operations(vectors):
    from pyspark.sql import functions as F

    registry.register_reduction("Spread", lambda v: F.max(v) - F.min(v), overwrite=True)
    registry.register_eltwise("Twice", lambda v: v * 2, overwrite=True)
    try:
        assert vectors["@ ax : x % Twice / g >> Spread"].collect() == {"a": 2.0, "b": 2.0, "c": 2.0}
        with pytest.raises(ValueError, match="conflicting"):
            registry.register_reduction("Spread", lambda v: v)
    finally:
        registry.unregister("reduction", "Spread")
        registry.unregister("eltwise", "Twice")
