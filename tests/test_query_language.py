"""Tokens, parsing and canonical text."""

import pytest

from loomframe import builders as b
from loomframe.plans.nodes import QueryError, canonical_query, escape_value, is_axis_query, parse_query, query_axis_name, query_result_dimensions, unescape_value


@pytest.mark.parametrize("text", ['@ a [ b ~ x.*y & ! c = "q r" ] : d ?? || 3 type Int8 / g =@ >> Quantile p: 0.5', "@ ?", "@ a @ b :: m % Log base: 2 eps: 1 >- Sum", "@ a : ''", "@ a # note\n: b", "@ a [ x = \\@y ]"])
def test_canonical_text_parses_to_the_same_nodes(text):
    nodes = parse_query(text)
    assert parse_query(canonical_query(nodes)) == nodes


@pytest.mark.parametrize("value", ["", "plain", "with space", "a|b", "é", "quo\"te", "."])
def test_escaped_values_round_trip(value):
    assert parse_query(f"@ {escape_value(value)}")[0].name == value
    assert unescape_value(escape_value(value)) == value


@pytest.mark.parametrize("text", ["@", "a", "@ a >> None", "@ a : b >> Sum p 1", "@ a : b % Log base x", '@ "open', "@ a [ ]", "@ a : b || 1 type Odd", "@ a ? ?"])
def test_malformed_queries_are_refused(text):
    with pytest.raises(QueryError):
        parse_query(text)


def test_what_queries_are_about():
    assert is_axis_query("@ a [ b > 1 ]") and not is_axis_query("@ a : b")
    assert query_axis_name("@ a [ m @ c = d ]") == "a"
    assert [query_result_dimensions(t) for t in (". s", "@ a : b", "@ a @ b :: m", "@ a : b >> Sum", "@ a @ b :: m >| Sum", "@ a : b / c >> Sum", ": v @ a = e", "@ ?")] == [0, 1, 2, 0, 1, 1, 0, -1]


def test_builders_give_the_nodes_of_text():
    built = b.Axis("a") | b.BeginNegatedMask("x") | b.IsGreater(1) | b.EndMask() | b.LookupVector("y") | b.IfMissing(0, "Int32") | b.Log(base=2, eps=1) | b.GroupBy("g") | b.Mean()
    assert built.nodes == parse_query("@ a [ ! x > 1 ] : y || 0 type Int32 % Log base 2 eps 1 / g >> Mean")
    assert (b.Axis("a") | b.Axis("c") | b.LookupMatrix("m") | b.ReduceToRow(b.Sum())).nodes == parse_query("@ a @ c :: m >- Sum")
    with pytest.raises(TypeError):
        b.Mean(p=1)
