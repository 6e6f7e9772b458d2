"""Registered queries against their SQL, on the smallest tables: a spread of them; the driver runs all."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPREAD = ["group_mean_masked", "mask_and_or_xor", "mask_by_matrix", "chain_if_not_value", "chain_grouped", "group_vector_mode", "count_by_chain", "eltwise_significant", "matrix_rows_quantile", "matrix_group_rows_std", "matrix_group_nested_rows", "slice_square_row", "tidy_slice_max", "view_matrix", "concat_vector", "reconstruct_axis", "top_k_per_col", "adapter_computation", "index_gapped", "index_concatenated", "matrix_mode_ties", "matrix_mode_groups", "matrix_mode_all", "matrix_of_entries", "matrix_of_matrix", "dataset_changes", "contract_rules", "stored_based", "group_names", "collect_group_members", "kept_results_and_handlers"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_its_sql(spark, db, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
