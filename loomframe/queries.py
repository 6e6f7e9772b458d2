"""The registered queries of the axis engine over the supplied tables, and the SQL each is held against.

Results of floating-point sums are rounded on both sides, as sums in another order differ in the last bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import builders as b
from . import config
from .dataset import Dataset, read_only
from .functions import registry
from .functions.fast_log import fast_log
from .operators.chain import chain_reader, chain_writer
from .operators.concat import CollectAxis, LastValue, concatenate
from .operators.complete import complete_chain, complete_dataset
from .operators.contracts import Contracted, ContractError, CreatedOutput, GuaranteedOutput, OptionalInput, RequiredInput, adapter, axis_contract, computation, contract_docs, contract_vector, create_contract, merge_contracts, verify_contract, verify_input, verify_output
from .operators.copies import copy_all, copy_axis, copy_matrix, copy_scalar, copy_tensor, copy_vector, empty_data
from .operators.reshape import collect_group_members, commit_reorder_axes, compact_groups, group_names, reconstruct_axis, reorder_axes, reset_reorder_axes
from .operators.topk import top_k_per_col
from .operators.view import VIEW_ALL_AXES, VIEW_ALL_DATA, viewer
from .plans.nodes import canonical_query, escape_value, is_axis_query, parse_query, query_axis_name, query_requires_relayout, query_result_dimensions, unescape_value
from .sources.anndata import as_anndata, read_annotated, write_annotated
from .sources.examples import example_cells, example_chain, example_metacells
from .sources.export import files_to_zarr, write_files, write_zarr, zarr_to_files
from .sources.store import ParquetDataset, open_dataset, save
from .sources.tables import from_tables, with_embedding, with_trade

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# SQL of the axes and matrices, shared by the oracles.
CUSTOMER = "(SELECT CAST(c_custkey AS VARCHAR) AS entry, c_custkey AS pos, n_name AS nation, c_acctbal AS acctbal, c_mktsegment AS segment, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
PART = "(SELECT CAST(p_partkey AS VARCHAR) AS entry, p_partkey AS pos, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM part)"
ORDER = "(SELECT CAST(o_orderkey AS VARCHAR) AS entry, o_orderkey AS pos, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS totalprice FROM orders)"
SPEND = "(SELECT c.entry AS row, p.entry AS col, p.pos AS pos, COALESCE(m.value, 0) AS value FROM (SELECT CAST(c_custkey AS VARCHAR) AS entry FROM customer) c CROSS JOIN (SELECT o_orderpriority AS entry, MIN(o_orderkey) AS pos FROM orders GROUP BY 1) p LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS row, o_orderpriority AS col, SUM(o_totalprice) AS value FROM orders GROUP BY 1, 2) m ON m.row = c.entry AND m.col = p.entry)"
TRADE = "(SELECT a.n_name AS row, b.n_name AS col, COALESCE(value, 0) AS value FROM nation a CROSS JOIN nation b LEFT JOIN (SELECT bn.n_name AS r, sn.n_name AS c, SUM(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation bn ON c_nationkey = bn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2) m ON m.r = a.n_name AND m.c = b.n_name)"
EVENTS = "(SELECT u.row, t.col, t.pos, COALESCE(m.value, 0) AS value FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS row FROM events) u CROSS JOIN (SELECT event_type AS col, MIN(event_id) AS pos FROM events GROUP BY 1) t LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS row, event_type AS col, SUM(value) AS value FROM events GROUP BY 1, 2) m ON m.row = u.row AND m.col = t.col)"
QUANTITY = "(SELECT CAST(l_partkey AS VARCHAR) AS row, CAST(l_suppkey AS VARCHAR) AS col, SUM(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def rounded(df, digits: int = 4):
    """Floating-point columns rounded for comparison."""
    return df.select(*(F.round(F.col(f"`{c}`").cast("double"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def register(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = sql


def dsl(name: str, query, sql: str, extra=None, digits: int = 4, dense: bool = True) -> None:
    """A query of the language over the tables."""

    def run(spark, sf_dir):
        ds = from_tables(spark, sf_dir)
        if extra is not None:
            ds = extra(ds, spark, sf_dir)
        got = ds.query(query)
        return rounded(got.dense() if dense and got.kind == "matrix" else got.df, digits)

    register(name, run, sql)


def over(name: str, fn, sql: str | None = None, digits: int = 4) -> None:
    """A function of the data set of the tables."""
    register(name, lambda spark, sf_dir: rounded(fn(from_tables(spark, sf_dir)), digits), sql)


# flagship, lookups, masks
dsl("group_mean_masked", "@ customer [ acctbal > 0 ] : acctbal / segment >> Mean", f"SELECT segment AS entry, ROUND(AVG(acctbal), 4) AS value FROM {CUSTOMER} WHERE acctbal > 0 GROUP BY 1")
dsl("scalar_lookup", ". version", "SELECT 1 AS value")
dsl("scalar_default", ". absent || 7 type Int32", "SELECT CAST(7 AS INTEGER) AS value")
dsl("names_axes", "@ ?", "SELECT * FROM (VALUES ('customer'), ('document'), ('event_type'), ('nation'), ('order'), ('part'), ('priority'), ('region'), ('supplier'), ('user'), ('vec')) t(name)")
dsl("names_vectors", "@ customer : ?", "SELECT * FROM (VALUES ('acctbal'), ('nation'), ('segment')) t(name)")
dsl("names_matrices", "@ part @ supplier :: ?", "SELECT 'quantity' AS name")
dsl("names_scalars", ". ?", "SELECT * FROM (VALUES ('organization'), ('version')) t(name)")
dsl("axis_entries", "@ part", f"SELECT entry FROM {PART}")
dsl("axis_compare", "@ nation != NATION_3", "SELECT n_name AS entry, n_name <> 'NATION_3' AS value FROM nation")
dsl("vector_lookup", "@ part : price", f"SELECT entry, ROUND(price, 4) AS value FROM {PART}")
dsl("vector_name", "@ part : name", f"SELECT entry, entry AS value FROM {PART}")
dsl("vector_default", "@ part : weight || 1.5 type Float64", f"SELECT entry, CAST(1.5 AS DOUBLE) AS value FROM {PART}")
dsl("mask_and_or_xor", '@ part [ size > 10 & price < 1000 | brand = Brand\\#11 ^ size = 7 ]', f"SELECT entry FROM {PART} WHERE (((size > 10 AND price < 1000) OR brand = 'Brand#11') <> (size = 7))")
dsl("mask_negated", "@ part [ ! size > 10 & ! price < 1000 ]", f"SELECT entry FROM {PART} WHERE NOT size > 10 AND NOT price < 1000")
dsl("mask_regex", "@ part [ type ~ ECON ] : size", f"SELECT entry, size AS value FROM {PART} WHERE regexp_matches(type, 'ECON')")
dsl("mask_regex_not", "@ part [ type !~ ^SMALL ]", f"SELECT entry FROM {PART} WHERE NOT regexp_matches(type, '^SMALL')")
dsl("mask_chained", "@ customer [ nation : region = EUROPE ] : acctbal", f"SELECT entry, ROUND(acctbal, 4) AS value FROM {CUSTOMER} WHERE region = 'EUROPE'")
dsl("mask_by_matrix", "@ nation [ trade @ nation = NATION_3 > 0 ]", f"SELECT row AS entry FROM {TRADE} WHERE col = 'NATION_3' AND value > 0", with_trade)
dsl("mask_by_square", "@ nation [ trade @| NATION_3 ]", f"SELECT row AS entry FROM {TRADE} WHERE col = 'NATION_3' AND value <> 0", with_trade)
for op, sign in (("<", "<"), ("<=", "<="), (">=", ">="), (">", ">"), ("=", "="), ("!=", "<>")):
    name = {"<": "lt", "<=": "le", ">=": "ge", ">": "gt", "=": "eq", "!=": "ne"}[op]
    dsl(f"compare_{name}", f"@ part : size {op} 25", f"SELECT entry, size {sign} 25 AS value FROM {PART}")
dsl("pick_entry", ": price @ part = 7", f"SELECT ROUND(price, 4) AS value FROM {PART} WHERE entry = '7'")
dsl("pick_entry_late", "@ part : price @ part = 7", f"SELECT ROUND(price, 4) AS value FROM {PART} WHERE entry = '7'")

# foreign-key lookups
dsl("chain_lookup", "@ customer : nation =@ : region", f"SELECT entry, region AS value FROM {CUSTOMER}")
dsl("chain_implicit", "@ order : customer : nation : region", f"SELECT o.entry, c.region AS value FROM {ORDER} o JOIN {CUSTOMER} c ON o.customer = c.entry")
dsl("chain_if_not_value", "@ region : name =@ nation ?? none : region", "SELECT r_name AS entry, COALESCE(b.r_name2, 'none') AS value FROM region LEFT JOIN (SELECT n_name, q.r_name AS r_name2 FROM nation JOIN region q ON n_regionkey = q.r_regionkey) b ON r_name = b.n_name")
dsl("chain_if_not_drop", "@ document : lang =@ nation ?? : region", "SELECT CAST(doc_id AS VARCHAR) AS entry, r_name AS value FROM documents JOIN nation ON lang = n_name JOIN region ON n_regionkey = r_regionkey")
dsl("chain_default", "@ customer : nation : currency || none type String", f"SELECT entry, 'none' AS value FROM {CUSTOMER}")
dsl("chain_grouped", "@ customer : acctbal / nation : region >> Sum", f"SELECT region AS entry, ROUND(SUM(acctbal), 4) AS value FROM {CUSTOMER} GROUP BY 1")

# reductions of vectors, whole and in groups
VECTOR_SQL = {
    "Sum": "ROUND(SUM(x), 4)", "Mean": "ROUND(AVG(x), 4)", "Min": "ROUND(MIN(x), 4)", "Max": "ROUND(MAX(x), 4)", "Count": "CAST(COUNT(*) AS BIGINT)",
    "Var": "ROUND(VAR_POP(x), 2)", "Std": "ROUND(STDDEV_POP(x), 4)", "VarN eps 1": "ROUND(VAR_POP(x) / (AVG(x) + 1), 4)", "StdN eps 1": "ROUND(STDDEV_POP(x) / (AVG(x) + 1), 4)",
    "Median": "ROUND(QUANTILE_CONT(x, 0.5), 4)", "Quantile p 0.3": "ROUND(QUANTILE_CONT(x, 0.3), 4)", "GeoMean eps 1": "ROUND(EXP(AVG(LN(x + 1))) - 1, 4)",
}
for op, expr in VECTOR_SQL.items():
    name = op.split()[0].lower()
    digits = 2 if name == "var" else 4
    dsl(f"reduce_vector_{name}", f"@ part : price >> {op}", f"SELECT {expr.replace('MAX(x)', 'MAX(price)').replace('(x', '(price')} AS value FROM {PART}", digits=digits)
    dsl(f"group_vector_{name}", f"@ part : price / brand >> {op}", f"SELECT brand AS entry, {expr.replace('MAX(x)', 'MAX(price)').replace('(x', '(price')} AS value FROM {PART} GROUP BY 1", digits=digits)
dsl("group_vector_mode", "@ part : size / brand >> Mode", "SELECT brand AS entry, v AS value FROM (SELECT brand, v, ROW_NUMBER() OVER (PARTITION BY brand ORDER BY c DESC, p) AS r FROM (SELECT brand, size AS v, COUNT(*) AS c, MIN(pos) AS p FROM " + PART + " GROUP BY 1, 2)) WHERE r = 1")
dsl("reduce_vector_mode", "@ part : brand >> Mode", f"SELECT brand AS value FROM {PART} GROUP BY 1 ORDER BY COUNT(*) DESC, MIN(pos) LIMIT 1")
dsl("reduce_count_strings", "@ part : brand >> Count", "SELECT CAST(COUNT(*) AS BIGINT) AS value FROM part")
dsl("reduce_typed", "@ part : size >> Sum type Int32", "SELECT CAST(SUM(p_size) AS INTEGER) AS value FROM part")
dsl("reduce_empty_default", "@ part [ size > 1000000 ] : price >> Sum || 0", "SELECT CAST(0 AS DOUBLE) AS value")
dsl("group_as_axis_default", "@ supplier : acctbal / nation =@ >> Sum || 0", "SELECT n_name AS entry, ROUND(COALESCE(SUM(s_acctbal), 0), 4) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
dsl("group_then_reduce", "@ customer : acctbal / nation >> Mean >> Max", f"SELECT ROUND(MAX(m), 4) AS value FROM (SELECT AVG(acctbal) AS m FROM {CUSTOMER} GROUP BY nation)")
dsl("count_by", "@ order : status * priority", "SELECT a.s AS row, b.p AS col, CAST(COALESCE(n, 0) AS BIGINT) AS value FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) b LEFT JOIN (SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2) ON s = o_orderstatus AND p = o_orderpriority")
dsl("count_by_chain", "@ customer : segment * nation : region", f"SELECT a.s AS row, b.p AS col, CAST(COALESCE(n, 0) AS BIGINT) AS value FROM (SELECT DISTINCT segment AS s FROM {CUSTOMER}) a CROSS JOIN (SELECT DISTINCT region AS p FROM {CUSTOMER}) b LEFT JOIN (SELECT segment, region, COUNT(*) AS n FROM {CUSTOMER} GROUP BY 1, 2) ON s = segment AND p = region")

# element-wise operations
dsl("eltwise_abs", "@ customer : acctbal % Abs", f"SELECT entry, ROUND(ABS(acctbal), 4) AS value FROM {CUSTOMER}")
dsl("eltwise_log", "@ part : price % Log base 2 eps 1", f"SELECT entry, ROUND(LN(price + 1) / LN(2), 4) AS value FROM {PART}")
dsl("eltwise_exp", "@ part : size % Clamp max 5 % Exp", f"SELECT entry, ROUND(EXP(LEAST(size, 5)), 4) AS value FROM {PART}")
dsl("eltwise_sqrt", "@ part : size % Sqrt", f"SELECT entry, ROUND(SQRT(size), 4) AS value FROM {PART}")
dsl("eltwise_round", "@ part : price % Round", f"SELECT entry, CAST(round_even(price, 0) AS BIGINT) AS value FROM {PART}")
dsl("eltwise_clamp", "@ customer : acctbal % Clamp min 0 max 5000", f"SELECT entry, ROUND(LEAST(GREATEST(acctbal, 0), 5000), 4) AS value FROM {CUSTOMER}")
dsl("eltwise_convert", "@ part : size % Convert type Float64", f"SELECT entry, CAST(size AS DOUBLE) AS value FROM {PART}")
dsl("eltwise_fraction", "@ part : price % Fraction", f"SELECT entry, ROUND(price / SUM(price) OVER (), 8) AS value FROM {PART}", digits=8)
dsl("eltwise_significant", "@ customer : acctbal % Significant high 3000 low 1000", f"SELECT entry, ROUND(CASE WHEN (SELECT MAX(ABS(acctbal)) FROM {CUSTOMER}) < 3000 OR ABS(acctbal) < 1000 THEN 0 ELSE acctbal END, 4) AS value FROM {CUSTOMER}")
dsl("eltwise_scalar", "@ part : price >> Sum % Log base 10", f"SELECT ROUND(LN(SUM(price)) / LN(10), 4) AS value FROM {PART}")

# matrices
dsl("matrix_lookup", "@ customer @ priority :: spend", f"SELECT row, col, ROUND(value, 4) AS value FROM {SPEND}")
dsl("matrix_transposed", "@ priority @ customer :: spend", f"SELECT col AS row, row AS col, ROUND(value, 4) AS value FROM {SPEND}")
dsl("matrix_stored", "@ part @ supplier :: quantity", f"SELECT row, col, ROUND(value, 4) AS value FROM {QUANTITY}", dense=False)
dsl("matrix_masked_rows_cols", "@ customer [ segment = BUILDING ] @ priority [ name != 1-URGENT ] :: spend >| Sum", f"SELECT row AS entry, ROUND(SUM(value), 4) AS value FROM {SPEND} JOIN {CUSTOMER} c ON row = c.entry WHERE segment = 'BUILDING' AND col <> '1-URGENT' GROUP BY 1")
dsl("matrix_default", "@ customer @ priority :: absent || 2 >> Sum", "SELECT CAST(2 * (SELECT COUNT(*) FROM customer) * (SELECT COUNT(DISTINCT o_orderpriority) FROM orders) AS BIGINT) AS value")
dsl("slice_column", "@ customer :: spend @ priority = 1-URGENT", f"SELECT row AS entry, ROUND(value, 4) AS value FROM {SPEND} WHERE col = '1-URGENT'")
dsl("slice_square_column", "@ nation :: trade @| NATION_3", f"SELECT row AS entry, ROUND(value, 2) AS value FROM {TRADE} WHERE col = 'NATION_3'", with_trade, 2)
dsl("slice_square_row", "@ nation :: trade @- NATION_3", f"SELECT col AS entry, ROUND(value, 2) AS value FROM {TRADE} WHERE row = 'NATION_3'", with_trade, 2)
dsl("pick_cell", ":: spend @ customer = 1 @ priority = 1-URGENT", f"SELECT ROUND(value, 4) AS value FROM {SPEND} WHERE row = '1' AND col = '1-URGENT'")
dsl("pick_column_of_matrix", "@ customer @ priority :: spend @ priority = 5-LOW", f"SELECT row AS entry, ROUND(value, 4) AS value FROM {SPEND} WHERE col = '5-LOW'")
dsl("matrix_compare", "@ customer @ priority :: spend > 100000 >> Sum", f"SELECT CAST(SUM(CASE WHEN value > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS value FROM {SPEND}")
for op, expr in VECTOR_SQL.items():
    name = op.split()[0].lower()
    digits = 2 if name in ("var", "varn") else 3
    sql = expr.replace(", 4)", f", {digits})").replace("MAX(x)", "MAX(value)").replace("(x", "(value")
    dsl(f"matrix_rows_{name}", f"@ user @ event_type :: value >| {op}" if name != "geomean" else "@ user @ event_type :: value % Abs >| GeoMean eps 1", f"SELECT row AS entry, {sql.replace('LN(value', 'LN(ABS(value)')} AS value FROM {EVENTS} GROUP BY 1", digits=digits)
    if name in ("sum", "mean", "min", "max", "count", "std", "median", "quantile"):
        dsl(f"matrix_cols_{name}", f"@ customer @ priority :: spend >- {op}", f"SELECT col AS entry, {sql} AS value FROM {SPEND} GROUP BY 1", digits=digits)
        dsl(f"matrix_all_{name}", f"@ user @ event_type :: value >> {op}", f"SELECT {sql} AS value FROM {EVENTS}", digits=digits)
        dsl(f"matrix_group_rows_{name}", f"@ customer @ priority :: spend -/ segment >- {op}", f"SELECT segment AS row, col, {sql} AS value FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry GROUP BY 1, 2", digits=digits)
dsl("matrix_group_cols_mean", "@ priority @ customer :: spend |/ segment >| Mean", f"SELECT col AS row, segment AS col, ROUND(AVG(value), 3) AS value FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry GROUP BY 1, 2", digits=3)
dsl("matrix_group_nested_rows", "@ customer @ priority :: spend -/ segment >| Mean", f"SELECT segment AS entry, ROUND(AVG(m), 3) AS value FROM (SELECT segment, col, AVG(value) AS m FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry GROUP BY 1, 2) GROUP BY 1", digits=3)
dsl("matrix_group_nested_cols", "@ priority @ customer :: spend |/ segment >- Max", f"SELECT segment AS entry, ROUND(MAX(m), 3) AS value FROM (SELECT segment, col, MAX(value) AS m FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry GROUP BY 1, 2) GROUP BY 1", digits=3)
dsl("matrix_group_as_axis", "@ supplier @ supplier :: none || 1 -/ nation =@ >- Sum || 0 >> Sum", "SELECT CAST(COUNT(*) * COUNT(*) AS BIGINT) AS value FROM supplier")
dsl("matrix_mode_rows", "@ customer @ priority :: spend > 0 >| Mode", f"SELECT row AS entry, v AS value FROM (SELECT row, v, ROW_NUMBER() OVER (PARTITION BY row ORDER BY n DESC, p) AS k FROM (SELECT row, value > 0 AS v, COUNT(*) AS n, MIN(pos) AS p FROM {SPEND} GROUP BY 1, 2)) WHERE k = 1")
dsl("matrix_log_rows", "@ customer @ priority :: spend % Log base 2 eps 1 >| Sum", f"SELECT row AS entry, ROUND(SUM(LN(value + 1) / LN(2)), 4) AS value FROM {SPEND} GROUP BY 1")
dsl("matrix_fraction", "@ customer @ priority :: spend % Fraction >| Max", f"SELECT row AS entry, ROUND(MAX(f), 8) AS value FROM (SELECT row, value / SUM(value) OVER (PARTITION BY col) AS f FROM {SPEND}) GROUP BY 1", digits=8)
dsl("matrix_significant", "@ nation @ nation :: trade % Significant high 100000 low 1000 >| Sum", f"SELECT row AS entry, ROUND(SUM(CASE WHEN top < 100000 OR ABS(value) < 1000 THEN 0 ELSE value END), 2) AS value FROM (SELECT *, MAX(ABS(value)) OVER (PARTITION BY col) AS top FROM {TRADE}) GROUP BY 1", with_trade, 2)
dsl("matrix_dense_means", "@ vec @ dim :: embedding >- Mean", "SELECT CAST(d - 1 AS VARCHAR) AS entry, ROUND(AVG(x), 6) AS value FROM (SELECT UNNEST(embedding) AS x, UNNEST(range(1, len(embedding) + 1)) AS d FROM embeddings) GROUP BY 1", with_embedding, 6)
dsl("matrix_dense_grouped", "@ vec @ dim :: embedding -/ label >- Mean", "SELECT CAST(label AS VARCHAR) AS row, CAST(d - 1 AS VARCHAR) AS col, ROUND(AVG(x), 6) AS value FROM (SELECT label, UNNEST(embedding) AS x, UNNEST(range(1, len(embedding) + 1)) AS d FROM embeddings) GROUP BY 1, 2", with_embedding, 6)
dsl("builder_query", b.Axis("customer") | b.BeginMask("acctbal") | b.IsGreater(0) | b.EndMask() | b.LookupVector("acctbal") | b.GroupBy("segment") | b.Mean(), ORACLE_SQL["group_mean_masked"])

# data frames and tidy verbs
over("frame_wide", lambda ds: ds.get_dataframe("customer", {"seg": "segment", "region": ": nation : region"}), f"SELECT entry AS name, segment AS seg, region FROM {CUSTOMER}")
over("frame_tidy", lambda ds: ds.get_tidy("customer", ["segment", "nation"]), f"SELECT entry AS name, 'segment' AS key, segment AS value FROM {CUSTOMER} UNION ALL SELECT entry, 'nation', nation FROM {CUSTOMER}")
over("tidy_filter_mutate", lambda ds: ds.tbl("part").filter(F.col("size") > 40).mutate(unit=F.col("price") / F.col("size")).select("unit").df, f"SELECT entry AS name, ROUND(price / size, 4) AS unit FROM {PART} WHERE size > 40")
over("tidy_summarise", lambda ds: ds.tbl("part").group_by("brand").summarise(n=F.count(F.lit(1)), top=F.max("price")), f"SELECT brand, COUNT(*) AS n, ROUND(MAX(price), 4) AS top FROM {PART} GROUP BY 1")
over("tidy_summarise_tied", lambda ds: ds.tbl("customer").summarise(by="nation", n=F.count(F.lit(1))).df, f"SELECT nation AS name, COUNT(*) AS n FROM {CUSTOMER} GROUP BY 1")
over("tidy_count", lambda ds: ds.tbl("customer").count("segment"), f"SELECT segment, COUNT(*) AS n FROM {CUSTOMER} GROUP BY 1")
over("tidy_slice_max", lambda ds: ds.tbl("part").slice_max("price", 2, by="brand").select("brand", "price").df, f"SELECT entry AS name, brand, ROUND(price, 4) AS price FROM (SELECT *, RANK() OVER (PARTITION BY brand ORDER BY price DESC) AS r FROM {PART}) WHERE r <= 2")
over("tidy_add_count", lambda ds: ds.tbl("part").add_count("brand").select("n").df, f"SELECT entry AS name, COUNT(*) OVER (PARTITION BY brand) AS n FROM {PART}")
over("tidy_distinct", lambda ds: ds.tbl("part").distinct("brand"), "SELECT DISTINCT p_brand AS brand FROM part")
over("tidy_slice_head", lambda ds: ds.tbl("part").slice_head(3).select("brand").df, f"SELECT entry AS name, brand FROM {PART} ORDER BY pos LIMIT 3")


# views, chains, copies
def _europe(ds):
    return viewer(ds, axes={**VIEW_ALL_AXES, "customer": "@ customer [ nation : region = EUROPE ]"}, data={("customer", "balance"): ": acctbal", ("customer", "priority", "spend"): "="})


over("view_vector", lambda ds: _europe(ds)["@ customer : balance"].df, f"SELECT entry, ROUND(acctbal, 4) AS value FROM {CUSTOMER} WHERE region = 'EUROPE'")
over("view_matrix", lambda ds: _europe(ds)["@ customer @ priority :: spend >- Sum"].df, f"SELECT col AS entry, ROUND(SUM(value), 4) AS value FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry WHERE region = 'EUROPE' GROUP BY 1")


def _chained(ds):
    leaf = Dataset(ds.spark, "leaf")
    both = chain_writer([ds, leaf])
    both.set_vector("part", "price", ds.get_vector("part", "price").select("entry", (F.col("value") * 2).alias("value")), True)
    return chain_reader([ds, leaf])


over("chain_last_wins", lambda ds: _chained(ds)["@ part [ size > 25 ] : price"].df, f"SELECT entry, ROUND(price * 2, 4) AS value FROM {PART} WHERE size > 25")


def _copied(ds):
    to = Dataset(ds.spark, "copy")
    copy_axis(to, ds, "customer")
    copy_vector(to, ds, "customer", "acctbal", rename="balance")
    to.add_axis("priority", ["1-URGENT", "5-LOW"])
    copy_matrix(to, ds, "customer", "priority", "spend")
    return to


over("copy_vector", lambda ds: _copied(ds)["@ customer : balance"].df, f"SELECT entry, ROUND(acctbal, 4) AS value FROM {CUSTOMER}")
over("copy_matrix_subset", lambda ds: _copied(ds)["@ customer @ priority :: spend >| Sum"].df, f"SELECT row AS entry, ROUND(SUM(value), 4) AS value FROM {SPEND} WHERE col IN ('1-URGENT', '5-LOW') GROUP BY 1")


def _superset(ds):
    to = Dataset(ds.spark, "more")
    to.add_axis("region", ["AFRICA", "AMERICA", "ASIA", "ATLANTIS", "EUROPE", "MIDDLE EAST"])
    source = Dataset(ds.spark, "less")
    source.add_axis("region", ds.axis_frame("region").select("entry", "pos"), check=False)
    counts = ds["@ nation : region / region >> Count"].df
    source.set_vector("region", "nations", counts)
    copy_all(to, source, {"region|nations": 0})
    return to


over("copy_superset_empty", lambda ds: _superset(ds)["@ region : nations"].df, "SELECT r_name AS entry, COUNT(n_nationkey) AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'ATLANTIS', 0")


def _halves(ds):
    out = []
    for name, rule in (("small", "@ part [ size <= 25 ]"), ("large", "@ part [ size > 25 ]")):
        half = viewer(ds, name, axes={"part": rule, "supplier": "="}, data={("part", "price"): "=", ("part", "supplier", "quantity"): "=", ("supplier", "acctbal"): "=", "version": "="})
        out.append(half)
    to = Dataset(ds.spark, "both")
    concatenate(to, "part", out, prefix=True, merge={("supplier", "acctbal"): LastValue, "version": CollectAxis})
    return to


over("concat_vector", lambda ds: _halves(ds)["@ part : price"].df, f"SELECT CASE WHEN size <= 25 THEN 'small.' ELSE 'large.' END || entry AS entry, ROUND(price, 4) AS value FROM {PART}")
over("concat_dataset", lambda ds: _halves(ds)["@ part : dataset / dataset >> Count"].df, f"SELECT CASE WHEN size <= 25 THEN 'small' ELSE 'large' END AS entry, CAST(COUNT(*) AS BIGINT) AS value FROM {PART} GROUP BY 1")
over("concat_matrix", lambda ds: _halves(ds)["@ part @ supplier :: quantity >- Sum"].df, "SELECT CAST(s_suppkey AS VARCHAR) AS entry, ROUND(COALESCE(SUM(l_quantity), 0), 4) AS value FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
over("concat_merged", lambda ds: _halves(ds)["@ dataset : version"].df, "SELECT * FROM (VALUES ('small', CAST(1 AS BIGINT)), ('large', CAST(1 AS BIGINT))) t(entry, value)")


# reshaping
def _reconstructed(ds):
    to = Dataset(ds.spark, "flat")
    frame = ds.axis_frame("customer").join(ds["@ customer : nation : region"].df.select("entry", F.col("value").alias("v_nation.region")), "entry")
    to.axes["customer"] = frame
    reconstruct_axis(to, "customer", "nation", implicit_properties=["nation.region"])
    return to


over("reconstruct_axis", lambda ds: _reconstructed(ds)["@ nation : nation.region"].df, f"SELECT DISTINCT nation AS entry, region AS value FROM {CUSTOMER}")


def _reordered(ds):
    order = ds.axis_frame("part").select("entry", (-F.col("pos")).alias("pos"))
    reorder_axes(ds, part=order)
    return ds.get_dataframe("part", ["size", "index"])


over("reorder_axes", _reordered, f"SELECT entry AS name, size, ROW_NUMBER() OVER (ORDER BY pos DESC) AS \"index\" FROM {PART}")
over("compact_groups", lambda ds: compact_groups(ds, "part", "size").select("entry", "group"), f"SELECT entry, DENSE_RANK() OVER (ORDER BY f) AS \"group\" FROM (SELECT entry, MIN(pos) OVER (PARTITION BY size) AS f FROM {PART})")
over("collect_group_members", lambda ds: collect_group_members(ds, "part", "size").select("group", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members")), f"SELECT size AS \"group\", string_agg(CAST(place AS VARCHAR), ',' ORDER BY pos) AS members FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY pos) AS place FROM {PART}) GROUP BY 1")
over("group_names", lambda ds: group_names(ds, "vec", "label", "G"), """
SELECT label AS "group", 'G' || lpad(printf('%x', list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(range(1, strlen(t) + 1), lambda i: CAST(ascii(substr(t, i, 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)), 8, '0') AS name
FROM (SELECT label, string_agg(CAST(vec_id AS VARCHAR), chr(1) ORDER BY CAST(vec_id AS VARCHAR)) AS t FROM embeddings WHERE label <> 0 GROUP BY 1)""")
over("top_k_per_col", lambda ds: top_k_per_col(ds, "customer", "priority", "spend", 3).select("col", "rank", "entry", "value"), "SELECT col, CAST(rank AS INTEGER) AS rank, row AS entry, ROUND(value, 4) AS value FROM (SELECT o_orderpriority AS col, CAST(o_custkey AS VARCHAR) AS row, SUM(o_totalprice) AS value, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY SUM(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY o_orderpriority, o_custkey) WHERE rank <= 3")


# users' operations, contracts, adapters
def _own(ds):
    registry.register_reduction("Range", lambda v: F.max(v) - F.min(v), overwrite=True)
    registry.register_eltwise("Halve", lambda v: v / 2, overwrite=True)
    return ds["@ part : price % Halve / brand >> Range"].df


over("own_operations", _own, f"SELECT brand AS entry, ROUND((MAX(price) - MIN(price)) / 2, 4) AS value FROM {PART} GROUP BY 1")

_CONTRACT = create_contract("net", axis_contract("part", RequiredInput), [contract_vector("part", "price", RequiredInput, "Float64"), contract_vector("part", "net", CreatedOutput, "Float64")])


@computation("net", _CONTRACT)
def _net(ds):
    ds.set_vector("part", "net", ds.get_vector("part", "price").select("entry", (F.col("value") * 0.8).alias("value")))


def _adapted(ds):
    adapter(ds, _net, input_axes={"part": "="}, input_data={("part", "price"): "="}, output_axes={"part": "="}, output_data={("part", "netto"): ": net"})
    return ds["@ part : netto"].df


over("adapter_computation", _adapted, f"SELECT entry, ROUND(price * 0.8, 4) AS value FROM {PART}")


# places, ties, labels
def facts(name: str, fn, want: dict[str, object]) -> None:
    """What a function of the data set of the tables tells, as rows (what, value) of text."""
    values = ", ".join(f"('{k}', '{str(v).replace(chr(39), chr(39) * 2)}')" for k, v in want.items())
    register(name, lambda spark, sf_dir: spark.createDataFrame([(k, str(v)) for k, v in fn(from_tables(spark, sf_dir)).items()], "what string, value string"), f"SELECT * FROM (VALUES {values}) t(what, value)")


dsl("index_gapped", "@ event_type : index", "SELECT event_type AS entry, ROW_NUMBER() OVER (ORDER BY MIN(event_id)) AS value FROM events GROUP BY 1")
over("index_concatenated", lambda ds: _halves(ds)["@ part : index"].df, f"SELECT CASE WHEN size <= 25 THEN 'small.' ELSE 'large.' END || entry AS entry, ROW_NUMBER() OVER (ORDER BY size > 25, pos) AS value FROM {PART}")
dsl("index_masked", "@ part [ index <= 10 ]", f"SELECT entry FROM (SELECT entry, ROW_NUMBER() OVER (ORDER BY pos) AS i FROM {PART}) WHERE i <= 10")
dsl("matrix_mode_ties", "@ customer @ priority [ name != 3-MEDIUM ] :: spend > 0 >| Mode", f"SELECT row AS entry, v AS value FROM (SELECT row, v, ROW_NUMBER() OVER (PARTITION BY row ORDER BY n DESC, p) AS k FROM (SELECT row, value > 0 AS v, COUNT(*) AS n, MIN(pos) AS p FROM {SPEND} WHERE col <> '3-MEDIUM' GROUP BY 1, 2)) WHERE k = 1")
dsl("matrix_mode_cols", "@ customer [ segment = BUILDING ] @ priority :: spend > 100000 >- Mode", f"SELECT col AS entry, v AS value FROM (SELECT col, v, ROW_NUMBER() OVER (PARTITION BY col ORDER BY n DESC, p) AS k FROM (SELECT col, value > 100000 AS v, COUNT(*) AS n, MIN(c.pos) AS p FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry WHERE segment = 'BUILDING' GROUP BY 1, 2)) WHERE k = 1")
dsl("matrix_mode_groups", "@ customer @ priority :: spend > 0 -/ nation >- Mode", f"SELECT nation AS row, col, v AS value FROM (SELECT nation, col, v, ROW_NUMBER() OVER (PARTITION BY nation, col ORDER BY n DESC, p) AS k FROM (SELECT nation, col, value > 0 AS v, COUNT(*) AS n, MIN(c.pos) AS p FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry GROUP BY 1, 2, 3)) WHERE k = 1")
dsl("matrix_mode_all", "@ nation @ nation :: trade > 20000 >> Mode", f"SELECT v AS value FROM (SELECT value > 20000 AS v, COUNT(*) AS n, MIN((col.n_nationkey) * 25 + r.n_nationkey) AS p FROM {TRADE} m JOIN nation col ON col.n_name = m.col JOIN nation r ON r.n_name = m.row GROUP BY 1) ORDER BY n DESC, p LIMIT 1", with_trade)
dsl("group_real_labels", "@ part : size / price >> Count", f"SELECT CASE WHEN price = FLOOR(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(price AS VARCHAR) END AS entry, COUNT(*) AS value FROM {PART} GROUP BY 1")


# lookups by matrices
def _home(ds, spark, sf_dir):
    """ds with the matrix nation (customer x priority): the customer's nation where it has orders of the priority, else none."""
    cells = ds.get_matrix("customer", "priority", "spend").select("row", "col").join(ds.get_vector("customer", "nation").select(F.col("entry").alias("row"), "value"), "row")
    ds.set_matrix("customer", "priority", "nation", cells, "")
    return with_trade(ds, spark, sf_dir)


HOME = f"(SELECT s.row, s.col, CASE WHEN s.value > 0 THEN c.nation END AS nation, c.region FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry)"
dsl("matrix_of_entries", "@ customer @ priority :: nation ?? none : region", f"SELECT row, col, CASE WHEN nation IS NULL THEN 'none' ELSE region END AS value FROM {HOME}", _home)
dsl("matrix_of_matrix", "@ customer @ priority :: nation :: trade @ nation = NATION_3", f"SELECT h.row, h.col, ROUND(COALESCE(t.value, 0), 2) AS value FROM {HOME} h LEFT JOIN {TRADE} t ON t.row = h.nation AND t.col = 'NATION_3'", _home, 2)
dsl("vector_of_matrix", "@ customer : nation :: trade @| NATION_3", f"SELECT c.entry, ROUND(t.value, 2) AS value FROM {CUSTOMER} c JOIN {TRADE} t ON t.row = c.nation AND t.col = 'NATION_3'", _home, 2)
dsl("reduce_empty_dimension", "@ customer [ acctbal > 1000000 ] @ priority :: spend >- Sum || -1", "SELECT o_orderpriority AS entry, CAST(-1 AS DOUBLE) AS value FROM orders GROUP BY 1")
dsl("reduce_default_unused", "@ part : price >> Max || 0", "SELECT ROUND(MAX(p_retailprice), 4) AS value FROM part")
for sign, name in ((">>", "scalar"), (">|", "column"), (">-", "row")):
    dsl(f"group_reduced_to_{name}", f"@ part : size / brand {sign} Max", f"SELECT brand AS entry, MAX(size) AS value FROM {PART} GROUP BY 1")


# the data set itself
def _changed(ds):
    out = {"read only": hasattr(read_only(ds), "set_scalar"), "leaf": ds.is_leaf(), "axes": ",".join(ds.axes_set()[:3]), "has": ds.has_query("@ part : price"), "has not": ds.has_query("@ part : weight"), "empty": ds.has_query("@ part [ size > 1000000 ]")}
    ds.set_scalar("n", 1)
    ds.set_scalar("n", 2, overwrite=True)
    out["version"] = ds.version("scalar", "n")
    ds.relayout_matrix("customer", "priority", "spend")
    ds.delete_vector("part", "size")
    ds.delete_matrix("customer", "priority", "spend")
    ds.delete_axis("supplier")
    ds.delete_scalar("n")
    return out | {"vectors": ",".join(ds.vectors_set("part")), "matrices": ",".join(ds.matrices_set("customer", "priority")), "supplier": ds.has_axis("supplier"), "scalar": ds.get_scalar("n", "gone"), "described": "part.price: Float64" in ds.description()}


facts("dataset_changes", _changed, {"read only": False, "leaf": True, "axes": "customer,document,event_type", "has": True, "has not": False, "empty": False, "version": 2, "vectors": "brand,price,type", "matrices": "", "supplier": False, "scalar": "gone", "described": True})
facts("axis_places", lambda ds: {"entries": ",".join(ds.axis_entries("region", [5, 1])), "indices": ds.axis_indices("nation", ["NATION_3", "NATION_0"]), "missing": ds.axis_indices("nation", ["", "X"], True, True), "dict": ds.axis_dict("region")["ASIA"], "length": ds.axis_length("nation")}, {"entries": "MIDDLE EAST,AFRICA", "indices": "[4, 1]", "missing": "[0, 0]", "dict": 3, "length": 25})


def _parsed(ds):
    nodes = parse_query("@ a [ b > 1 & ! c ] : d / e >> Mean")
    return {
        "canonical": canonical_query(nodes), "nodes": len(nodes), "again": parse_query(canonical_query(nodes)) == nodes, "escaped": unescape_value(escape_value("a b#c")) == "a b#c", "axis query": is_axis_query("@ a [ b ]"),
        "vector query": is_axis_query("@ a : b"), "axis": query_axis_name("@ a [ b ]"), "relayout": query_requires_relayout("@ a @ b :: c"),
        "dimensions": [query_result_dimensions(t) for t in (". s", "@ a : b", "@ a @ b :: m", "@ a : b >> Sum", "@ a @ b :: m >| Sum", "@ a : b / c >> Sum", "@ a @ b :: m -/ c >- Sum", "@ a @ b :: m -/ c >| Sum", ": v @ a = e", "@ ?")],
    }


facts("query_tools", _parsed, {"canonical": "@ a [ b > 1 & ! c ] : d / e >> Mean", "nodes": 8, "again": True, "escaped": True, "axis query": True, "vector query": False, "axis": "a", "relayout": False, "dimensions": "[0, 1, 2, 0, 1, 1, 2, 1, 0, -1]"})


def _kept(ds):
    plan = ds.query("@ part : size >> Max")
    once = ds.query("@ part : size >> Max") is plan
    config.empty_cache([ds])
    again = ds.query("@ part : size >> Max") is plan
    first = config.keep(ds, "@ part : size >> Sum")
    same = config.keep(ds, "@ part : size >> Sum") is first
    ds.set_scalar("changed", 1)
    other = config.keep(ds, "@ part : size >> Sum") is first
    config.empty_cache([ds])
    said: list[str] = []
    config.register_handler("collect", said.append)
    before = config.inefficient_action_handler("collect")
    try:
        registry.register_eltwise("Next", lambda v: v + 1, overwrite=True)
        ds.query("@ customer @ priority :: spend % Next >| Max")
    finally:
        config.inefficient_action_handler(before)
    return {"planned once": once, "planned again": again, "same": same, "after a change": other, "handler": before, "dense": len(said), "reductions": {"Sum", "Mode"} <= set(registry.registered_reductions()), "eltwise": "Log" in registry.registered_eltwise()}


facts("kept_results_and_handlers", _kept, {"planned once": True, "planned again": False, "same": True, "after a change": False, "handler": "warn", "dense": 1, "reductions": True, "eltwise": True})


# storage: written, read again, and asked
def _again(ds, kind):
    """A part of ds, through files in the folder that the session shares."""
    from .sources.store import shared_folder

    some = Dataset(ds.spark, "some")
    for axis in ("region", "nation", "priority", "supplier"):
        some.add_axis(axis, ds.axis_frame(axis).select("entry", "pos"), check=False)
    some.set_vector("nation", "region", ds.get_vector("nation", "region").select("entry", "value"))
    some.set_vector("supplier", "acctbal", ds.get_vector("supplier", "acctbal").select("entry", "value"))
    some.set_vector("supplier", "rich", F.col("v_acctbal") > 5000)
    spend = ds.get_matrix("customer", "priority", "spend").join(ds.get_vector("customer", "nation").select(F.col("entry").alias("row"), F.col("value").alias("nation")), "row")
    some.set_matrix("nation", "priority", "spend", spend.groupBy(F.col("nation").alias("row"), "col").agg(F.sum("value").alias("value")), 0)
    some.set_scalar("version", 1)
    path = f"{shared_folder(ds.spark)}/{uuid.uuid4().hex}"
    if kind == "parquet":
        save(some, path)
    elif kind == "grown":
        save(some, path)
        grown = ParquetDataset(ds.spark, path, "r+")
        grown.set_scalar("version", 1, overwrite=True)
        grown.flush()
    elif kind == "based":
        save(some, path)
        leaf = ParquetDataset(ds.spark, f"{path}-leaf", "w")
        complete_chain(open_dataset(ds.spark, path), path, leaf).set_scalar("leaf", 1)
        leaf.flush()
        return complete_dataset(ds.spark, f"{path}-leaf")
    elif kind == "files":
        write_files(some, path)
    elif kind == "zarr":
        path += ".daf.zarr"
        write_zarr(some, path)
    elif kind == "files_zarr":
        write_files(some, path)
        files_to_zarr(ds.spark, path, f"{path}.daf.zarr")
        path += ".daf.zarr"
    elif kind == "zarr_files":
        write_zarr(some, f"{path}.daf.zarr")
        zarr_to_files(ds.spark, f"{path}.daf.zarr", path)
    return open_dataset(ds.spark, path)


STORED = f"SELECT n_name AS entry, r_name AS region, ROUND(COALESCE(v, 0), 2) AS spent, (SELECT COUNT(*) FROM supplier WHERE s_acctbal > 5000) AS rich FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey"
for _kind in ("parquet", "grown", "based", "files", "zarr", "files_zarr", "zarr_files"):

    def _asked(ds, kind=_kind):
        back = _again(ds, kind)
        spent = back["@ nation @ priority :: spend >| Sum"].df.withColumnRenamed("value", "spent")
        return back.get_vector("nation", "region").select("entry", F.col("value").alias("region")).join(spent, "entry").crossJoin(F.broadcast(back["@ supplier [ rich ] : name >> Count"].df.select(F.col("value").alias("rich"))))  # one row

    over(f"stored_{_kind}", _asked, STORED, 2)


# tidy verbs
over("tidy_arrange_lasts", lambda ds: ds.tbl("part").arrange(F.desc("price"), "size").mutate(price=F.lit(0)).slice_head(5).select("size").df, f"SELECT entry AS name, size FROM {PART} ORDER BY price DESC, size, pos LIMIT 5")
over("tidy_slice", lambda ds: ds.tbl("part").slice(2, 4).select("size").df, f"SELECT entry AS name, size FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY pos) AS r FROM {PART}) WHERE r IN (2, 4)")
over("tidy_slice_grouped", lambda ds: ds.tbl("part").group_by("brand").slice(1, 3).select("brand").df, f"SELECT entry AS name, brand FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY brand ORDER BY pos) AS r FROM {PART}) WHERE r IN (1, 3)")
over("tidy_slice_tail", lambda ds: ds.tbl("part").arrange("price").slice_tail(3).select("size").df, f"SELECT entry AS name, size FROM {PART} ORDER BY price DESC, pos DESC LIMIT 3")
over("tidy_filter_by", lambda ds: ds.tbl("part").filter(lambda over: F.col("price") > over(F.mean("price")), by="brand").select("brand").df, f"SELECT entry AS name, brand FROM (SELECT *, AVG(price) OVER (PARTITION BY brand) AS m FROM {PART}) WHERE price > m")
over("tidy_mutate_by", lambda ds: ds.tbl("part").mutate(by="brand", top=lambda over: over(F.max("price"))).select("top").df, f"SELECT entry AS name, ROUND(MAX(price) OVER (PARTITION BY brand), 4) AS top FROM {PART}")
over("tidy_mutate_used", lambda ds: ds.tbl("part").mutate(keep="used", unit=F.col("price") / F.col("size")).df, f"SELECT entry AS name, size, ROUND(price, 4) AS price, ROUND(price / size, 4) AS unit FROM {PART}")
over("tidy_transmute", lambda ds: ds.tbl("part").transmute(half=F.col("price") / 2).df, f"SELECT entry AS name, ROUND(price / 2, 4) AS half FROM {PART}")
over("tidy_rename_relocate", lambda ds: ds.tbl("part").rename(cost="price").relocate("cost").select("cost", kind="type").df, f"SELECT entry AS name, ROUND(price, 4) AS cost, type AS kind FROM {PART}")
over("tidy_sample_size", lambda ds: ds.tbl("part").slice_sample(7).df.agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(7 AS BIGINT) AS n")
over("tidy_tally", lambda ds: ds.tbl("part").group_by("brand").tally(), f"SELECT brand, COUNT(*) AS n FROM {PART} GROUP BY 1")
over("tidy_reframe", lambda ds: ds.tbl("supplier").reframe(lambda pdf: pdf.nlargest(1, "acctbal")[["nation", "acctbal"]], "nation string, acctbal double", by="nation"), "SELECT n_name AS nation, ROUND(MAX(s_acctbal), 4) AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")


def _computed(ds):
    ds.tbl("part").mutate(unit=F.col("price") / F.col("size")).compute()
    return ds["@ part : unit >> Sum"].df


over("tidy_compute", _computed, f"SELECT ROUND(SUM(price / size), 4) AS value FROM {PART}", 4)
over("frame_of_axis_query", lambda ds: ds.get_dataframe("@ part [ size > 40 ]", ["size"]), f"SELECT entry AS name, size FROM {PART} WHERE size > 40")


# chains, views, contracts, copies
def _layered(ds):
    leaf = Dataset(ds.spark, "leaf")
    both = chain_writer([ds, leaf])
    both.set_vector("part", "net", ds.get_vector("part", "price").select("entry", (F.col("value") * 0.8).alias("value")))
    both.delete_vector("part", "net")
    out = {"deleted": both.has_vector("part", "net"), "leaf": both.is_leaf()}
    other = Dataset(ds.spark, "other")
    other.add_axis("region", ["AFRICA"])
    for what, act in (("earlier", lambda: both.delete_vector("part", "size")), ("axes", lambda: chain_reader([ds, other]))):
        try:
            act()
            out[what] = "done"
        except (KeyError, ValueError):
            out[what] = "refused"
    return out


facts("chain_rules", _layered, {"deleted": False, "leaf": False, "earlier": "refused", "axes": "refused"})
facts("view_rules", lambda ds: {"hidden": viewer(ds, axes={**VIEW_ALL_AXES, "part": None}).has_axis("part"), "kept": viewer(ds, axes=VIEW_ALL_AXES, data={**VIEW_ALL_DATA, ("part", "size"): None}).vectors_set("part")}, {"hidden": False, "kept": "['brand', 'price', 'type']"})


def _judged(ds):
    contract = create_contract("net", [axis_contract("part", RequiredInput)], [contract_vector("part", "price", RequiredInput, "Float64"), contract_vector("part", "weight", OptionalInput), contract_vector("part", "net", GuaranteedOutput, "Float64")])
    seen = Contracted("net", contract, ds)
    out = {}
    for what, act in (("input", lambda: verify_input(seen)), ("output", lambda: verify_output(seen)), ("undeclared", lambda: seen.get_scalar("version")), ("changed input", lambda: seen.set_vector("part", "price", 0.0, True)), ("unused", lambda: (seen.set_vector("part", "net", 1.0), verify_output(seen))), ("used", lambda: (seen.get_vector("part", "price"), verify_output(seen))), ("plain", lambda: verify_contract(contract, ds, True))):
        try:
            act()
            out[what] = "fine"
        except ContractError as e:
            out[what] = str(e).split()[0]
    merged = merge_contracts(contract, create_contract("use", [axis_contract("part", RequiredInput)], [contract_vector("part", "net", RequiredInput)]))
    return out | {"merged": merged.data["part", "net"].expectation, "docs": "part, net: GuaranteedOutput Float64" in contract_docs(merged)}


facts("contract_rules", _judged, {"input": "fine", "output": "missing", "undeclared": "undeclared", "changed input": "the", "unused": "unused", "used": "fine", "plain": "fine", "merged": "GuaranteedOutput", "docs": True})


def _reset(ds):
    reorder_axes(ds, region=[5, 4, 3, 2, 1])
    first = ",".join(ds.axis_entries("region", [1]))
    reset_reorder_axes(ds)
    back = ",".join(ds.axis_entries("region", [1]))
    reorder_axes(ds, region=[5, 4, 3, 2, 1])
    commit_reorder_axes(ds)
    reset_reorder_axes(ds)
    return {"reordered": first, "reset": back, "committed": ",".join(ds.axis_entries("region", [1]))}


facts("reorder_reset", _reset, {"reordered": "MIDDLE EAST", "reset": "AFRICA", "committed": "MIDDLE EAST"})


def _prefixed(ds):
    """Two data sets whose parts have the supplier with the smallest name, concatenated along both axes."""
    out = []
    for name in ("a", "b"):
        one = Dataset(ds.spark, name)
        one.add_axis("supplier", ds.axis_frame("supplier").select("entry", "pos"), check=False)
        one.add_axis("part", ds.axis_frame("part").select("entry", "pos"), check=False)
        least = ds.get_matrix("part", "supplier", "quantity").groupBy(F.col("row").alias("entry")).agg(F.min("col").alias("value"))
        one.set_vector("part", "supplier", least)
        out.append(one)
    to = Dataset(ds.spark, "both")
    concatenate(to, ["part", "supplier"], out, prefix=True)
    return to.get_vector("part", "supplier").select("entry", "value")


over("concat_references", _prefixed, "SELECT d || '.' || p AS entry, CASE WHEN s IS NULL THEN '' ELSE d || '.' || s END AS value FROM (SELECT CAST(p_partkey AS VARCHAR) AS p, (SELECT MIN(CAST(l_suppkey AS VARCHAR)) FROM lineitem WHERE l_partkey = p_partkey) AS s FROM part), (VALUES ('a'), ('b')) t(d)")


def _annotated(ds):
    a = as_anndata(ds, "customer", "priority", "spend")
    return a.X.groupBy("col").agg(F.sum("value").alias("value")).join(a.var.select(F.col("name").alias("col")), "col").select(F.col("col").alias("entry"), "value")


over("annotated_matrix", _annotated, "SELECT o_orderpriority AS entry, ROUND(SUM(o_totalprice), 4) AS value FROM orders GROUP BY 1", 4)


def _annotated_again(ds):
    from .sources.store import shared_folder

    path = f"{shared_folder(ds.spark)}/{uuid.uuid4().hex}"
    write_annotated(ds, path, "customer", "priority", "spend")
    return read_annotated(ds.spark, path)["@ obs @ var :: UMIs -/ segment >- Sum"].df


over("annotated_written_and_read", _annotated_again, f"SELECT segment AS row, col, ROUND(SUM(value), 2) AS value FROM {SPEND} s JOIN {CUSTOMER} c ON s.row = c.entry GROUP BY 1, 2", 2)


# the examples, which no table is read for
def example(name: str, make, query: str, sql: str, digits: int = 6) -> None:
    def run(spark, sf_dir):
        got = make(spark).query(query)
        return rounded(got.dense() if got.kind == "matrix" else got.df, digits)

    register(name, run, sql)


UMIS = "(SELECT c, g, CASE WHEN (c * 31 + g * 17) % 23 < 4 THEN (c * 31 + g * 17) % 23 + 1 ELSE 0 END AS v FROM range(856) t(c), range(683) u(g))"
example("example_cells_lateral", example_cells, "@ gene : is_lateral >> Sum", "SELECT COUNT(*) AS value FROM range(683) t(g) WHERE g % 3 = 0")
example("example_cells_donors", example_cells, "@ cell : donor : age / experiment >> Mean", "SELECT printf('X%03d', c * 5 % 23) AS entry, ROUND(AVG(20 + (c * 7 % 95) * 11 % 60), 6) AS value FROM range(856) t(c) GROUP BY 1")
example("example_cells_umis", example_cells, "@ cell @ gene [ is_lateral ] :: UMIs >| Sum", f"SELECT printf('C%03d', c) AS entry, CAST(SUM(v) AS BIGINT) AS value FROM {UMIS} WHERE g % 3 = 0 GROUP BY 1")
example("example_metacells_colors", example_metacells, "@ metacell : type : color", "SELECT printf('M%03d', m) AS entry, ['steelblue', '#eebb6e', 'plum', 'gold'][m % 4 + 1] AS value FROM range(7) t(m)")
example("example_metacells_edges", example_metacells, "@ metacell :: edge_weight @| M003", "SELECT printf('M%03d', m) AS entry, ROUND(CAST(CAST(1.0 / (1 + abs(m - 3)) AS FLOAT) AS DOUBLE), 6) AS value FROM range(7) t(m)")
example("example_chain_types", example_chain, "@ cell @ gene :: UMIs -/ metacell : type >- Max", f"SELECT ['memory-B', 'MEBEMP-E', 'MEBEMP-L', 'MPP'][(c % 7) % 4 + 1] AS row, printf('G%03d', g) AS col, CAST(MAX(v) AS INTEGER) AS value FROM {UMIS} GROUP BY 1, 2")


# users' operations, errors, copies of several matrices
def refused(acts: dict) -> dict[str, str]:
    """By name, whether an act fails."""
    out = {}
    for what, act in acts.items():
        try:
            act()
            out[what] = "done"
        except Exception:  # noqa: BLE001  any failure will do
            out[what] = "refused"
    return out


def _registered(ds):
    registry.register_query_operation("reduction", "Power", lambda v, p=2.0: F.sum(F.pow(v, F.lit(p))), overwrite=True)
    try:
        return {
            "parameters": sorted(registry.accepted("reduction", "Power")), "value": ds.query("@ region : index >> Power p 3").collect(), "known": "Power" in registry.registered_reductions(), "built in": sorted(registry.accepted("eltwise", "Clamp")),
        } | refused({"again": lambda: registry.register_reduction("Power", F.max), "built in again": lambda: registry.register_eltwise("Abs", F.abs), "unknown parameter": lambda: ds.query("@ region : index >> Power q 3")})
    finally:
        registry.unregister("reduction", "Power")


facts("registry_rules", _registered, {"parameters": "['p', 'type']", "value": 225.0, "known": True, "built in": "['max', 'min', 'type']", "again": "refused", "built in again": "refused", "unknown parameter": "refused"})
facts(
    "errors",
    lambda ds: refused({
        "missing axis": lambda: ds.query("@ absent : x || 1").collect(), "missing vector": lambda: ds.query("@ part : absent").collect(), "missing matrix": lambda: ds.query("@ part @ supplier :: absent").collect(), "missing scalar": lambda: ds.query(". absent").collect(),
        "missing entry": lambda: ds.query(": price @ part = none").collect(), "fraction as whole number": lambda: ds.query("@ part : price % Convert type Int32").collect(), "sum of text": lambda: ds.query("@ part : brand >> Sum").collect(), "sum of nothing": lambda: ds.query("@ part [ size > 1000000 ] : size >> Sum").collect(),
        "no entry": lambda: ds.query("@ part : brand =@ nation : region").collect(), "two names": lambda: ds.query("@ ? ?"), "text after all": lambda: ds.query("@ part )"), "quantile over 1": lambda: ds.query("@ part : size >> Quantile p 2"), "whole number as fraction": lambda: ds.query("@ part : size % Convert type Float64").collect(),
    }),
    {**dict.fromkeys(["missing axis", "missing vector", "missing matrix", "missing scalar", "missing entry", "fraction as whole number", "sum of text", "sum of nothing", "no entry", "two names", "text after all", "quantile over 1"], "refused"), "whole number as fraction": "done"},
)
over("fast_log", lambda ds: ds.get_vector("part", "price").select("entry", fast_log("value", 1.0, 2.0).alias("value")), f"SELECT entry, ROUND(LN(price + 1) / LN(2), 4) AS value FROM {PART}")


def _tensor(ds):
    """The matrices <status>_n (segment x priority), numbers of orders, of which one is not there, copied as one tensor."""
    source, to = Dataset(ds.spark, "source"), Dataset(ds.spark, "to")
    orders = ds.get_dataframe("order", {"status": "status", "priority": "priority", "segment": ": customer : segment"})
    for d in (source, to):
        d.add_axis("status", ["F", "O", "P", "X"])
        d.add_axis("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
        d.add_axis("segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    for status in ("F", "O", "P"):
        source.set_matrix("segment", "priority", f"{status}_n", orders.where(F.col("status") == status).groupBy(F.col("segment").alias("row"), F.col("priority").alias("col")).agg(F.count(F.lit(1)).alias("value")), 0)
    source.set_scalar("kind", "orders")
    copy_scalar(to, source, "kind", rename="what")
    copy_tensor(to, source, "status", "segment", "priority", "n", empty=0)
    assert to.get_scalar("what") == "orders" and empty_data({("a", "b"): 1}) == {"a|b": 1}
    found = [to.query(f"@ segment @ priority :: {s}_n >| Sum").df.select(F.lit(s).alias("status"), "entry", F.col("value").cast("bigint").alias("value")) for s in ("F", "O", "P", "X")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


over("copy_tensor", _tensor, "SELECT s AS status, g AS entry, CAST(COALESCE(n, 0) AS BIGINT) AS value FROM (VALUES ('F'), ('O'), ('P'), ('X')) a(s) CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) b(g) LEFT JOIN (SELECT o_orderstatus, c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) ON o_orderstatus = s AND c_mktsegment = g")
