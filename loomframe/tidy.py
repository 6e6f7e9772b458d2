"""Tidy verbs over one axis, lazily: each adds to a DataFrame whose first column is the entry's name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dataset import Reader, q, vc
from .plans.nodes import is_axis_query, query_axis_name


class UnsupportedOperationError(NotImplementedError):
    """A verb that leaves the axis; use .df, a plain DataFrame, for it."""


def scope_of(ds: Reader, axis: str) -> tuple[str, DataFrame]:
    """An axis's name and frame, of its name or an axis query."""
    if ds.has_axis(axis):
        return axis, ds.axis_frame(axis)
    if not is_axis_query(axis):
        raise KeyError(f"missing axis: {axis} in the data set: {ds.name}")
    name = query_axis_name(axis)
    kept = ds.query(axis).df
    return name, ds.axis_frame(name).join(kept, "entry", "left_semi")


def frame_of(ds: Reader, axis: str, columns: Iterable[str] | Mapping[str, str] | None = None) -> DataFrame:
    """name and a column for each vector (default: all) or query. A query that begins with : or :: or . is about the axis;
    any query must have a value for each row."""
    name, frame = scope_of(ds, axis)
    if columns is None:
        columns = ds.vectors_set(name)
    pairs = list(columns.items()) if isinstance(columns, Mapping) else [c if isinstance(c, tuple) else (c, c) for c in columns]
    out, picked = frame.withColumn("name", F.col("entry")), ["name"]
    for k, (label, query) in enumerate(pairs):
        text = query.lstrip()
        if ds.has_vector(name, query) if text[:1] not in ":.@" else False:
            out = ds.with_vector(name, query, out).withColumn(f"__c{k}", ds.vector_column(name, query))
        else:
            text = f"@ {name} {text}" if text[:1] in ":." else text if text[:1] == "@" else f"@ {name} : {text}"
            got = ds.query(text)
            if got.kind == "vector":
                out = out.join(got.df.select(F.col("entry"), F.col("value").alias(f"__c{k}")), "entry", "left")
                out = out.where(F.when(F.col(f"__c{k}").isNull(), F.raise_error(F.lit(f"rows without a value of {query}")).cast("boolean")).otherwise(F.lit(True)))
            elif got.kind == "scalar":
                out = out.crossJoin(F.broadcast(got.df.select(F.col("value").alias(f"__c{k}"))))  # one row
            else:
                raise ValueError(f"not a vector of the axis {name}: {query}")
        picked.append(F.col(f"__c{k}").alias(label))
    return out.select(*picked)


def references(df: DataFrame, c: Column) -> set[str]:
    """Names of the columns that a column is made of."""
    plan = df.select(c.alias("__c"))._jdf.queryExecution().analyzed()
    found = plan.expressions().head().references().toSeq()
    return {found.apply(k).name() for k in range(found.length())}


def directed(order: Column) -> tuple[Column, bool, bool]:
    """What a column orders by, whether downwards, and whether nulls come first."""
    node = order._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return order, False, False
    jvm = SparkSession.getActiveSession()._jvm
    return type(order)(jvm.org.apache.spark.sql.Column(node.child())), "Descending" in node.sortDirection().toString(), "NullsFirst" in node.nullOrdering().toString()


class Table:
    """An axis (or what verbs made of it): ds, axis (None once rows are no entries), df, groups. Columns that begin with __
    are the axis's order, __pos, and before it what arrange() orders by, with (downwards, nulls first) of each in order."""

    def __init__(self, ds: Reader, axis: str | None, df: DataFrame | None = None, groups: tuple[str, ...] = (), changed: frozenset[str] = frozenset(), whole: bool = True, order: tuple[tuple[bool, bool], ...] = ()):
        self.ds, self.groups, self.changed, self.whole, self.order = ds, groups, changed, whole, order
        if df is None:
            name, frame = scope_of(ds, axis)
            df = frame.select(F.col("entry").alias("name"), F.col("pos").alias("__pos"), *(q(vc(v)).alias(v) for v in ds.vectors_set(name)))
            self.whole = name == axis
            axis = name
        self.axis, self._df = axis, df

    def _with(self, df: DataFrame, **changes) -> Table:
        return Table(self.ds, changes.get("axis", self.axis), df, changes.get("groups", self.groups), changes.get("changed", self.changed), changes.get("whole", self.whole), changes.get("order", self.order))

    def _hidden(self) -> list[str]:
        return [c for c in self._df.columns if c.startswith("__")]

    def _ordered(self, back: bool = False) -> list[Column]:
        """The rows' order, or the reverse."""
        out = []
        for k, (down, nulls) in enumerate(self.order):
            c = q(f"__o{k}")
            out.append((c.desc_nulls_first() if nulls != back else c.desc_nulls_last()) if down != back else (c.asc_nulls_first() if nulls != back else c.asc_nulls_last()))
        return [*out, q("__pos").desc() if back else q("__pos")] if "__pos" in self._df.columns else out

    def _by(self, by) -> list[str]:
        if by is not None and self.groups:
            raise ValueError("both group_by and by")
        return list(self.groups) if by is None else [by] if isinstance(by, str) else list(by)

    @property
    def df(self) -> DataFrame:
        """The plain DataFrame."""
        return self._df.drop(*self._hidden())

    def collect(self):
        """Rows as a pandas DataFrame, in the axis's order or the one arrange set."""
        order = self._ordered()
        return (self._df.orderBy(*order) if order else self._df).drop(*self._hidden()).toPandas()

    as_tibble = collect

    def tbl_vars(self) -> list[str]:
        return self.df.columns

    def group_vars(self) -> list[str]:
        return list(self.groups)

    def group_by(self, *names: str, add: bool = False) -> Table:
        return self._with(self._df, groups=(*self.groups, *names) if add else names)

    def ungroup(self) -> Table:
        return self._with(self._df, groups=())

    def select(self, *names: str, **renamed: str) -> Table:
        """Columns by name, or new=old; the entry's name stays."""
        picked = [n for n in names if n != "name"]
        cols = [q(n) for n in picked] + [q(old).alias(new) for new, old in renamed.items()]
        return self._with(self._df.select(*([q("name")] if "name" in self._df.columns else []), *map(q, self._hidden()), *cols))

    def pull(self, name: str) -> list:
        return self.collect()[name].tolist()

    def filter(self, *conditions: Column | Callable, by=None) -> Table:
        """Rows where all conditions hold: columns, or functions that are given over(), for aggregates of the rows' group
        (that of by or group_by): filter(lambda over: F.col("x") > over(F.mean("x")), by="g")."""
        over, df = partial(self.over, by=by), self._df
        for k, c in enumerate(conditions):
            df = df.withColumn(f"__f{k}", c(over) if callable(c) and not isinstance(c, Column) else c)
        for k in range(len(conditions)):
            df = df.where(F.coalesce(F.col(f"__f{k}"), F.lit(False))).drop(f"__f{k}")
        return self._with(df, whole=False)

    def over(self, aggregate: Column, by=None) -> Column:
        """An aggregate over each row's group, for mutate and filter. Without groups it is over all rows, in one task:
        summarise and join one row instead where there are many."""
        return aggregate.over(Window.partitionBy(*map(q, self._by(by))))

    def _ranked(self, order: list[Column], keys: list[str], rank=F.row_number) -> Column:
        return rank().over(Window.partitionBy(*map(q, keys)).orderBy(*order))

    def slice_head(self, n: int = 1, by=None) -> Table:
        return self._first(self._ordered(), n, by)

    def slice_tail(self, n: int = 1, by=None) -> Table:
        return self._first(self._ordered(back=True), n, by)

    def _first(self, order: list[Column], n: int, by) -> Table:
        keys = self._by(by)
        if not keys:
            return self._with(self._df.orderBy(*order).limit(n), whole=False)
        return self._with(self._df.withColumn("__r", self._ranked(order, keys)).where(F.col("__r") <= n).drop("__r"), whole=False)

    def slice_min(self, column: str, n: int = 1, by=None, with_ties: bool = True) -> Table:
        return self._extreme(q(column).asc_nulls_last(), column, n, by, with_ties)

    def slice_max(self, column: str, n: int = 1, by=None, with_ties: bool = True) -> Table:
        return self._extreme(q(column).desc_nulls_last(), column, n, by, with_ties)

    def _extreme(self, order: Column, column: str, n: int, by, with_ties: bool) -> Table:
        keys = self._by(by)
        if not keys and with_ties:  # the nth value by a bounded sort, then all rows that reach it
            worst = F.max if "ASC" in str(order._jc.toString()) else F.min
            edge = self._df.orderBy(order).limit(n).agg(worst(q(column)).alias("__edge"))
            reach = q(column) <= F.col("__edge") if worst is F.max else q(column) >= F.col("__edge")
            return self._with(self._df.crossJoin(F.broadcast(edge)).where(reach).drop("__edge"), whole=False)  # one row
        if not keys:
            return self._first([order, *self._ordered()], n, None)
        rank = self._ranked([order], keys, F.rank) if with_ties else self._ranked([order, *self._ordered()], keys)
        return self._with(self._df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r"), whole=False)

    def slice_sample(self, n: int = 1, by=None, seed: int = 0) -> Table:
        return self._first([F.xxhash64(q("name"), F.lit(seed)), q("name")], n, by)

    def slice(self, *places: int, by=None) -> Table:
        """Rows at 1-based places of the order, of each group if there are groups."""
        keys, top, order = self._by(by), max(places, default=0), self._ordered()
        head = self._df if keys else self._df.orderBy(*order).limit(top)  # no more than the last place
        ranked = head.withColumn("__r", F.row_number().over((Window.partitionBy(*map(q, keys)) if keys else Window).orderBy(*order)))
        return self._with(ranked.where(F.col("__r").isin(list(places))).drop("__r"), whole=False)

    def arrange(self, *order: Column | str) -> Table:
        """Rows in the order of columns, whatever later verbs make of them; ties keep the order that there was."""
        keys = [directed(q(c) if isinstance(c, str) else c) for c in order]
        old = len(self.order)
        df = self._df.select(*(q(c).alias(f"__o{len(keys) + int(c[3:])}" if c in {f"__o{k}" for k in range(old)} else c) for c in self._df.columns), *(c.alias(f"__o{k}") for k, (c, *_) in enumerate(keys)))
        return self._with(df, order=(*((down, nulls) for _, down, nulls in keys), *self.order))

    def distinct(self, *names: str) -> DataFrame:
        return self.df.select(*map(q, names)).distinct() if names else self.df.distinct()

    def rename(self, **renamed: str) -> Table:
        df = self._df
        for new, old in renamed.items():
            df = df.withColumnRenamed(old, new)
        return self._with(df, changed=self.changed | set(renamed))

    def relocate(self, *names: str, before: str | None = None, after: str | None = None) -> Table:
        rest = [c for c in self._df.columns if c not in names and c != "name" and not c.startswith("__")]
        at = rest.index(before) if before else rest.index(after) + 1 if after else 0
        return self._with(self._df.select(*[c for c in ("name",) if c in self._df.columns], *self._hidden(), *map(q, [*rest[:at], *names, *rest[at:]])))

    def mutate(self, before: str | None = None, after: str | None = None, keep: str = "all", by=None, **columns: Column | Callable) -> Table:
        """New or changed columns: columns, values, or functions that are given over(), as in filter(). keep: all columns, or
        of the others those that are used for them, those that are unused, or none but groups."""
        over, df, used = partial(self.over, by=by), self._df, set()
        for name, c in columns.items():
            c = c(over) if callable(c) and not isinstance(c, Column) else c if isinstance(c, Column) else F.lit(c)
            if keep in ("used", "unused"):
                used |= {x for x in df.columns if not x.startswith("__") and x not in columns} & references(df, c)
            df = df.withColumn(name, c)
        out = self._with(df, changed=self.changed | set(columns))
        if keep == "none":
            return out.select(*self._by(by), *(c for c in columns if c not in self._by(by)))
        if keep in ("used", "unused"):
            return out.select(*(c for c in out.df.columns if c in columns or c in self._by(by) or (c in used) == (keep == "used")))
        return out.relocate(*columns, before=before, after=after) if before or after else out

    def transmute(self, **columns: Column | Callable) -> Table:
        return self.mutate(keep="none", **columns)

    def summarise(self, by=None, **aggregates: Column) -> Table | DataFrame:
        """One row per group. Grouped by one column whose name is an axis's, the result is a table of that axis's entries,
        and fails if a group is no entry."""
        keys = self._by(by)
        cols = [c.alias(n) for n, c in aggregates.items()]
        got = self._df.groupBy(*map(q, keys)).agg(*cols) if keys else self._df.agg(*cols)
        if len(keys) == 1 and self.ds.has_axis(keys[0]):
            entries = self.ds.axis_frame(keys[0]).select(F.col("entry").alias("name"), F.col("pos").alias("__pos"))
            tied = got.withColumnRenamed(keys[0], "name")
            if not tied.join(entries, "name", "left_anti").limit(1).count():
                return Table(self.ds, keys[0], entries.join(tied, "name"), changed=frozenset(aggregates), whole=False)
        return got

    summarize = summarise

    def reframe(self, fn: Callable, schema: str, by=None) -> DataFrame:
        """Any number of rows per group, by a function of a pandas DataFrame; a group must fit a task."""
        keys = self._by(by)
        return self.df.groupBy(*map(q, keys)).applyInPandas(fn, schema)

    def count(self, *names: str, sort: bool = False, name: str = "n") -> DataFrame:
        got = self._df.groupBy(*map(q, (*self.groups, *names))).agg(F.count(F.lit(1)).alias(name))
        return got.orderBy(F.desc(name)) if sort else got

    def tally(self, name: str = "n") -> DataFrame:
        return self.count(name=name)

    def add_count(self, *names: str, name: str = "n") -> Table:
        keys = [*self.groups, *names]
        counts = self._df.groupBy(*map(q, keys)).agg(F.count(F.lit(1)).alias(name)) if keys else self._df.agg(F.count(F.lit(1)).alias(name))
        df = self._df.join(counts, keys) if keys else self._df.crossJoin(F.broadcast(counts))  # one row
        return self._with(df, changed=self.changed | {name})

    def add_tally(self, name: str = "n") -> Table:
        return self.add_count(name=name)

    def compute(self, vectors: Iterable[str] | None = None, overwrite: bool = False) -> Table:
        """Writes changed columns back as vectors; every entry of the axis must have a row."""
        if self.axis is None or (not self.whole and self._df.count() != self.ds.axis_length(self.axis)):
            raise ValueError("a part of the axis cannot be written back")
        for v in sorted(self.changed if vectors is None else vectors):
            self.ds.set_vector(self.axis, v, self._df.select(q("name").alias("entry"), q(v).alias("value")), overwrite)
        return self

    def __getattr__(self, verb: str):
        if verb in ("inner_join", "left_join", "right_join", "full_join", "semi_join", "anti_join", "cross_join", "nest_join", "union", "union_all", "intersect", "setdiff", "rowwise"):
            raise UnsupportedOperationError(f"{verb} is not supported over an axis; use .df")
        raise AttributeError(verb)
