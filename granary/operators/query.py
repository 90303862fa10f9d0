"""find and multifind: filters, distinct-on groups, sorts, offsets and limits over the rows of a bucket."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from granary.expr import plain
from granary.model import TABLE, ExprError, Schema, wrap_mode
from granary.plans.compiler import Resolver, Scope, bind, compile_node, named_table, table_ref

#: offset + limit of a search over several tables end here unless ``cap`` says otherwise (None: nowhere).
MULTI_CAP = 100_000


def conjuncts(query: Any) -> list[Any]:
    """The conditions that hold together; bits of integers are not conditions, so only operators that give conditions count."""
    query = plain(query)
    if isinstance(query, list) and query and query[0] == "$and" and all(_is_condition(x) for x in query[1:]):
        return [y for x in query[1:] for y in conjuncts(x)]
    return [] if query is None else [query]


def _all(query: Any, scope: Scope) -> Column:
    """Whether a row meets all conditions."""
    hit = F.lit(True)
    for part in conjuncts(query):
        hit = hit & compile_node(part, scope).condition()
    return hit


def _is_condition(x: Any) -> bool:
    if isinstance(x, (dict, bool)):
        return True
    if not (isinstance(x, list) and x and isinstance(x[0], str)):
        return False
    if x[0] in ("$and", "$or", "$not"):
        return all(map(_is_condition, x[1:]))
    return x[0] in ("$lt", "$lte", "$gt", "$gte", "$eq", "$ne", "$in", "$in_circle", "$in_polygon")


def restrict(df: DataFrame, query: Any, schema: Schema, resolve: Resolver | None = None) -> DataFrame:
    """Rows that match. Membership in a table that must hold (or must not) is a semi join (or anti join)."""
    own = df.columns
    rest = []
    for part in conjuncts(query):
        inner, how = (part[1], "left_anti") if isinstance(part, list) and len(part) == 2 and part[0] == "$not" else (part, "left_semi")
        if isinstance(inner, list) and len(inner) == 3 and inner[0] == "$in" and table_ref(inner[2]):
            scope = Scope(schema, resolve)
            found = named_table(scope, *table_ref(inner[2]))
            key = compile_node(inner[1], scope).integer()
            if not scope.lookups:
                if found:
                    keys = found[0].select(F.col(found[1].pk.name).alias("__key"))
                    df = df.join(keys, key == F.col("__key"), how)
                elif how == "left_semi":
                    df = df.where(F.lit(False))
                continue
        rest.append(part)
    if rest:
        scope = Scope(schema, resolve)
        typed = [compile_node(p, scope).condition() for p in rest]
        df = bind(df, scope)
        for c in typed:
            df = df.where(c)
    return df.select(*own)


def assign(df: DataFrame, updates: dict[str, Any], schema: Schema, resolve: Resolver | None = None, when: Column | None = None) -> DataFrame:
    """Assignments from left to right, each seeing those before it; ``when`` must not depend on the fields."""
    own = df.columns
    for i, (name, value) in enumerate(plain(updates).items()):
        f = schema[name]
        if f.primary_key:
            raise ExprError("a primary key cannot be assigned")
        scope = Scope(schema, resolve, prefix=f"__u{i}_")
        new = f.wrap(compile_node(value, scope).integer())
        df = bind(df, scope)
        df = df.withColumn(name, new if when is None else F.when(when, new).otherwise(F.col(name)))
    return df.select(*own)


def sort_keys(sort: Any) -> list[Any]:
    """A single expression or a list of them."""
    sort = plain(sort)
    if sort is None:
        return []
    single = not isinstance(sort, list) or bool(sort) and isinstance(sort[0], str) and sort[0].startswith("$")
    return [sort] if single else sort


@dataclass(frozen=True)
class Find:
    """A lazy search in one table, or with ``each`` in every table of the bucket by itself. Later settings replace earlier ones."""

    rows: DataFrame
    schema: Schema
    table: int | None = None
    resolve: Resolver | None = None
    query: Any = None
    updates: dict[str, Any] = field(default_factory=dict)
    keep: Any = None
    by: Any = None
    order: Any = None
    skip: int = 0
    most: int | None = None
    key: int | None = None

    def filter(self, *conditions: Any) -> Find:
        return replace(self, keep=conditions[0] if len(conditions) == 1 else ["$and", *map(plain, conditions)])

    def update(self, assignments: dict[str, Any]) -> Find:
        return replace(self, updates=assignments)

    def group(self, expression: Any) -> Find:
        return replace(self, by=expression)

    def sort(self, *keys: Any) -> Find:
        return replace(self, order=keys[0] if len(keys) == 1 else [plain(k) for k in keys])

    def offset(self, n: int) -> Find:
        return replace(self, skip=max(0, n))

    def limit(self, n: int | None) -> Find:
        return replace(self, most=None if n is None or n < 0 else n)

    def __getitem__(self, i: slice | int) -> Any:
        if isinstance(i, slice):
            a, b = i.start or 0, i.stop
            room = None if b is None else max(0, b - a)
            return replace(self, skip=self.skip + a, most=room if self.most is None else self.most if room is None else min(self.most, room))
        return self.offset(self.skip + i).limit(1).items().first()

    def __iter__(self) -> Iterator[Row]:
        """The rows in order, a partition of them at a time."""
        yield from self.items(ordered=True).toLocalIterator()

    def first(self) -> Any:
        return self.limit(1).items().first()

    def _scoped(self) -> DataFrame:
        return self.rows if self.table is None else self.rows.where(F.col(TABLE) == self.table)

    def _matched(self) -> DataFrame:
        return restrict(self._scoped(), self.query, self.schema, self.resolve)

    def _kept(self) -> DataFrame:
        return restrict(assign(self._matched(), self.updates, self.schema, self.resolve), self.keep, self.schema, self.resolve)

    def _ranked(self) -> tuple[DataFrame, list[str]]:
        """Kept rows, or one of each group with ``_count``, with the columns that order them."""
        df, scope = self._kept(), Scope(self.schema, self.resolve)
        keys = [compile_node(k, scope) for k in sort_keys(self.order)]
        group = compile_node(self.by, scope).integer() if self.by is not None else None
        df = bind(df, scope)
        names = [f"__k{i}" for i in range(len(keys))]
        df = df.withColumns({n: k.col if k.kind == "double" else k.number() for n, k in zip(names, keys, strict=True)})
        own = [TABLE, *self.schema.names]
        order = [*names, self.schema.pk.name]
        if group is None:
            return df.select(*own, *names), order
        within = [F.col(TABLE)] if self.table is None else []
        best = F.min_by(F.struct(*own, *names), F.struct(*order))
        grouped = df.withColumn("__g", group).groupBy(*within, "__g").agg(F.count("*").alias("_count"), best.alias("__row"))
        return grouped.select("_count", "__row.*"), order

    def items(self, ordered: bool = False) -> DataFrame:
        """The rows asked for: ``_count`` with a group, then the fields; in order if a sort, an offset or a limit needs it, or if ``ordered``."""
        with wrap_mode(self.rows.sparkSession):
            if self.key is not None:
                return self._scoped().where(F.col(self.schema.pk.name) == self.key).select(*self.schema.names).offset(self.skip).limit(1)
            df, order = self._ranked()
            if ordered or self.order is not None or self.skip or self.most is not None:
                df = df.orderBy(*order)
            if self.skip:
                df = df.offset(self.skip)
            if self.most is not None:
                df = df.limit(self.most)
            return df.select(*(["_count"] if self.by is not None else []), *self.schema.names)

    def each(self) -> DataFrame:
        """The same search in every table of the bucket: order, offset and limit hold within a table."""
        with wrap_mode(self.rows.sparkSession):
            df, order = replace(self, table=None)._ranked()
            place = F.row_number().over(Window.partitionBy(TABLE).orderBy(*order))
            df = df.withColumn("_place", place).where(F.col("_place") > self.skip)
            if self.most is not None:
                df = df.where(F.col("_place") <= self.skip + self.most)
            return df.select(TABLE, *(["_count"] if self.by is not None else []), *self.schema.names, "_place")

    def numbers(self) -> DataFrame:
        """One row: num_items and has_more."""
        spark = self.rows.sparkSession
        with wrap_mode(spark):
            if self.key is not None:
                return spark.range(1).select(F.lit(0).cast("bigint").alias("num_items"), F.lit(False).alias("has_more"))
            scope = Scope(self.schema, self.resolve)
            hit = _all(self.query, scope)
            # one pass: rows are flagged, not filtered, and counted by their flags
            df = bind(self._scoped(), scope).withColumn("__q", hit).select(TABLE, *self.schema.names, "__q")
            df = assign(df, self.updates, self.schema, self.resolve)
            scope = Scope(self.schema, self.resolve, prefix="__n")
            keep = F.col("__q") & _all(self.keep, scope)
            group = compile_node(self.by, scope).integer() if self.by is not None else None
            df = bind(df, scope)
            number = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
            groups = F.lit(None).cast("bigint") if group is None else F.count_distinct(F.when(keep, group))
            all_ = df.agg(F.count("*").alias("t"), number(F.col("__q")).alias("q"), number(keep).alias("f"), *([] if group is None else [groups.alias("g")]))
            if group is None:
                all_ = all_.withColumn("g", groups)
            end = F.col("t") if self.most is None and not self.skip else F.least(F.col("t"), F.lit(2**62 if self.most is None else self.skip + self.most))
            shown = F.coalesce("g", "f")
            items = F.when(F.col("g").isNotNull(), F.col("q") - F.col("f") + F.col("g")).otherwise(F.col("q"))
            return all_.select(items.cast("bigint").alias("num_items"), (shown > end).alias("has_more"))

    def count(self) -> int:
        return self.numbers().first()["num_items"]

    def has_more(self) -> bool:
        return self.numbers().first()["has_more"]


def find(rows: DataFrame, schema: Schema, table: int | None = 0, *queries: Any, pk: int | None = None, resolve: Resolver | None = None) -> Find:
    """A search; several queries must all hold."""
    query = None if not queries else queries[0] if len(queries) == 1 else ["$and", *map(plain, queries)]
    return Find(rows, schema, table, resolve, plain(query), key=pk)


@dataclass(frozen=True)
class MultiFind:
    """A search merged from several tables, by descending primary key; a table listed twice counts twice."""

    rows: DataFrame
    schema: Schema
    tables: tuple[int, ...]
    query: Any = None
    resolve: Resolver | None = None
    skip: int = 0
    most: int | None = None
    cap: int | None = MULTI_CAP

    @property
    def _end(self) -> int | None:
        ends = [x for x in (self.cap, None if self.most is None else self.skip + self.most) if x is not None]
        return min(ends) if ends else None

    def _listed(self) -> DataFrame:
        distinct = sorted(set(self.tables))
        rows = self.rows.where(F.col(TABLE).isin(*distinct)) if distinct else self.rows.where(F.lit(False))
        if len(distinct) == len(self.tables):
            return rows
        times = [F.when(F.col(TABLE) == t, F.lit(self.tables.count(t))) for t in distinct]
        return rows.withColumn("__again", F.explode(F.sequence(F.lit(1), F.coalesce(*times)))).drop("__again")

    def items(self) -> DataFrame:
        with wrap_mode(self.rows.sparkSession):
            df = restrict(self._listed(), self.query, self.schema, self.resolve)
            df = df.orderBy(F.col(self.schema.pk.name).desc(), TABLE)
            if self.skip:
                df = df.offset(self.skip)
            if self._end is not None:
                df = df.limit(max(0, self._end - self.skip))
            return df.select(TABLE, *self.schema.names)

    def numbers(self) -> DataFrame:
        """One row: num_items (rows of the listed tables, whatever the query) and has_more."""
        with wrap_mode(self.rows.sparkSession):
            scope = Scope(self.schema, self.resolve)
            hit = _all(self.query, scope)
            both = bind(self._listed(), scope).agg(F.count("*").alias("num_items"), F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).alias("m"))
            return both.select("num_items", (F.lit(False) if self._end is None else F.col("m") > self._end).alias("has_more"))

    def count(self) -> int:
        return self.numbers().first()["num_items"]

    def has_more(self) -> bool:
        return self.numbers().first()["has_more"]


def multifind(rows: DataFrame, schema: Schema, tables: list[int], query: Any = None, offset: int = 0, limit: int | None = None, resolve: Resolver | None = None, cap: int | None = MULTI_CAP) -> MultiFind:
    return MultiFind(rows, schema, tuple(tables), plain(query), resolve, max(0, offset), None if limit is None or limit < 0 else limit, cap)


def evaluate(spark, expression: Any) -> DataFrame:
    """The value of a constant expression, one row."""
    with wrap_mode(spark):
        return spark.range(1).select(compile_node(expression, Scope()).integer().alias("value"))


def project(rows: DataFrame, schema: Schema, resolve: Resolver | None = None, /, **expressions: Any) -> DataFrame:
    """Table, primary key and the values of expressions for every row."""
    with wrap_mode(rows.sparkSession):
        scope = Scope(schema, resolve)
        typed = {n: compile_node(e, scope).integer() for n, e in expressions.items()}
        df = bind(rows, scope)
        return df.select(TABLE, schema.pk.name, *[c.alias(n) for n, c in typed.items()])


def nearby(rows: DataFrame, schema: Schema, point: str, centre: int, metres: int = 200, limit: int = 20) -> DataFrame:
    """The rows within ``metres`` of a point, nearest first; the latitude band prunes before distances are taken."""
    from granary.functions import geo

    with wrap_mode(rows.sparkSession):
        near = rows.where(geo.in_circle(F.col(point), centre, metres)).withColumn("distance", geo.distance(F.col(point), F.lit(centre)))
        return near.orderBy("distance", schema.pk.name, TABLE).limit(limit).select(TABLE, *schema.names, "distance")
