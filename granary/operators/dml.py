"""Inserts, updates and removals as transforms from one state of a bucket to the next, and the rows they change."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.expr import plain
from granary.model import TABLE, Schema, check_columns, wrap_mode
from granary.operators.query import assign, conjuncts, restrict
from granary.plans.compiler import Resolver, Scope, bind, compile_node


def _offered(new: DataFrame, schema: Schema) -> DataFrame:
    """New rows in the bucket's form, with ``_seq``, the order in which they are offered."""
    check_columns(schema, [c for c in new.columns if c != "_seq"])
    seq = F.col("_seq") if "_seq" in new.columns else F.monotonically_increasing_id()
    with wrap_mode(new.sparkSession):
        has = lambda name: F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint")) if name in new.columns else F.lit(0).cast("bigint")
        return new.select(has(TABLE).alias(TABLE), *[f.wrap(has(f.name)).alias(f.name) for f in schema.fields], seq.alias("_seq"))


def _one_each(offered: DataFrame, schema: Schema, last: bool) -> DataFrame:
    """One row for each key: the first offered, or the last."""
    pick = (F.max_by if last else F.min_by)(F.struct(*offered.columns), "_seq")
    return offered.groupBy(TABLE, schema.pk.name).agg(pick.alias("__r")).select("__r.*")


def _matches(query: Any, scope: Scope) -> Column:
    hit = F.lit(True)
    for part in conjuncts(query):
        hit = hit & compile_node(part, scope).condition()
    return hit


def taken(rows: DataFrame, new: DataFrame, schema: Schema, overwrite: bool = False, query: Any = None, resolve: Resolver | None = None) -> DataFrame:
    """The rows that an insert of ``new`` puts in: keys not there yet, with ``overwrite`` also those there with other values.

    With ``query`` rows go in one by one, in the order of ``_seq``, each only if no row of its table matches by then: a table
    that has a match takes nothing, and any other takes rows up to the first that matches itself, and that one.
    """
    key = [TABLE, schema.pk.name]
    offered = _offered(new, schema)
    if not overwrite:
        offered = _one_each(offered, schema, last=False).join(rows.select(*key), key, "left_anti")
    if query is not None:
        offered = offered.join(restrict(rows, query, schema, resolve).select(TABLE).distinct(), TABLE, "left_anti")
        with wrap_mode(rows.sparkSession):
            scope = Scope(schema, resolve)
            hit = _matches(query, scope)
            first = bind(offered, scope).where(hit).groupBy(TABLE).agg(F.min("_seq").alias("__first"))
        offered = offered.join(first, TABLE, "left").where(F.col("__first").isNull() | (F.col("_seq") <= F.col("__first"))).drop("__first")
    if overwrite:
        old = rows.select(*key, F.struct(*schema.names).alias("__old"))
        joined = _one_each(offered, schema, last=True).join(old, key, "left")
        offered = joined.where(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.struct(*schema.names)))
    return offered.select(TABLE, *schema.names)


def insert(rows: DataFrame, new: DataFrame, schema: Schema, overwrite: bool = False, query: Any = None, resolve: Resolver | None = None) -> DataFrame:
    """The bucket with ``new`` rows in it, as far as they are ``taken``."""
    put = taken(rows, new, schema, overwrite, query, resolve)
    kept = rows.join(put.select(TABLE, schema.pk.name), [TABLE, schema.pk.name], "left_anti") if overwrite else rows
    return kept.select(TABLE, *schema.names).unionByName(put)


def modified(rows: DataFrame, new: DataFrame, schema: Schema, overwrite: bool = False) -> DataFrame:
    """For each key offered whether an insert changes the bucket: its key is new, or overwritten by other values."""
    key = [TABLE, schema.pk.name]
    put = taken(rows, new, schema, overwrite).select(*key, F.lit(True).alias("__put"))
    return _offered(new, schema).select(*key).distinct().join(put, key, "left").select(*key, F.coalesce("__put", F.lit(False)).alias("modified"))


def update(rows: DataFrame, updates: dict[str, Any], query: Any, schema: Schema, table: int | None = None, resolve: Resolver | None = None) -> DataFrame:
    """The bucket with assignments made in all rows that match; which do is settled before the first assignment."""
    with wrap_mode(rows.sparkSession):
        scope = Scope(schema, resolve)
        hit = (F.lit(True) if table is None else F.col(TABLE) == table) & _matches(query, scope)
        flagged = bind(rows, scope).withColumn("__hit", hit).select(*rows.columns, "__hit")
        return assign(flagged, plain(updates), schema, resolve, when=F.col("__hit")).drop("__hit")


def updated(rows: DataFrame, updates: dict[str, Any], query: Any, schema: Schema, resolve: Resolver | None = None) -> DataFrame:
    """The matching rows after the assignments."""
    with wrap_mode(rows.sparkSession):
        return assign(restrict(rows, query, schema, resolve), plain(updates), schema, resolve)


def remove(rows: DataFrame, query: Any, schema: Schema, table: int | None = None, resolve: Resolver | None = None) -> DataFrame:
    """The bucket without the rows that match; no query, or an empty map, matches all."""
    with wrap_mode(rows.sparkSession):
        scope = Scope(schema, resolve)
        hit = (F.lit(True) if table is None else F.col(TABLE) == table) & _matches(query, scope)
        return bind(rows, scope).where(~hit).select(*rows.columns)
