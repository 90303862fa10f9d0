"""Change logs: rows (position, op, _table, key and fields, query) replayed on a bucket, in batches or as a stream.

``upsert`` carries a row's new image; ``remove`` a row, or with ``query`` (JSON) all rows of its table that match; ``alter``
a schema, which ``Catalog.replay`` applies.  A row stands or falls by its last image alone: it is there if that is an upsert
(or it was there before) and no later removal by query matches it.  So a batch is reduced to the last change of each key
and the last position of each removal, and costs one join with either, however many there are.
Changes at or below the position already applied are skipped, so a batch delivered again does nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from granary.model import TABLE, Schema, wrap_mode
from granary.operators.dml import _matches
from granary.plans.compiler import Resolver, Scope, bind


def last_changes(log: DataFrame, schema: Schema) -> DataFrame:
    """The last change of each key: position, op, _table and the fields."""
    own = log.where(F.col("query").isNull() & F.col("op").isin("upsert", "remove"))
    last = own.groupBy(TABLE, schema.pk.name).agg(F.max_by(F.struct("position", "op", *[c for c in schema.names if c != schema.pk.name]), "position").alias("c"))
    return last.select(TABLE, schema.pk.name, "c.*").select("position", "op", TABLE, *schema.names)


def merge(rows: DataFrame, changes: DataFrame, schema: Schema) -> DataFrame:
    """``rows`` with one change for each key: filters reach the scan of ``rows``, which are not shuffled if the changes are few."""
    key = [TABLE, schema.pk.name]
    kept = rows.join(changes.select(*key), key, "left_anti").select(TABLE, *schema.names)
    return kept.unionByName(changes.where(F.col("op") == "upsert").select(TABLE, *schema.names))


def net_changes(rows: DataFrame, log: DataFrame, schema: Schema, after: int = -1, resolve: Resolver | None = None) -> DataFrame:
    """What the changes above position ``after`` come to: position, op, _table and fields, one for each key."""
    log = log.where(F.col("position") > after)
    last = last_changes(log, schema)
    gone = log.where((F.col("op") == "remove") & F.col("query").isNotNull())
    queries = [r["query"] for r in gone.select("query").distinct().orderBy("query").collect()]  # different predicates, not removals
    if not queries:
        return last
    number = F.element_at(F.create_map(*[x for i, q in enumerate(queries) for x in (F.lit(q), F.lit(i))]), F.col("query"))
    by_table = gone.groupBy(TABLE, number.alias("q")).agg(F.max("position").alias("p")).groupBy(TABLE).agg(F.map_from_entries(F.collect_list(F.struct("q", "p"))).alias("__gone"))
    key = [TABLE, schema.pk.name]
    held = rows.join(last.select(*key), key, "left_anti").select(F.lit(after).cast("bigint").alias("position"), F.lit("upsert").alias("op"), F.lit(False).alias("__new"), TABLE, *schema.names)
    every = held.unionByName(last.withColumn("__new", F.lit(True))).join(by_table, TABLE, "left")
    with wrap_mode(rows.sparkSession):
        scope = Scope(schema, resolve)
        dead = F.lit(False)
        for i, q in enumerate(queries):
            later = F.coalesce(F.element_at("__gone", F.lit(i)) > F.col("position"), F.lit(False))
            dead = dead | later & _matches(json.loads(q), scope)
        marked = bind(every, scope).withColumn("__dead", dead)
    out = marked.where(F.col("__new") | F.col("__dead")).withColumn("op", F.when(F.col("__dead"), F.lit("remove")).otherwise(F.col("op")))
    return out.select("position", "op", TABLE, *schema.names)


def replay(rows: DataFrame, log: DataFrame, schema: Schema, after: int = -1, resolve: Resolver | None = None) -> DataFrame:
    """The bucket after the changes above position ``after``, in order."""
    return merge(rows, net_changes(rows, log, schema, after, resolve), schema)


def position(log: DataFrame) -> DataFrame:
    """One row: the last position and how many changes there are."""
    return log.agg(F.max("position").alias("position"), F.count("*").alias("changes"))


def follow(stream: DataFrame, load: Callable[[], tuple[DataFrame, int]], save: Callable[[DataFrame, int], None], schema: Schema, checkpoint: str) -> DataStreamWriter:
    """A stream of changes applied batch by batch; ``load`` gives rows and position so far, ``save`` stores both together."""

    def step(batch: DataFrame, _: int) -> None:
        rows, done = load()
        last = batch.agg(F.max("position").alias("p")).first()["p"]
        if last is not None and last > done:
            save(replay(rows, batch, schema, done), last)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
