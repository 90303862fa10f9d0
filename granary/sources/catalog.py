"""Buckets on storage: versioned schemas, snapshots of rows, a change log, and admin commands.

A bucket is a folder of JSON and Parquet that any Hadoop file system can hold.  A commit writes its changes alone, as
``log/<n>``, and then its pointer ``current/<n>``; ``rows/<n>`` is a snapshot of all rows clustered by table and key, written
now and then (``compact``).  Readers merge the last snapshot with the changes since, so they see whole commits only and a
filter reaches the scan of the snapshot.  One writer at a time.

Every change has a position of its own: the number of its commit, then its place in it: the task that wrote it and, without
gaps, its row there.  A commit's pointer says how many changes each task wrote, so where a page of the feed ends is reckoned
from pointers alone, and a page, or all of them, is read by its positions.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.model import TABLE, DataError, GranaryError, Schema
from granary.operators import dml
from granary.operators.query import Find, MultiFind, find, multifind, restrict
from granary.streaming import changelog

#: Bits of a position: those below COMMIT tell changes of a commit apart, of them those below PART the changes of one task.
COMMIT, PART = 42, 28
#: Commits after which the next one writes a snapshot.
COMPACT = 16
#: Where the catalog itself logs what no bucket can: that it was dropped.
COMMANDS = "_commands"
#: In a pointer: position of the first change of each task that wrote any, and how many these are.
SIZES = "sizes array<struct<first: bigint, n: bigint>>"


class BucketMissing(GranaryError):
    pass


class Catalog:
    def __init__(self, spark: SparkSession, root: str, compact_after: int | None = COMPACT):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after
        self.counters = {"num_commands": 0, "num_scans": 0, "num_disk_reads": 0, "num_disk_writes": 0}
        self.pinned: dict[str, int] = {}
        self._counted = -1

    # files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self, path: str) -> list[int]:
        """The numbered tables of a folder that were written to the end; one look at the file system."""
        fs, p = self._fs(f"{path}/*/_SUCCESS")
        found = fs.globStatus(p) or []
        return sorted(int(n) for n in (s.getPath().getParent().getName() for s in found) if n.isdigit())

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _path(self, bucket: str) -> str:
        return f"{self.root}/{bucket}"

    # schemas
    def alter_bucket(self, bucket: str, *fields: Any) -> Schema:
        """Creates a bucket or gives it a schema that its rows can be read by."""
        self.counters["num_commands"] += 1
        return self._alter(bucket, Schema.of(*fields))

    def _alter(self, bucket: str, new: Schema) -> Schema:
        self._free(bucket)
        have = self._versions(f"{self._path(bucket)}/schema")
        if have:
            self.schema(bucket).check_upgrade(new)
        version = (have[-1] + 1) if have else 0
        self.spark.createDataFrame([(new.to_json(),)], "json string").coalesce(1).write.mode("overwrite").json(f"{self._path(bucket)}/schema/{version}")
        told = self.spark.createDataFrame([("alter", new.to_json())], "op string, query string")
        self._commit(bucket, self._change(told, new), base=None if have else self.spark.createDataFrame([], new.struct()))
        return new

    def schema(self, bucket: str) -> Schema:
        have = self._versions(f"{self._path(bucket)}/schema")
        if not have:
            raise BucketMissing(bucket)
        return Schema.from_json(self.spark.read.schema("json string").json(f"{self._path(bucket)}/schema/{have[-1]}").first()["json"])

    def describe(self, bucket: str) -> DataFrame:
        self.counters["num_commands"] += 1
        return self.schema(bucket).describe(self.spark)

    def fields(self, bucket: str) -> list[str]:
        """The names of a bucket's fields."""
        return self.schema(bucket).names

    def list_buckets(self) -> list[str]:
        self.counters["num_commands"] += 1
        return [n for n in self._names(self.root) if self._versions(f"{self.root}/{n}/schema")]

    def drop_bucket(self, bucket: str) -> None:
        """Removes a bucket with its data; ``commands`` remembers it."""
        self.counters["num_commands"] += 1
        self._free(bucket)
        at = f"{self.root}/{COMMANDS}"
        version = max(self._versions(at), default=-1) + 1
        self.spark.createDataFrame([("drop", bucket, int(time.time()))], "op string, bucket string, written bigint").coalesce(1).write.json(f"{at}/{version}")
        self._delete(self._path(bucket))

    def commands(self) -> DataFrame:
        """op, bucket and written (epoch seconds) of what was done to whole buckets."""
        at = f"{self.root}/{COMMANDS}"
        schema, have = "op string, bucket string, written bigint", self._versions(at)
        return self.spark.read.schema(schema).json([f"{at}/{v}" for v in have]) if have else self.spark.createDataFrame([], schema)

    # rows
    def version(self, bucket: str) -> int:
        have = self._versions(f"{self._path(bucket)}/current")
        if not have:
            raise BucketMissing(bucket)
        return self.pinned.get(bucket, have[-1])

    def rows(self, bucket: str) -> DataFrame:
        """The current rows by the current schema."""
        at = self.version(bucket)
        path, schema = self._path(bucket), self.schema(bucket)
        base = max(v for v in self._versions(f"{path}/rows") if v <= at)
        since = [v for v in self._versions(f"{path}/log") if base < v <= at]
        self.counters["num_disk_reads"] += 1 + len(since)
        stored = self.spark.read.parquet(f"{path}/rows/{base}")
        kept = {f.name: f.metadata for f in stored.schema.fields}
        same = all(kept.get(f.name) == f.metadata for f in schema.struct().fields)
        # rows of the current schema are taken as they lie, so that filters on them reach the scan
        rows = stored.select(TABLE, *schema.names) if same else schema.conform(stored)
        return changelog.merge(rows, changelog.last_changes(self._changes(bucket, schema, since), schema), schema) if since else rows

    def _changes(self, bucket: str, schema: Schema, versions: list[int]) -> DataFrame:
        """The changes of some commits by the current schema."""
        own = f"position bigint, op string, {TABLE} bigint, {', '.join(f'`{n}` bigint' for n in schema.names)}, query string"
        found = self.spark.read.schema(own).parquet(*[f"{self._path(bucket)}/log/{v}" for v in versions])
        return found.select("position", "op", TABLE, *[F.when(F.col(schema.pk.name).isNull(), F.col(n)).otherwise(f.wrap(F.coalesce(F.col(n), F.lit(0).cast("bigint")))).alias(n) for n, f in zip(schema.names, schema.fields, strict=True)], "query")

    def resolve(self, bucket: str, table: int) -> tuple[DataFrame, Schema] | None:
        """A table that an expression names."""
        try:
            return self.rows(bucket).where(F.col(TABLE) == table), self.schema(bucket)
        except BucketMissing:
            return None

    def _free(self, bucket: str) -> None:
        if bucket in self.pinned:
            raise GranaryError(f"{bucket} is frozen")

    def _change(self, df: DataFrame, schema: Schema, op: str | None = None) -> DataFrame:
        """``df`` in the form of the log: op, _table, the fields and query, null where it has none."""
        own = [(TABLE, "bigint"), *((n, "bigint") for n in schema.names), ("query", "string")]
        kind = F.col("op") if op is None else F.lit(op)
        return df.select(kind.alias("op"), *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in own])

    def _commit(self, bucket: str, change: DataFrame, base: DataFrame | None = None, applied: int | None = None) -> int | None:
        """Writes a change, with ``base`` a snapshot of all rows after it too; None if nothing changes."""
        self._free(bucket)
        path, schema = self._path(bucket), self.schema(bucket)
        pk, have = schema.pk.name, self._versions(f"{path}/current")
        version = (have[-1] + 1) if have else 0
        # removals of a whole table have no key and come before the rows put into it
        ordered = change.repartitionByRange(TABLE, pk).sortWithinPartitions(TABLE, pk)
        nth = F.monotonically_increasing_id()
        part, row = F.shiftright(nth, 33), nth.bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
        fits = (part < 1 << (COMMIT - PART)) & (row < 1 << PART)
        place = F.when(fits, F.lit(version << COMMIT).cast("bigint") + F.shiftleft(part, PART) + row).otherwise(F.raise_error(F.lit("too many changes in one task for their positions")))
        ordered.withColumn("position", place).write.mode("overwrite").parquet(f"{path}/log/{version}")
        self.counters["num_disk_writes"] += 1
        sizes = self._counted_sizes(f"{path}/log/{version}")
        if base is None and applied is None and not sizes:
            self._delete(f"{path}/log/{version}")
            return None
        if base is not None:
            self._snapshot(bucket, base, schema, version)
        done = self.applied(bucket) if applied is None and have else -1 if applied is None else applied
        self.spark.createDataFrame([(version, int(time.time()), done, sizes)], f"version bigint, written bigint, applied bigint, {SIZES}").coalesce(1).write.mode("overwrite").json(f"{path}/current/{version}")
        if base is None and self.compact_after is not None and version - max(self._versions(f"{path}/rows")) >= self.compact_after:
            self.compact(bucket)
        return version

    def _counted_sizes(self, path: str) -> list[tuple[int, int]]:
        """For each task that wrote changes of a commit the position of its first and their number, in order."""
        found = self.spark.read.schema("position bigint").parquet(path).groupBy(F.shiftright("position", PART).alias("p")).agg(F.count("*").alias("n"))
        return sorted((r["p"] << PART, r["n"]) for r in found.collect())

    def _snapshot(self, bucket: str, rows: DataFrame, schema: Schema, version: int) -> None:
        shaped = rows.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in schema.struct().fields])
        shaped.repartitionByRange(TABLE, schema.pk.name).sortWithinPartitions(TABLE, schema.pk.name).write.mode("overwrite").parquet(f"{self._path(bucket)}/rows/{version}")
        self.counters["num_disk_writes"] += 1

    def compact(self, bucket: str) -> int:
        """Writes a snapshot of the current rows."""
        version = self.version(bucket)
        if version not in self._versions(f"{self._path(bucket)}/rows"):
            self._snapshot(bucket, self.rows(bucket), self.schema(bucket), version)
        return version

    def vacuum(self, bucket: str) -> list[int]:
        """Removes the snapshots before the last one, of which readers must be done; changes stay for the feed."""
        self._free(bucket)
        old = self._versions(f"{self._path(bucket)}/rows")[:-1]
        for v in old:
            self._delete(f"{self._path(bucket)}/rows/{v}")
        return old

    def find(self, bucket: str, table: int, *queries: Any, pk: int | None = None) -> Find:
        self.counters["num_commands"] += 1
        return find(self.rows(bucket), self.schema(bucket), table, *queries, pk=pk, resolve=self.resolve)

    def multifind(self, bucket: str, tables: list[int], query: Any = None, offset: int = 0, limit: int | None = None, **cap: int | None) -> MultiFind:
        self.counters["num_commands"] += 1
        return multifind(self.rows(bucket), self.schema(bucket), tables, query, offset, limit, resolve=self.resolve, **cap)

    def _table(self, bucket: str, table: int) -> DataFrame:
        return self.rows(bucket).where(F.col(TABLE) == table)

    def insert(self, bucket: str, table: int | None, data: DataFrame | dict[str, Any] | list[dict[str, Any]], overwrite: bool = False, query: Any = None) -> bool:
        """Whether the bucket changed. Without ``table`` the data has a ``_table`` of its own."""
        self.counters["num_commands"] += 1
        schema = self.schema(bucket)
        if not isinstance(data, DataFrame):
            data = self._frame(data, schema)
        rows = self.rows(bucket)
        if table is not None:
            data, rows = data.withColumn(TABLE, F.lit(table).cast("bigint")), rows.where(F.col(TABLE) == table)
        put = dml.taken(rows, data, schema, overwrite, query, self.resolve)
        return self._commit(bucket, self._change(put, schema, "upsert")) is not None

    def _frame(self, data: dict[str, Any] | list[dict[str, Any]], schema: Schema) -> DataFrame:
        rows = [data] if isinstance(data, dict) else data
        names = sorted({k for r in rows for k in r})
        for r in rows:
            for k, v in r.items():
                if v is not None and not isinstance(v, (int, bool)):
                    raise DataError(f"{k}: {v!r} is no integer")
        plain = [[0 if r.get(n) is None else -1 if r[n] is True else schema[n].wrap_int(int(r[n])) if n in schema.names else 0 for n in names] + [i] for i, r in enumerate(rows)]
        return self.spark.createDataFrame(plain, ", ".join([f"`{n}` bigint" for n in names] + ["_seq bigint"]))

    def update(self, bucket: str, table: int, query: Any, updates: dict[str, Any]) -> DataFrame:
        """Makes the assignments in all matching rows and returns these rows as they are then."""
        self.counters["num_commands"] += 1
        schema = self.schema(bucket)
        done = dml.updated(self._table(bucket, table), updates, query, schema, self.resolve)
        version = self._commit(bucket, self._change(done, schema, "upsert"))
        if version is None:
            return self.spark.createDataFrame([], schema.struct())
        return self._changes(bucket, schema, [version]).select(TABLE, *schema.names)

    def remove(self, bucket: str, table: int, query: Any = None) -> bool:
        """Whether any row was removed."""
        self.counters["num_commands"] += 1
        schema = self.schema(bucket)
        gone = restrict(self._table(bucket, table), query, schema, self.resolve)
        return self._commit(bucket, self._change(gone, schema, "remove")) is not None

    def list_tables(self, bucket: str, after: int | None = None, limit: int = 1024) -> DataFrame:
        """Ids of the tables that have rows, ascending, a page at a time."""
        self.counters["num_commands"] += 1
        ids = self.rows(bucket).select(TABLE).distinct()
        return (ids if after is None else ids.where(F.col(TABLE) > after)).orderBy(TABLE).limit(limit)

    def table_ids(self, bucket: str) -> DataFrame:
        """Ids of all tables that have rows, in one pass and no order."""
        self.counters["num_commands"] += 1
        return self.rows(bucket).select(TABLE).distinct()

    def tables(self, bucket: str, page: int = 1024) -> Iterator[int]:
        """The ids of all tables, ascending: one pass, whose result is fetched a partition at a time, whatever ``page`` a caller of ``list_tables`` would take."""
        yield from (r[0] for r in self.table_ids(bucket).orderBy(TABLE).toLocalIterator())

    def get_raw(self, bucket: str, table: int) -> bytes:
        """The packed records of one table, for tables that fit the caller; ``rawcodec.export_tables`` serves the rest."""
        from granary.sources.rawcodec import export_tables

        self.counters["num_commands"] += 1
        found = export_tables(self._table(bucket, table), self.schema(bucket)).orderBy("chunk").collect()
        return b"".join(bytes(r["data"]) for r in found)

    def set_raw(self, bucket: str, table: int, data: bytes) -> None:
        """Replaces a table by packed records; of records that share a key the last counts."""
        from granary.sources.rawcodec import import_tables

        self.counters["num_commands"] += 1
        schema = self.schema(bucket)
        new = import_tables(self.spark.createDataFrame([(table, bytearray(data))], f"{TABLE} bigint, data binary"), schema)
        pick = F.max_by(F.struct(*new.columns), "__n")
        new = new.withColumn("__n", F.monotonically_increasing_id()).groupBy(TABLE, schema.pk.name).agg(pick.alias("r")).select("r.*")
        clear = self.spark.createDataFrame([("remove", table, "{}")], f"op string, {TABLE} bigint, query string")
        change = self._change(clear, schema).unionByName(self._change(new, schema, "upsert"))
        self._commit(bucket, change, base=self.rows(bucket).where(F.col(TABLE) != table).unionByName(new))

    # change feed
    def _sizes(self, bucket: str, after: int) -> Iterator[tuple[int, int]]:
        """First position and number of the changes of each task, from the one that wrote position ``after`` on; some pointers at a time."""
        path = self._path(bucket)
        versions = [v for v in self._versions(f"{path}/current") if v >= after >> COMMIT]
        for at in range(0, len(versions), 256):
            some = versions[at : at + 256]
            told = {r["version"]: r["sizes"] for r in self.spark.read.schema(f"version bigint, {SIZES}").json([f"{path}/current/{v}" for v in some]).collect()}
            for v in some:
                # pointers of before do not tell
                sizes = self._counted_sizes(f"{path}/log/{v}") if told[v] is None else told[v]
                yield from ((first, n) for first, n in sizes if first + n - 1 > after)

    def ends(self, bucket: str, after: int = -1, limit: int = 512) -> Iterator[int]:
        """The last positions of the pages that ``feed`` gives one after the other, without a look at the changes."""
        room, last = limit, after
        for first, n in self._sizes(bucket, after):
            at = max(first, after + 1)
            while at < first + n:
                last = min(at + room, first + n) - 1
                room -= last + 1 - at
                at = last + 1
                if not room:
                    yield last
                    room = limit
        if room < limit:
            yield last

    def changes(self, bucket: str, after: int = -1, upto: int | None = None) -> DataFrame:
        """Changes after a position, up to and with another, in no order."""
        path = self._path(bucket)
        versions = [v for v in self._versions(f"{path}/current") if v >= after >> COMMIT and (upto is None or v <= upto >> COMMIT)]
        if not versions:
            empty = self._change(self.spark.createDataFrame([], "op string"), self.schema(bucket))
            return empty.select(F.lit(0).cast("bigint").alias("position"), *empty.columns)
        found = self._changes(bucket, self.schema(bucket), versions).where(F.col("position") > after)
        return found if upto is None else found.where(F.col("position") <= upto)

    def log(self, bucket: str, after: int = -1, limit: int | None = 512) -> DataFrame:
        """Changes after a position in order, at most ``limit`` of them; the largest position of a page is where the next begins."""
        self.counters["num_commands"] += 1
        upto = next(self.ends(bucket, after, 1 if limit is None else limit), None)
        if upto is None:
            raise GranaryError("no changes after that position")
        return self.changes(bucket, after, None if limit is None else upto).orderBy("position")

    def feed(self, bucket: str, after: int = -1, limit: int = 512) -> tuple[DataFrame, int]:
        """A page of changes and the position to ask for the next page with; an empty page at the end."""
        self.counters["num_commands"] += 1
        upto = next(self.ends(bucket, after, limit), after)
        return self.changes(bucket, after, upto).orderBy("position"), upto

    def pages(self, bucket: str, after: int = -1, limit: int = 512) -> DataFrame:
        """All changes after a position with the number, from 0, of the page in which ``feed`` would give them: one scan for all pages."""
        self.counters["num_commands"] += 1
        before, starts = 0, []
        for first, n in self._sizes(bucket, after):
            skipped = max(0, after + 1 - first)
            starts.append((first >> PART, before - skipped))
            before += n - skipped
        found, part = self.changes(bucket, after), F.shiftright("position", PART)
        own = self.spark.createDataFrame(starts, "__part bigint, __start bigint")
        nth = F.col("__start") + F.col("position").bitwiseAND(F.lit((1 << PART) - 1).cast("bigint"))
        return found.join(F.broadcast(own), part == F.col("__part")).select(F.floor(nth / limit).alias("_page"), *found.columns)

    def applied(self, bucket: str) -> int:
        """The position up to which changes of another catalog were replayed here; -1 for none."""
        at = self._versions(f"{self._path(bucket)}/current")
        return self.spark.read.schema("applied bigint").json(f"{self._path(bucket)}/current/{at[-1]}").first()["applied"] if at else -1

    def replay(self, bucket: str, changes: DataFrame) -> int:
        """Applies a page of another catalog's changes as one commit together with its position, which is returned; what was applied before is skipped."""
        self.counters["num_commands"] += 1
        done = self.applied(bucket)
        new = changes.where(F.col("position") > done)
        last = new.agg(F.max("position")).first()[0]
        if last is None:
            return done
        for r in new.where("op = 'alter'").orderBy("position").select("query").collect():  # one a change of schema
            if not self._versions(f"{self._path(bucket)}/schema") or self.schema(bucket).to_json() != r["query"]:
                self._alter(bucket, Schema.from_json(r["query"]))
        schema = self.schema(bucket)
        missing = [n for n in schema.names if n not in new.columns]
        new = new.withColumns({n: F.lit(0).cast("bigint") for n in missing}) if missing else new
        net = changelog.net_changes(self.rows(bucket), new, schema, done, self.resolve)
        self._commit(bucket, self._change(net, schema), applied=last)
        return last

    def catch_up(self, bucket: str, source: Catalog, limit: int = 512) -> int:
        """Replays the pages of another catalog's feed from the position applied here to its end, which is returned.

        A commit takes twice the pages of the one before: as many commits as the number of pages has binary digits, and
        after a stop at most the last half is to be done again.
        """
        done, many = self.applied(bucket), 1
        ends = source.ends(bucket, done, limit)
        while upto := deque(islice(ends, many), maxlen=1):
            done, many = self.replay(bucket, source.changes(bucket, done, upto[0])), 2 * many
        return done

    def set_position(self, bucket: str, position: int) -> None:
        """Has a bucket that has replayed nothing yet begin after ``position``, for one that was copied by other means."""
        self.counters["num_commands"] += 1
        if self.applied(bucket) != -1:
            raise GranaryError("the bucket has a position already")
        schema = self.schema(bucket)
        self._commit(bucket, self._change(self.spark.createDataFrame([], "op string"), schema), applied=position)

    # admin
    def stats(self) -> dict[str, int]:
        """num_commands, num_disk_reads and num_disk_writes (tables opened and written) and num_scans: rows that scans of this catalog's files gave."""
        store = self.spark._jsparkSession.sharedState().statusStore()
        runs = store.executionsList()
        for i in range(runs.size()):
            run = runs.apply(i)
            if run.executionId() > self._counted and run.completionTime().isDefined():
                values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
                for k in range(nodes.size()):
                    node = nodes.apply(k)
                    if node.name().startswith("Scan parquet") and self.root.removeprefix("file:").lstrip("/") in node.desc():
                        for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                                self.counters["num_scans"] += int(values.apply(m.accumulatorId()).replace(",", ""))
        self._counted = max([self._counted, *(runs.apply(i).executionId() for i in range(runs.size()) if runs.apply(i).completionTime().isDefined())])
        return dict(self.counters)

    def freeze(self, bucket: str) -> int:
        """Pins the current version; commits fail until ``thaw``."""
        self.pinned[bucket] = self.version(bucket)
        return self.pinned[bucket]

    def thaw(self, bucket: str) -> None:
        self.pinned.pop(bucket, None)
