"""Schemas, packed records, inserts to removals, storage and change logs."""

import os

import pytest
from pyspark.sql import functions as F

from granary.expr import T
from granary.model import TABLE, DataError, Field, GranaryError, Schema, SchemaError
from granary.operators import dml
from granary.sources import rawcodec
from granary.sources.catalog import BucketMissing, Catalog
from granary.streaming import changelog

PHOTO = Schema.of(Field("photo_id", 58, primary_key=True), Field("location_id", 56), Field("is_private", 1, signed=True), Field("created", 32))


def test_schema_rules():
    ok = list(PHOTO.fields)
    PHOTO.check_upgrade(Schema.of(*ok, Field("likes", 20)))
    PHOTO.check_upgrade(Schema.of(Field("photo_id", 60, primary_key=True), *ok[1:]))
    for bad in (Schema.of(*ok[:3]), Schema.of(Field("p", 58, primary_key=True), *ok[1:], Field("photo_id", 5)), Schema.of(Field("photo_id", 57, primary_key=True), *ok[1:]), Schema.of(Field("photo_id", 58, True, True), *ok[1:])):
        with pytest.raises(SchemaError):
            PHOTO.check_upgrade(bad)
    key = Field("k", 8, primary_key=True)
    for fields in ([], [key, Field("j", 8, primary_key=True)], [key, Field("x", 65)], [key, Field("x", 64, signed=True)], [key, Field("Up", 8)], [key, Field("x" * 30, 8)], [key, Field("k", 8)], [key, *(Field(f"f{i}", 1) for i in range(64))]):
        with pytest.raises(SchemaError):
            Schema.of(*fields)


def test_wrapping_stores(spark):
    cases = [(13, 4, True, -3), (13, 4, False, 13), (16, 4, False, 0), (-1, 1, True, -1), (1, 1, True, -1), (-1, 8, False, 255), (2**32, 32, False, 0), (-1, 64, False, -1)]
    for value, nbits, signed, want in cases:
        f = Field("x", nbits, signed)
        assert f.wrap_int(value) == want
        assert spark.range(1).select(f.wrap(F.lit(value).cast("bigint"))).first()[0] == want


def test_bit_fields():
    for value, signed, offset, nbits, want in [(1, True, 0, 3, 1), (2, True, 0, 2, -2), (2, False, 0, 2, 2), (2, True, 1, 3, 1), (1, True, 0, 1, -1), (1, False, 0, 1, 1)]:
        assert rawcodec.get_bits(bytes([value]), offset, Field("x", nbits, signed)) == want


def test_packed_records(spark):
    rows = [(5, 100001, 101, 0, 130000001), (5, 100003, 103, -1, 130000003), (6, 2**58 - 1, 2**56 - 1, -1, 2**32 - 1), (6, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, PHOTO.struct())
    got = {r["photo_id"]: bytes(r["record"]) for r in rawcodec.encode(df, PHOTO).collect()}
    assert got[100001].hex() == "a1860100000000940100000000000824fd3d00" and got[100003].hex() == "a38601000000009c0100000000001c24fd3d00"
    for r in rows:
        values = dict(zip(PHOTO.names, r[1:], strict=True))
        assert rawcodec.pack_row(PHOTO, values) == got[r[1]] and rawcodec.unpack_row(PHOTO, got[r[1]]) == values
    assert sorted(map(tuple, rawcodec.decode(rawcodec.encode(df, PHOTO), PHOTO).collect())) == sorted(rows)
    assert sorted(map(tuple, rawcodec.import_tables(rawcodec.export_tables(df, PHOTO), PHOTO).collect())) == sorted(rows)


KV = Schema.of(Field("k", 40, primary_key=True), Field("a", 8), Field("b", 8, signed=True))


def state(df):
    return sorted(tuple(r) for r in df.select(TABLE, "k", "a", "b").collect())


def test_dml(spark):
    rows = spark.createDataFrame([(0, 1, 10, 0), (0, 2, 20, 0), (1, 1, 30, 0)], KV.struct())
    new = spark.createDataFrame([(0, 1, 99, 0), (0, 3, 300, 1), (0, 3, 5, 2)], f"{TABLE} bigint, k bigint, a bigint, _seq bigint")
    assert state(dml.insert(rows, new, KV)) == [(0, 1, 10, 0), (0, 2, 20, 0), (0, 3, 44, 0), (1, 1, 30, 0)]
    assert state(dml.insert(rows, new, KV, overwrite=True)) == [(0, 1, 99, 0), (0, 2, 20, 0), (0, 3, 5, 0), (1, 1, 30, 0)]
    assert state(dml.insert(rows, new, KV, query=T.a == 20)) == state(rows)
    assert len(state(dml.insert(rows, new, KV, query=T.a == 30))) == 4
    mixed = new.where("k <> 1").unionByName(spark.createDataFrame([(1, 9, 3, 9)], new.schema))
    assert state(dml.insert(rows, mixed, KV, query=T.a == 30)) == [(0, 1, 10, 0), (0, 2, 20, 0), (0, 3, 44, 0), (1, 1, 30, 0)]
    turn = spark.createDataFrame([(0, 7, 1, 0), (0, 8, 50, 1), (0, 9, 1, 2)], f"{TABLE} bigint, k bigint, a bigint, _seq bigint")
    again = spark.createDataFrame([(0, 7, 1, 0), (0, 7, 50, 1), (0, 8, 2, 2)], f"{TABLE} bigint, k bigint, a bigint, _seq bigint")
    assert [x[1:3] for x in state(dml.insert(rows, again, KV, overwrite=True, query=T.a == 50)) if x[1] > 5] == [(7, 50)]
    assert [x[1:3] for x in state(dml.insert(rows, again, KV, query=T.a == 50)) if x[1] > 5] == [(7, 1), (8, 2)]
    assert [x[1] for x in state(dml.insert(rows, turn, KV, query=T.a == 50)) if x[1] > 5] == [7, 8]
    assert state(dml.update(rows, {"a": T.a + 250, "b": T.a}, T.k == 1, KV, table=0)) == [(0, 1, 4, 4), (0, 2, 20, 0), (1, 1, 30, 0)]
    assert state(dml.update(rows, {"a": 1, "b": T.a}, T.a == 10, KV)) == [(0, 1, 1, 1), (0, 2, 20, 0), (1, 1, 30, 0)]
    assert state(dml.remove(rows, T.a > 15, KV)) == [(0, 1, 10, 0)] and state(dml.remove(rows, {}, KV)) == [] and state(dml.remove(rows, None, KV, table=0)) == [(1, 1, 30, 0)]
    with pytest.raises(DataError):
        dml.insert(rows, new.withColumn("zz", F.lit(1)), KV)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/data")
    assert c.list_buckets() == []
    c.alter_bucket("kv", *KV.fields)
    assert c.list_buckets() == ["kv"] and c.find("kv", 0).count() == 0
    assert c.insert("kv", 5, {"k": 1, "a": 7}) and not c.insert("kv", 5, {"k": 1, "a": 8})
    assert not c.insert("kv", 5, {"k": 1, "a": 7}, overwrite=True) and c.insert("kv", 5, {"k": 1, "a": 8}, overwrite=True)
    assert c.insert("kv", 6, [{"k": 2, "b": None}, {"k": 3, "b": True}]) and not c.insert("kv", 5, {"k": 9}, query={"a": 8}) and c.insert("kv", 5, {"k": 9}, query={"a": 77})
    with pytest.raises(DataError):
        c.insert("kv", 5, {"k": 1.5})
    with pytest.raises(DataError):
        c.insert("kv", 5, {"k": 12, "zz": 1})
    assert state(c.update("kv", 5, {"k": 9}, {"a": 3})) == [(5, 9, 3, 0)] and state(c.update("kv", 5, {"k": 99}, {"a": 3})) == []
    assert c.remove("kv", 6, {"k": 2}) and not c.remove("kv", 6, {"k": 2})
    assert list(c.tables("kv", page=1)) == [5, 6] and c.fields("kv") == ["k", "a", "b"]
    assert state(c.rows("kv")) == [(5, 1, 8, 0), (5, 9, 3, 0), (6, 3, 0, -1)] and [r[0] for r in c.list_tables("kv").collect()] == [5, 6]
    log = c.log("kv")
    empty = spark.createDataFrame([], KV.struct())
    assert state(changelog.replay(empty, log, KV)) == state(c.rows("kv"))
    c.alter_bucket("kv", *KV.fields, Field("likes", 20))
    assert c.rows("kv").select("likes").distinct().collect()[0][0] == 0 and c.describe("kv").count() == 4
    raw = c.get_raw("kv", 5)
    c.set_raw("kv", 8, raw)
    assert c.find("kv", 8).count() == 2
    c.freeze("kv")
    with pytest.raises(Exception, match="frozen"):
        c.remove("kv", 8)
    c.thaw("kv")
    before = c.stats()["num_scans"]
    assert len(c.find("kv", 5).items().collect()) == 2
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert c.stats()["num_commands"] > 5 and c.stats()["num_scans"] >= before + 2
    assert c.commands().count() == 0
    c.drop_bucket("kv")
    with pytest.raises(BucketMissing):
        c.rows("kv")
    assert [tuple(r)[:2] for r in c.commands().collect()] == [("drop", "kv")] and c.list_buckets() == []


def test_pages_of_changes_make_an_equal_bucket(spark, tmp_path):
    c, d = Catalog(spark, f"file://{tmp_path}/from"), Catalog(spark, f"file://{tmp_path}/to")
    c.alter_bucket("kv", *KV.fields)
    c.insert("kv", 5, [{"k": i, "a": i % 7} for i in range(1, 1301)])
    c.remove("kv", 5, T.k <= 600)
    c.set_raw("kv", 8, c.get_raw("kv", 5)[: 7 * 20])
    c.update("kv", 8, T.k < 610, {"a": 77})
    c.alter_bucket("kv", *KV.fields, Field("likes", 20))
    c.insert("kv", 9, {"k": 1, "likes": 5})
    at, met, kinds = -1, [], {}
    while True:
        page, after = c.feed("kv", at)
        n = page.count()
        if not n:
            break
        assert n <= 512 and after > at and d.replay("kv", page) == after == d.applied("kv")
        assert d.replay("kv", page) == after
        for r in page.collect():
            met.append(r["position"])
            kinds[r["op"]] = kinds.get(r["op"], 0) + 1
        at = after
    assert kinds == {"alter": 2, "upsert": 1300 + 20 + 9 + 1, "remove": 600 + 1} and len(set(met)) == len(met)
    assert c.log("kv", limit=None).count() == len(met)
    assert sorted(map(tuple, d.rows("kv").collect())) == sorted(map(tuple, c.rows("kv").collect())) and d.fields("kv") == c.fields("kv")
    with pytest.raises(GranaryError):
        d.set_position("kv", 7)
    d.alter_bucket("own", *KV.fields)
    d.set_position("own", 7)
    assert d.applied("own") == 7


def test_all_tables_are_found_in_one_pass(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/data")
    c.alter_bucket("kv", *KV.fields)
    c.insert("kv", None, spark.range(1000).selectExpr(f"id % 50 as {TABLE}", "id as k"))
    c.remove("kv", 7)
    before, want = c.counters["num_disk_reads"], [t for t in range(50) if t != 7]
    assert list(c.tables("kv", page=4)) == want
    once = c.counters["num_disk_reads"] - before
    c.rows("kv")
    assert c.counters["num_disk_reads"] == before + 2 * once
    assert sorted(r[0] for r in c.table_ids("kv").collect()) == want


def test_pages_are_reckoned_from_pointers(spark, tmp_path):
    import glob
    import json

    c = Catalog(spark, f"file://{tmp_path}/data")
    c.alter_bucket("kv", *KV.fields)
    c.insert("kv", None, spark.range(300).selectExpr(f"id % 5 as {TABLE}", "id as k", "id % 100 as a"))
    c.update("kv", 3, T.k > 100, {"a": 1})
    c.remove("kv", 4, T.k < 30)
    every = sorted(r["position"] for r in c.log("kv", limit=None).collect())
    told = lambda after, limit: {(r["_page"], r["position"]) for r in c.pages("kv", after, limit).collect()}
    for after, limit in ((-1, 100), (every[0], 64), (every[150], 7), (every[-3], 1), (every[-1] + 5, 9), (every[-1], 9)):
        rest = [x for x in every if x > after]
        want = [rest[i : i + limit] for i in range(0, len(rest), limit)]
        assert list(c.ends("kv", after, limit)) == [w[-1] for w in want]
        assert told(after, limit) == {(i, x) for i, w in enumerate(want) for x in w}
        page, end = c.feed("kv", after, limit)
        assert [r["position"] for r in page.collect()] == (want[0] if want else []) and end == (want[0][-1] if want else after)
    with pytest.raises(GranaryError):
        c.log("kv", every[-1])
    # the plan of a page neither sorts nor merges what comes after it, and all pages come without an exchange
    assert "TakeOrdered" not in c.log("kv", limit=7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in c.pages("kv", limit=7)._jdf.queryExecution().executedPlan().toString()
    # pointers of catalogs written before have no sizes
    want = told(-1, 7)
    for f in glob.glob(f"{tmp_path}/data/kv/current/*/part-*.json"):
        own = json.loads(open(f).read())
        assert own.pop("sizes")
        open(f, "w").write(json.dumps(own))
    for f in glob.glob(f"{tmp_path}/data/kv/current/*/.part-*.crc"):
        os.remove(f)
    assert told(-1, 7) == want


def test_catching_up_takes_few_commits(spark, tmp_path):
    c, d = Catalog(spark, f"file://{tmp_path}/from"), Catalog(spark, f"file://{tmp_path}/to")
    c.alter_bucket("kv", *KV.fields)
    c.insert("kv", None, spark.range(3000).selectExpr(f"id % 5 as {TABLE}", "id as k", "id % 100 as a"))
    c.remove("kv", 4, T.k < 300)
    c.alter_bucket("kv", *KV.fields, Field("likes", 20))
    c.insert("kv", 9, {"k": 1, "likes": 5})
    d.alter_bucket("kv", *KV.fields)
    ends = list(c.ends("kv", -1, 100))
    assert len(ends) == 31 and d.catch_up("kv", c, 100) == ends[-1] == d.applied("kv")
    at = d.version("kv")
    assert at <= 7 and sorted(map(tuple, d.rows("kv").collect())) == sorted(map(tuple, c.rows("kv").collect()))
    assert d.catch_up("kv", c, 100) == ends[-1] == d.replay("kv", c.feed("kv", -1, 100)[0]) and d.version("kv") == at
    c.insert("kv", 9, {"k": 2})
    assert d.catch_up("kv", c, 100) > ends[-1] and d.rows("kv").count() == c.rows("kv").count()


def test_small_commits_leave_the_rest_alone(spark, tmp_path):
    import os

    c = Catalog(spark, f"file://{tmp_path}/data", compact_after=3)
    files = lambda: {os.path.join(a, f) for a, _, fs in os.walk(f"{tmp_path}/data/kv/rows") for f in fs}
    c.alter_bucket("kv", *KV.fields)
    c.insert("kv", None, spark.range(1000).selectExpr(f"id % 5 as {TABLE}", "id as k", "id % 100 as a"))
    c.compact("kv")
    before = files()
    c.insert("kv", 1, {"k": 5000, "a": 1})
    assert files() == before and c.rows("kv").count() == 1001
    c.remove("kv", 1, T.k == 1)
    c.update("kv", 2, T.k == 2, {"a": 99})
    assert files() > before and c.rows("kv").count() == 1000 and len(c.vacuum("kv")) == 2 and c.rows("kv").count() == 1000
    plan = c.find("kv", 2, T.a == 99).items()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,99)" in plan and [r["k"] for r in c.find("kv", 2, T.a == 99)] == [2]


LOG = f"position bigint, op string, {TABLE} bigint, k bigint, a bigint, b bigint, query string"
CHANGES = [(1, "upsert", 0, 1, 5, 0, None), (2, "upsert", 0, 2, 6, 0, None), (3, "upsert", 0, 1, 9, 0, None), (4, "remove", 0, None, None, None, '{"k": 2}'), (5, "upsert", 0, 3, 1, 0, None)]


def test_replay(spark):
    log, empty = spark.createDataFrame(CHANGES, LOG), spark.createDataFrame([], KV.struct())
    done = changelog.replay(empty, log, KV)
    assert state(done) == [(0, 1, 9, 0), (0, 3, 1, 0)]
    assert state(changelog.replay(done, log.where("position = 2"), KV, after=5)) == state(done)
    assert tuple(changelog.position(log).first()) == (5, 5)
    # removals by query among changes: what comes after them stands
    more = [*CHANGES, (6, "remove", 0, None, None, None, '["$gt", "a", 8]'), (7, "upsert", 0, 4, 9, 0, None), (8, "remove", 1, None, None, None, "{}"), (9, "remove", 0, None, None, None, '{"k": 3}'), (10, "upsert", 0, 3, 2, 0, None)]
    held = spark.createDataFrame([(0, 50, 9, 0), (0, 51, 3, 0), (1, 1, 1, 1)], KV.struct())
    assert state(changelog.replay(held, spark.createDataFrame(more, LOG), KV)) == [(0, 3, 2, 0), (0, 4, 9, 0), (0, 51, 3, 0)]


def test_stream(spark, tmp_path):
    for i, part in enumerate((CHANGES[:2], CHANGES[2:], CHANGES[1:2])):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        held = globals().setdefault("_held", [spark.createDataFrame([], KV.struct()), -1])

        def save(rows, at, held=held):
            held[:] = [spark.createDataFrame(rows.collect(), KV.struct()), at]

        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log")
        q = changelog.follow(stream, lambda held=held: tuple(held), save, KV, f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    rows, at = globals().pop("_held")
    assert state(rows) == [(0, 1, 9, 0), (0, 3, 1, 0)] and at == 5
