"""Searches over the photo bucket, against hand-made results."""

import pytest
from pyspark.sql import functions as F

from granary.expr import T, ref
from granary.model import TABLE, ExprError, Field, Schema
from granary.operators.query import evaluate, find, multifind

PHOTO = Schema.of(Field("photo_id", 58, primary_key=True), Field("location_id", 56), Field("is_private", 1, signed=True), Field("created", 32))
ROWS = [(100001, 101, 0), (100002, 102, 0), (100003, 103, -1), (100004, 104, 0), (100005, 105, 0), (100006, 101, -1), (100007, 102, 0), (100008, 103, 0)]


@pytest.fixture(scope="module")
def photos(spark):
    return spark.createDataFrame([(5, p, l, v, p + 129900000) for p, l, v in ROWS], PHOTO.struct()).cache()


def resolve_for(spark):
    follow = spark.createDataFrame([(7, 101), (7, 103)], f"{TABLE} bigint, loc bigint")
    schema = Schema.of(Field("loc", 56, primary_key=True))
    return lambda bucket, table: (follow.where(F.col(TABLE) == table), schema) if bucket == "follow" else None


def ids(search):
    return [r["photo_id"] - 100000 for r in search.items(ordered=True).collect()]


def numbers(search):
    return tuple(search.numbers().first())


def test_filter_sort_and_numbers(photos):
    f = find(photos, PHOTO, 5).sort(-T.created).limit(10)
    assert ids(f) == [8, 7, 6, 5, 4, 3, 2, 1] and numbers(f) == (8, False)
    f = find(photos, PHOTO, 5, T.location_id.in_([101, 102, 103, 104]) & ~T.is_private).sort(-T.created)
    assert ids(f) == [8, 7, 4, 2, 1] and numbers(f) == (5, False)
    f = find(photos, PHOTO, 5, ~T.is_private).filter(T.location_id < 103)
    assert ids(f) == [1, 2, 7] and numbers(f) == (6, False)
    assert numbers(f.group(T.location_id)) == (5, False)
    assert ids(find(photos, PHOTO, 5, {"location_id": 101, "is_private": 0})) == [1]


def test_groups(photos):
    rows = find(photos, PHOTO, 5).group(T.location_id)
    assert [(r["photo_id"] - 100000, r["_count"]) for r in rows] == [(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)]
    assert [(r["photo_id"] - 100000, r["_count"]) for r in rows.sort(-T.created).items().collect()] == [(8, 2), (7, 2), (6, 2), (5, 1), (4, 1)]
    assert ids(rows.limit(2)) == [1, 2] and numbers(rows.limit(2)) == (5, True)


def test_offset_limit_and_key(photos):
    f = find(photos, PHOTO, 5)
    assert ids(f.offset(2).limit(3)) == [3, 4, 5] and numbers(f.offset(2).limit(3)) == (8, True)
    assert ids(f.limit(0)) == [] and numbers(f.limit(0)) == (8, True)
    assert ids(f[2:5]) == [3, 4, 5] and f[1]["photo_id"] == 100002 and f.first()["photo_id"] == 100001
    assert ids(find(photos, PHOTO, 5, pk=100004)) == [4] and numbers(find(photos, PHOTO, 5, pk=100004)) == (0, False)
    assert ids(find(photos, PHOTO, 5, pk=1)) == [] and numbers(find(photos, PHOTO, 9)) == (0, False)


def test_tables_in_expressions(spark, photos):
    go = lambda q: ids(find(photos, PHOTO, 5, q, resolve=resolve_for(spark)))
    assert go(T.location_id.in_(ref("follow", 7))) == [1, 3, 6, 8]
    assert go(~T.location_id.in_(ref("follow", 7))) == [2, 4, 5, 7]
    assert go(T.location_id.in_(ref("follow", 8))) == [] and go(T.location_id.in_(ref("nobody", 8))) == []
    assert go(T.location_id.in_(ref("follow", 7)) | (T.created > 130000006)) == [1, 3, 6, 7, 8]


def test_update_is_seen_by_later_steps(photos):
    f = find(photos, PHOTO, 5, {"photo_id": 100005}).update({"is_private": -1}).filter(T.is_private)
    assert [tuple(r) for r in f.items().collect()] == [(100005, 105, -1, 130000005)] and f.count() == 1
    with pytest.raises(ExprError):
        find(photos, PHOTO, 5).update({"photo_id": 1}).items()


def test_several_tables(spark):
    data = [(1, 10), (1, 40), (2, 20), (2, 50)]
    schema = Schema.of(Field("pk", 40, primary_key=True))
    rows = spark.createDataFrame(data, schema.struct())
    m = multifind(rows, schema, [1, 2, 3, 9], limit=3)
    assert [tuple(r) for r in m.items().collect()] == [(2, 50), (1, 40), (2, 20)] and tuple(m.numbers().first()) == (4, True)
    m = multifind(rows, schema, [1, 2, 3, 9], T.pk < 45, limit=10)
    assert [tuple(r) for r in m.items().collect()] == [(1, 40), (2, 20), (1, 10)] and tuple(m.numbers().first()) == (4, False)
    m = multifind(rows, schema, [1, 1])
    assert [tuple(r) for r in m.items().collect()] == [(1, 40), (1, 40), (1, 10), (1, 10)] and m.count() == 4


def test_predicates_reach_the_scan(spark, tmp_path, photos):
    photos.write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = find(spark.read.parquet(str(tmp_path / "p")), PHOTO, 5, (T.location_id == 101) & (T.created > 5)).items()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(location_id,101)" in plan and "GreaterThan(created,5)" in plan and "EqualTo(_table,5)" in plan


def test_plain_searches_do_not_sort(photos):
    plan = lambda f: f.items()._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan(find(photos, PHOTO, 5, T.location_id > 1)) and "Sort" in plan(find(photos, PHOTO, 5).offset(1)) and "Sort" in plan(find(photos, PHOTO, 5).sort(T.created))
    assert [r["photo_id"] for r in find(photos, PHOTO, 5)] == [p for p, _, _ in ROWS]


def test_numbers_take_one_pass(spark, tmp_path, photos):
    photos.write.parquet(str(tmp_path / "p"))
    f = find(spark.read.parquet(str(tmp_path / "p")), PHOTO, 5, ~T.is_private).update({"location_id": T.location_id + 1}).filter(T.location_id < 104).group(T.location_id)
    assert f.numbers()._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1 and numbers(f) == (5, False)


def test_power(spark):
    for x, n in ((3, 0), (3, 1), (-3, 5), (7, 31), (5, 33), (2, 63), (3, 2**40), (0, 0)):
        want = pow(x, n, 1 << 64)
        assert evaluate(spark, ["$pow", x, n]).first()[0] == want - (1 << 64) * (want >> 63) == evaluate(spark, ["$pow", x, ["$add", n, 0]]).first()[0]


def test_own_operators(spark, photos):
    from granary.plans import compiler

    compiler.register_op("clamp", lambda x, a, b: F.greatest(a, F.least(x, b)))
    try:
        assert ids(find(photos, PHOTO, 5, T.location_id.clamp(102, 104) == 104)) == [4, 5]
    finally:
        del compiler.OPS["$clamp"]


def test_cap_of_several_tables(spark):
    schema = Schema.of(Field("pk", 40, primary_key=True))
    rows = spark.range(30).selectExpr(f"id % 3 as {TABLE}", "id as pk")
    assert multifind(rows, schema, [0, 1], cap=5).items().count() == 5 and multifind(rows, schema, [0, 1], cap=None).items().count() == 20
    assert multifind(rows, schema, [0, 1], cap=5).has_more() and not multifind(rows, schema, [0, 1], cap=None).has_more()


def test_errors(spark):
    for bad in ([], ["$nope", 1], "field", ["$if", 1], ["$in", 2, ["x"]], ["$mod", 1.5, 2]):
        with pytest.raises(ExprError):
            evaluate(spark, bad)
