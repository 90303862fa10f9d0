"""Expressions against constants, and against an interpreter in plain Python."""

import random

from granary.expr import T
from granary.functions import geo
from granary.model import Field, Schema
from granary.operators.query import evaluate, project

MAX, MIN = 2**63 - 1, -(2**63)
GOLD = [
    (["$add", MAX, 1], MIN), (["$div", -7, 2], -3), (["$mod", -7, 3], -1), (["$div", 1, 0], 0), (["$mod", 1, 0], 0), (["$pow", 3, 39], 4052555153018976267),
    (["$pow", 3, 41], -420491770248316829), (["$pow", 2, 63], MIN), (["$pow", 2, 64], 0), (["$pow", -2, 3], -8), (["$pow", 5, -1], 0), (["$pow", 0, 0], 1),
    (["$not", 0], -1), (["$not", 1], -2), (["$not", -43], 42), (["$lt", 1, 2], -1), (["$and", 6, 3], 2), (["$or", 4, 1], 5), (["$xor", 5, 3], 6),
    (["$popcount", -1], 64), (["$shl", 1, 62], 2**62), (["$shr", -8, 1], -4), (["$if", 0, 7], 0), (["$if", 0, 7, 9], 9), (["$if", -1, 7, 9], 7),
    (["$in", 2, [3, 2, 1]], -1), (["$in", 2, []], 0), (["$sqrt", 10], 3), (None, 0), (True, -1), (False, 0), ([1, 2, 3], 3), ({}, 1), (["$not", {}], 0),
    (["$neg", -5], 5), (["$add", ["$lt", 1, 2], 1], 0), (["$and", ["$lt", 1, 2], 4], 4), (["$if", 0.5, 1, 2], 2),
]
DATES = {0: (1970, 1, 1), -1: (1969, 12, 31), 130000001: (1974, 2, 13), 951782400: (2000, 2, 29), 1704067199: (2023, 12, 31), 1704067200: (2024, 1, 1)}


def wrap(x):
    return (x - MIN) % 2**64 + MIN


def test_constants(spark):
    df = None
    for e, _ in GOLD:
        one = evaluate(spark, e)
        df = one if df is None else df.union(one)
    assert [r[0] for r in df.collect()] == [v for _, v in GOLD]


def test_dates(spark):
    for ts, want in DATES.items():
        assert tuple(evaluate(spark, [f"${p}", ts]).first()[0] for p in ("year", "month", "day")) == want


SCHEMA = Schema.of(Field("k", 64, primary_key=True), Field("a", 64), Field("b", 64))


def run(node, row):
    """The value of an expression for one row, by the definitions."""
    if isinstance(node, str):
        return row[node]
    if not isinstance(node, list):
        return node
    name, args = node[0], [run(x, row) for x in node[1:]]
    x, y = args[0], args[-1]
    cut = lambda p, q: 0 if q == 0 else abs(p) // abs(q) * (1 if (p < 0) == (q < 0) else -1)
    table = {
        "$add": lambda: x + y, "$sub": lambda: x - y, "$mul": lambda: x * y, "$neg": lambda: -x, "$div": lambda: cut(x, y), "$mod": lambda: 0 if y == 0 else x - y * cut(x, y),
        "$and": lambda: x & y, "$or": lambda: x | y, "$xor": lambda: x ^ y, "$not": lambda: ~x, "$lt": lambda: -(x < y), "$lte": lambda: -(x <= y), "$gt": lambda: -(x > y),
        "$gte": lambda: -(x >= y), "$eq": lambda: -(x == y), "$ne": lambda: -(x != y), "$if": lambda: args[1] if x else args[2], "$popcount": lambda: bin(x % 2**64).count("1"),
        "$pow": lambda: 0 if y < 0 else pow(x, y, 2**64),
    }
    return wrap(table[name]())


def make(r, depth):
    if depth == 0 or r.random() < 0.2:
        return r.choice(["a", "b", r.choice([0, 1, -1, 2**31, MAX, MIN + 1, 7, -3])])
    name = r.choice(["$add", "$sub", "$mul", "$neg", "$div", "$mod", "$and", "$or", "$xor", "$not", "$lt", "$lte", "$gt", "$gte", "$eq", "$ne", "$if", "$popcount", "$pow"])
    n = {"$neg": 1, "$not": 1, "$popcount": 1, "$if": 3}.get(name, 2)
    return [name, *[make(r, depth - 1) for _ in range(n)]]


def test_random_expressions(spark):
    r = random.Random(11)
    values = [0, 1, -1, 5, -7, 2**31, MAX, MIN, 12345678901]
    rows = [(0, i, r.choice(values), r.choice(values)) for i in range(24)]
    df = spark.createDataFrame(rows, SCHEMA.struct())
    made = {f"v{i}": make(r, 3) for i in range(40)}
    for got in project(df, SCHEMA, None, **made).collect():
        row = {"a": rows[got["k"]][2], "b": rows[got["k"]][3]}
        for name, e in made.items():
            assert got[name] == run(e, row), (e, row)


def test_builder():
    e = 5 - T.a * 2 + (T.b >> 1)
    assert e.node == ["$add", ["$sub", 5, ["$mul", "a", 2]], ["$shr", "b", 1]]
    assert (~T.a & (3 | T.b)).node == ["$and", ["$not", "a"], ["$or", 3, "b"]] and T.t.year().node == ["$year", "t"]


POINTS = {(39.9, 116.4): 15187819286946175604, (39.8, 116.3): 15182695189100970784, (0, 0): 9223372039002259456, (0, 1): 9274612991708364800, (90, 0): 9223372036854775808, (-90, 0): 9223372041149743103, (0, 180): 2147483648}


def test_points_and_distances(spark):
    at = {p: (v - 2**64 if v >> 63 else v) for p, v in POINTS.items()}
    for p, v in at.items():
        assert geo.pack(*p) == v == evaluate(spark, ["$geo_from_latlon", *map(float, p)]).first()[0]
    d = lambda p, q: evaluate(spark, ["$dist", at[p], at[q]]).first()[0]
    assert [d((39.9, 116.4), (39.8, 116.3)), d((0, 0), (0, 1)), d((0, 0), (0, 180)), d((90, 0), (-90, 0)), d((0, 0), (0, 0))] == [14034, 111319, 20037508, 20037508, 0]


def test_circle_and_polygons(spark):
    centre = geo.pack(0, 0)
    lat, lon = geo.unpack(centre)
    inside = lambda up: evaluate(spark, ["$in_circle", geo._signed(lon << 32 | lat - up), [centre, 10000]]).first()[0]
    assert [inside(2140000), inside(2140001), inside(2143466)] == [-1, 0, 0]
    poly = lambda shape, p: evaluate(spark, ["$in_polygon", geo.pack(*p), [geo.pack(*c) for c in shape]]).first()[0]
    square, ell = [(0, 0), (0, 10), (10, 10), (10, 0)], [(0, 0), (0, 10), (5, 10), (5, 5), (10, 5), (10, 0)]
    assert [poly(square, p) for p in ((7, 7), (2, 2), (11, 5), (-1, 5), (5, -0.1))] == [-1, -1, 0, 0, 0]
    assert [poly(ell, p) for p in ((2, 2), (7, 7), (11, 5))] == [-1, 0, 0]
