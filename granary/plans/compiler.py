"""Expressions to typed Columns.

A node is BOOL, INT or DOUBLE. Conditions stay BOOL as long as they can, so that filters reach the scan; where an integer
is asked of one it becomes -1 (1 for an equality map) or 0. Plans must be built inside ``wrap_mode``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.expr import plain
from granary.functions import geo
from granary.model import TABLE, ExprError, Schema

BOOL, INT, DOUBLE = "bool", "int", "double"
_REF = re.compile(r"([0-9a-z_]+)\[(-?\d+)\]")


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: str
    true: int = -1

    def number(self) -> Column:
        return F.when(self.col, F.lit(self.true).cast("bigint")).otherwise(F.lit(0).cast("bigint")) if self.kind == BOOL else self.col

    def integer(self) -> Column:
        """As the whole of an expression, or an operand of bits: doubles are cut off."""
        return self.col.cast("bigint") if self.kind == DOUBLE else self.number()

    def condition(self) -> Column:
        return self.col if self.kind == BOOL else self.integer() != 0


#: Finds a table named in an expression: (bucket, table) to its rows and schema, None if there is none.
Resolver = Callable[[str, int], "tuple[DataFrame, Schema] | None"]


@dataclass
class Scope:
    """What an expression may refer to; lookups met while compiling are joined by ``bind``."""

    schema: Schema | None = None
    resolve: Resolver | None = None
    lookups: list[tuple[Column, DataFrame, str, str]] = field(default_factory=list)
    prefix: str = "__l"

    def lookup(self, key: Column, found: DataFrame, value: str) -> Column:
        name = f"{self.prefix}{len(self.lookups)}"
        self.lookups.append((key, found, value, name))
        return F.col(name)


OPS: dict[str, Callable[..., Typed]] = {}


def op(name: str, least: int, most: int | None = None):
    def register(f: Callable[..., Typed]) -> Callable[..., Typed]:
        def checked(scope: Scope, args: list[Any]) -> Typed:
            if len(args) < least or most is not None and len(args) > most:
                raise ExprError(f"${name} takes other than {len(args)} arguments")
            return f(scope, args)

        OPS[f"${name}"] = checked
        return f

    return register


def register_op(name: str, fn: Callable[..., Column], kind: str = INT) -> None:
    """Adds the operator ``$name``: ``fn`` takes and returns native Columns."""
    OPS[f"${name}"] = lambda scope, args: Typed(fn(*[compile_node(a, scope).number() for a in args]), kind)


def _compare(name: str, f: Callable[[Column, Column], Column]) -> None:
    @op(name, 2, 2)
    def _(scope: Scope, args: list[Any]) -> Typed:
        a, b = (compile_node(x, scope).number() for x in args)
        return Typed(f(a, b), BOOL)


for _n, _f in {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}.items():
    _compare(_n, _f)


def _bits(scope: Scope, args: list[Any]) -> tuple[list[Typed], bool]:
    typed = [compile_node(a, scope) for a in args]
    if any(t.kind == DOUBLE for t in typed):
        raise ExprError("bits of a fraction")
    return typed, all(t.kind == BOOL for t in typed)


def _logic(name: str, on_bool: Callable, on_int: Callable) -> None:
    @op(name, 1)
    def _(scope: Scope, args: list[Any]) -> Typed:
        typed, flags = _bits(scope, args)
        if flags:
            return Typed(reduce(on_bool, [t.col for t in typed]), BOOL)
        return Typed(reduce(on_int, [t.integer() for t in typed]), INT)


_logic("and", lambda a, b: a & b, lambda a, b: a.bitwiseAND(b))
_logic("or", lambda a, b: a | b, lambda a, b: a.bitwiseOR(b))
_logic("xor", lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b))


@op("not", 1, 1)
def _not(scope: Scope, args: list[Any]) -> Typed:
    (t,), flag = _bits(scope, args)
    return Typed(~t.col, BOOL) if flag else Typed(F.bitwise_not(t.integer()), INT)


def _arith(name: str, f: Callable[[Column, Column], Column]) -> None:
    @op(name, 1)
    def _(scope: Scope, args: list[Any]) -> Typed:
        typed = [compile_node(a, scope) for a in args]
        kind = DOUBLE if any(t.kind == DOUBLE for t in typed) else INT
        cols = [t.number().cast("double") if kind == DOUBLE else t.number() for t in typed]
        return Typed(reduce(f, cols), kind)


_arith("add", lambda a, b: a + b)
_arith("sub", lambda a, b: a - b)
_arith("mul", lambda a, b: a * b)


@op("neg", 1, 1)
def _neg(scope: Scope, args: list[Any]) -> Typed:
    t = compile_node(args[0], scope)
    return Typed(-t.number(), DOUBLE if t.kind == DOUBLE else INT)


@op("div", 2, 2)
def _div(scope: Scope, args: list[Any]) -> Typed:
    a, b = (compile_node(x, scope) for x in args)
    x, y = a.number(), b.number()
    if DOUBLE in (a.kind, b.kind):
        return Typed(F.when(y != 0, x.cast("double") / y.cast("double")).otherwise(F.lit(0.0)), DOUBLE)
    whole = F.call_function("div", x, F.when(y != 0, y))
    return Typed(F.coalesce(whole, F.lit(0).cast("bigint")), INT)


@op("mod", 2, 2)
def _mod(scope: Scope, args: list[Any]) -> Typed:
    typed, _ = _bits(scope, args)
    x, y = (t.integer() for t in typed)
    return Typed(F.coalesce(x % F.when(y != 0, y), F.lit(0).cast("bigint")), INT)


@op("pow", 2, 2)
def _pow(scope: Scope, args: list[Any]) -> Typed:
    typed, _ = _bits(scope, args)
    x, y = (t.integer() for t in typed)
    one = F.lit(1).cast("bigint")
    constant = args[1] if isinstance(args[1], int) and not isinstance(args[1], bool) and args[1] >= 0 else None
    if constant is not None and constant <= 32:
        # squared and multiplied out; the column of a square stands twice in the next, so only for small exponents
        power, square, n = None, x, constant
        while n:
            if n & 1:
                power = square if power is None else power * square
            n >>= 1
            square = square * square if n else square
        return Typed(one if power is None else power, INT)
    steps = 62 if constant is None else constant.bit_length() - 1
    bit = lambda s: F.call_function("shiftright", s["y"], F.lit(1))
    step = lambda s, _: F.struct(F.when(s["y"].bitwiseAND(one) == 1, s["r"] * s["b"]).otherwise(s["r"]).alias("r"), (s["b"] * s["b"]).alias("b"), bit(s).alias("y"))
    power = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.struct(one.alias("r"), x.alias("b"), y.alias("y")), step, lambda s: s["r"])
    return Typed(F.when(y < 0, F.lit(0).cast("bigint")).otherwise(power), INT)


def _shift(name: str, function: str) -> None:
    @op(name, 2, 2)
    def _(scope: Scope, args: list[Any]) -> Typed:
        typed, _ = _bits(scope, args)
        return Typed(F.call_function(function, typed[0].integer(), typed[1].integer().cast("int")), INT)


_shift("shl", "shiftleft")
_shift("shr", "shiftright")


@op("popcount", 1, 1)
def _popcount(scope: Scope, args: list[Any]) -> Typed:
    (t,), _ = _bits(scope, args)
    return Typed(F.bit_count(t.integer()).cast("bigint"), INT)


def _real(name: str, f: Callable[..., Column], n: int = 1) -> None:
    @op(name, n, n)
    def _(scope: Scope, args: list[Any]) -> Typed:
        return Typed(f(*[compile_node(a, scope).number().cast("double") for a in args]), DOUBLE)


for _n in ("sin", "cos", "tan", "asin", "acos", "atan", "sqrt"):
    _real(_n, getattr(F, _n))
_real("atan2", F.atan2, 2)


@op("if", 2, 3)
def _if(scope: Scope, args: list[Any]) -> Typed:
    c, a = compile_node(args[0], scope), compile_node(args[1], scope)
    b = compile_node(args[2], scope) if len(args) > 2 else Typed(F.lit(0).cast("bigint"), INT)
    if a.kind == b.kind == BOOL and a.true == b.true:
        return Typed(F.when(c.condition(), a.col).otherwise(b.col), BOOL, a.true)
    kind = DOUBLE if DOUBLE in (a.kind, b.kind) else INT
    x, y = (t.number().cast("double") if kind == DOUBLE else t.number() for t in (a, b))
    return Typed(F.when(c.condition(), x).otherwise(y), kind)


def table_ref(x: Any) -> tuple[str, int] | None:
    m = _REF.fullmatch(x) if isinstance(x, str) else None
    return (m[1], int(m[2])) if m else None


def named_table(scope: Scope, bucket: str, table: int) -> tuple[DataFrame, Schema] | None:
    if not scope.resolve:
        raise ExprError("no tables can be named here")
    return scope.resolve(bucket, table)


@op("in", 2, 2)
def _in(scope: Scope, args: list[Any]) -> Typed:
    x, many = compile_node(args[0], scope).integer(), args[1]
    named = table_ref(many)
    if named:
        found = named_table(scope, *named)
        if not found:
            return Typed(F.lit(False), BOOL)
        rows, schema = found
        keys = rows.select(F.col(schema.pk.name).alias("__key"), F.lit(True).alias("__has"))
        return Typed(F.coalesce(scope.lookup(x, keys, "__has"), F.lit(False)), BOOL)
    if not isinstance(many, list) or not all(isinstance(v, int) for v in many):
        raise ExprError("$in takes a list of integers or a table")
    return Typed(x.isin(*[-1 if v is True else int(v) for v in many]) if many else F.lit(False), BOOL)


@op("get", 4, 4)
def _get(scope: Scope, args: list[Any]) -> Typed:
    """The field of another table's row by key; 0 if there is none."""
    key, bucket, table, name = args
    found = named_table(scope, bucket, int(table))
    if not found:
        return Typed(F.lit(0).cast("bigint"), INT)
    rows, schema = found
    values = rows.select(F.col(schema.pk.name).alias("__key"), F.col(schema[name].name).alias("__value"))
    return Typed(F.coalesce(scope.lookup(compile_node(key, scope).integer(), values, "__value"), F.lit(0).cast("bigint")), INT)


def _calendar(name: str, f: Callable[[Column], Column]) -> None:
    @op(name, 1, 1)
    def _(scope: Scope, args: list[Any]) -> Typed:
        seconds = compile_node(args[0], scope).integer()
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
        return Typed(f(day).cast("bigint"), INT)


_calendar("year", F.year)
_calendar("month", F.month)
_calendar("day", F.dayofmonth)


@op("geo_from_latlon", 2, 2)
def _geo(scope: Scope, args: list[Any]) -> Typed:
    return Typed(geo.pack_column(*[compile_node(a, scope).number() for a in args]), INT)


@op("dist", 2, 2)
def _dist(scope: Scope, args: list[Any]) -> Typed:
    return Typed(geo.distance(*[compile_node(a, scope).integer() for a in args]), INT)


def _point(x: Any) -> int:
    """A constant point: packed, or $geo_from_latlon of two numbers."""
    if isinstance(x, list) and len(x) == 3 and x[0] == "$geo_from_latlon" and all(isinstance(v, (int, float)) for v in x[1:]):
        return geo.pack(*x[1:])
    if isinstance(x, bool) or not isinstance(x, int):
        raise ExprError("a constant point is needed")
    return x - (1 << 64) if x >> 63 == 1 else x


@op("in_circle", 2, 2)
def _in_circle(scope: Scope, args: list[Any]) -> Typed:
    if not isinstance(args[1], list) or len(args[1]) != 2:
        raise ExprError("$in_circle takes [centre, radius]")
    return Typed(geo.in_circle(compile_node(args[0], scope).integer(), _point(args[1][0]), int(args[1][1])), BOOL)


@op("in_polygon", 2, 2)
def _in_polygon(scope: Scope, args: list[Any]) -> Typed:
    if not isinstance(args[1], list):
        raise ExprError("$in_polygon takes a list of points")
    return Typed(geo.in_polygon(compile_node(args[0], scope).integer(), [_point(p) for p in args[1]]), BOOL)


def compile_node(node: Any, scope: Scope) -> Typed:
    node = plain(node)
    if node is None:
        return Typed(F.lit(0).cast("bigint"), INT)
    if isinstance(node, bool):
        return Typed(F.lit(node), BOOL)
    if isinstance(node, int):
        return Typed(F.lit(node - (1 << 64) if node >> 63 == 1 else node).cast("bigint"), INT)
    if isinstance(node, float):
        return Typed(F.lit(node), DOUBLE)
    if isinstance(node, str):
        if node == TABLE:
            return Typed(F.col(TABLE), INT)
        if scope.schema is None:
            raise ExprError(f"no field {node!r}")
        return Typed(F.col(scope.schema[node].name), INT)
    if isinstance(node, dict):
        same = [Typed(compile_node(k, scope).number() == compile_node(v, scope).number(), BOOL).col for k, v in node.items()]
        return Typed(reduce(lambda a, b: a & b, same) if same else F.lit(True), BOOL, 1)
    if isinstance(node, list) and node:
        if isinstance(node[0], str) and node[0].startswith("$"):
            if node[0] not in OPS:
                raise ExprError(f"no operator {node[0]}")
            return OPS[node[0]](scope, node[1:])
        return [compile_node(x, scope) for x in node][-1]
    raise ExprError(f"not an expression: {node!r}")


def bind(df: DataFrame, scope: Scope) -> DataFrame:
    """``df`` with a column for each lookup not joined yet; a row of another table by its key, so no row is repeated."""
    for key, found, value, name in scope.lookups:
        if name not in df.columns:
            right = found.select(F.col("__key").alias(f"{name}_key"), F.col(value).alias(name))
            df = df.join(right, key == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    return df
