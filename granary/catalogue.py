"""The query catalogue: one query for each operator over the sample tables, with its SQL counterpart.

Sample tables become buckets of integers: money in cents, times in epoch seconds, names by the code of their first letter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.expr import T, ref
from granary.functions import geo
from granary.model import TABLE, Field, Schema, wrap_mode
from granary.operators import dml
from granary.operators.query import evaluate, find, multifind, nearby, project, restrict
from granary.plans.compiler import register_op
from granary.sources import rawcodec
from granary.sources.catalog import Catalog
from granary.sources.shared import shared_dir
from granary.streaming import changelog

Query = Callable[[SparkSession, str], DataFrame]

ORDERS = Schema.of(Field("okey", 40, primary_key=True), Field("cust", 40), Field("total", 48), Field("created", 40), Field("status", 8), Field("prio", 8))
EVENTS = Schema.of(Field("event", 40, primary_key=True), Field("created", 40), Field("kind", 8), Field("value", 48, signed=True))
CUSTOMERS = Schema.of(Field("cust", 40, primary_key=True), Field("nation", 16), Field("balance", 40, signed=True), Field("place", 64))
NATIONS = Schema.of(Field("nation", 16, primary_key=True), Field("region", 8))
PARTS = Schema.of(Field("part", 40, primary_key=True), Field("size", 16), Field("price", 40))
LINES = Schema.of(Field("line", 64, primary_key=True), Field("okey", 40), Field("qty", 16), Field("price", 48), Field("discount", 16), Field("shipped", 40), Field("flag", 8))

_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"
_CENTS = "cast(floor({} * 100 + 0.5) as bigint)"


def _bucket(spark: SparkSession, sf_dir: str, name: str, schema: Schema, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*cols)
    return df.select(*[F.coalesce(F.col(f.name).cast("bigint"), F.lit(0)).alias(f.name) for f in schema.struct()])


def orders(spark: SparkSession, sf_dir: str, single: bool = True) -> DataFrame:
    """All orders in table 0, or in the table of their customer."""
    table = "0" if single else "o_custkey"
    return _bucket(spark, sf_dir, "orders", ORDERS, f"{table} as {TABLE}", "o_orderkey as okey", "o_custkey as cust", f"{_CENTS.format('o_totalprice')} as total", f"{_SECONDS.format('o_orderdate')} as created", "ascii(o_orderstatus) as status", "ascii(o_orderpriority) as prio")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket(spark, sf_dir, "events", EVENTS, f"user_id as {TABLE}", "event_id as event", f"{_SECONDS.format('ts')} as created", "ascii(event_type) as kind", f"{_CENTS.format('value')} as value")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    with wrap_mode(spark):
        df = _bucket(spark, sf_dir, "customer", Schema(CUSTOMERS.fields[:3]), f"0 as {TABLE}", "c_custkey as cust", "c_nationkey as nation", f"{_CENTS.format('c_acctbal')} as balance")
        lat, lon = (F.col("cust") * 37) % 18000 / 100.0 - 90, (F.col("cust") * 91) % 36000 / 100.0 - 180
        return df.withColumn("place", geo.pack_column(lat, lon))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket(spark, sf_dir, "nation", NATIONS, f"0 as {TABLE}", "n_nationkey as nation", "n_regionkey as region")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket(spark, sf_dir, "part", PARTS, f"0 as {TABLE}", "p_partkey as part", "p_size as size", f"{_CENTS.format('p_retailprice')} as price")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "l_orderkey * 268435456 + l_partkey * 8192 + l_suppkey * 8 + l_linenumber"
    return _bucket(spark, sf_dir, "lineitem", LINES, f"0 as {TABLE}", f"{key} as line", "l_orderkey as okey", "cast(l_quantity as bigint) as qty", f"{_CENTS.format('l_extendedprice')} as price", f"{_CENTS.format('l_discount')} as discount", f"{_SECONDS.format('l_shipdate')} as shipped", "ascii(l_returnflag) as flag")


def _since(col: str) -> str:
    return f"date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', {col}))"


_C = "floor({} * 100 + 0.5)::BIGINT"
_ORDERS = f"SELECT 0::BIGINT AS _table, o_orderkey::BIGINT AS okey, o_custkey::BIGINT AS cust, {_C.format('o_totalprice')} AS total, {_since('o_orderdate')} AS created, ascii(o_orderstatus)::BIGINT AS status, ascii(o_orderpriority)::BIGINT AS prio FROM orders"
_EVENTS = f"SELECT user_id::BIGINT AS _table, event_id::BIGINT AS event, {_since('ts')} AS created, ascii(event_type)::BIGINT AS kind, {_C.format('value')} AS value FROM events"
_PACK = "(((trunc((180 + {lon}) / 360.0 * 4294967296)::HUGEINT % 4294967296) * 4294967296 + least(trunc((90 - {lat}) / 180.0 * 4294967296), 4294967295)::HUGEINT + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT"
_LAT, _LON = "((c_custkey * 37) % 18000 / 100.0 - 90)::DOUBLE", "((c_custkey * 91) % 36000 / 100.0 - 180)::DOUBLE"
_CUST = f"SELECT 0::BIGINT AS _table, c_custkey::BIGINT AS cust, c_nationkey::BIGINT AS nation, {_C.format('c_acctbal')} AS balance, {_PACK.format(lat=_LAT, lon=_LON)} AS place FROM customer"
_NATION = "SELECT 0::BIGINT AS _table, n_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region FROM nation"
_PART = f"SELECT 0::BIGINT AS _table, p_partkey::BIGINT AS part, p_size::BIGINT AS size, {_C.format('p_retailprice')} AS price FROM part"
_LINES = f"SELECT 0::BIGINT AS _table, (l_orderkey * 268435456 + l_partkey * 8192 + l_suppkey * 8 + l_linenumber)::BIGINT AS line, l_orderkey::BIGINT AS okey, l_quantity::BIGINT AS qty, {_C.format('l_extendedprice')} AS price, {_C.format('l_discount')} AS discount, {_since('l_shipdate')} AS shipped, ascii(l_returnflag)::BIGINT AS flag FROM lineitem"
WITH = f"WITH o AS ({_ORDERS}), ot AS (SELECT cust AS _table, * EXCLUDE (_table) FROM ({_ORDERS})), e AS ({_EVENTS}), c AS ({_CUST}), n AS ({_NATION}), p AS ({_PART}), l AS ({_LINES}) "
_WRAP = "(((({}) + 9223372036854775808::HUGEINT) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808)::BIGINT"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = WITH + sql


def _value(name: str, expression: Any, sql: str, bucket: str = "o") -> None:
    """The value of an expression for every row of a bucket."""
    load, schema = {"o": (orders, ORDERS), "c": (customers, CUSTOMERS), "p": (parts, PARTS)}[bucket]
    pk = schema.pk.name
    _add(name, lambda s, d: project(load(s, d), schema, None, v=expression), f"SELECT _table, {pk}, ({sql})::BIGINT AS v FROM {bucket}")


def _flag(name: str, expression: Any, sql: str, bucket: str = "o") -> None:
    """A condition, as its value -1 or 0 for every row."""
    _value(name, expression, f"CASE WHEN {sql} THEN -1 ELSE 0 END", bucket)


def _found(name: str, build: Callable[[Any], Any], sql: str, bucket: str = "o") -> None:
    """The rows of a search in table 0."""
    load, schema = {"o": (orders, ORDERS), "c": (customers, CUSTOMERS), "p": (parts, PARTS), "l": (lines, LINES)}[bucket]
    _add(name, lambda s, d: build(lambda *q, **k: find(load(s, d), schema, 0, *q, resolve=_tables(s, d), **k)).items(), sql)


def _tables(spark: SparkSession, sf_dir: str):
    """Tables that expressions may name: rich[0] (customers with a balance over 5000), nation[0], and parts by size."""

    def resolve(bucket: str, table: int):
        if bucket == "rich":
            rows = customers(spark, sf_dir)
            return rows.where((F.col("balance") > 500000) & (F.col(TABLE) == table)), CUSTOMERS
        if bucket == "nation":
            return nations(spark, sf_dir).where(F.col(TABLE) == table), NATIONS
        return None

    return resolve


_O = "okey, cust, total, created, status, prio"
_found("scan_all", lambda f: f(), f"SELECT {_O} FROM o")
_found("pk_lookup", lambda f: f(pk=4711), f"SELECT {_O} FROM o WHERE okey = 4711")
_found("find_filter", lambda f: f((T.total > 20000000) & (T.status == 79)), f"SELECT {_O} FROM o WHERE total > 20000000 AND status = 79")
_found("find_two_phase_filter", lambda f: f(T.status == 79).update({"prio": T.prio + 1}).filter(T.prio == 50, T.total > 10000000), "SELECT okey, cust, total, created, status, prio + 1 AS prio FROM o WHERE status = 79 AND prio + 1 = 50 AND total > 10000000")
_found("find_several_queries", lambda f: f(T.total > 10000000, T.prio == 49), f"SELECT {_O} FROM o WHERE total > 10000000 AND prio = 49")
_found("map_equality", lambda f: f({"status": 70, "prio": 50}), f"SELECT {_O} FROM o WHERE status = 70 AND prio = 50")
_value("map_value", {"status": 70}, "CASE WHEN status = 70 THEN 1 ELSE 0 END")
_value("plain_list_last", ["total", "prio"], "prio")
for _n, _s in {"lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "eq": "=", "ne": "<>"}.items():
    _flag(f"cmp_{_n}", [f"${_n}", ["$mod", "total", 1000], 500], f"total % 1000 {_s} 500")
_flag("bool_and", (T.status == 79) & (T.prio > 50), "status = 79 AND prio > 50")
_flag("bool_or", (T.status == 79) | (T.prio > 50), "status = 79 OR prio > 50")
_flag("bool_not", ~(T.status == 79), "NOT status = 79")
_flag("bool_xor", (T.status == 79) ^ (T.prio > 50), "(status = 79) <> (prio > 50)")
_value("bit_and", T.total & 255, "total & 255")
_value("bit_or", T.total | 255, "total | 255")
_value("bit_xor", T.total ^ T.okey, "xor(total, okey)")
_value("bit_not", ~T.total, "~total")
_value("bit_shl", T.okey << 20, "okey << 20")
_value("bit_shr", T.total >> 3, "total >> 3")
_value("popcount", T.total.popcount(), "bit_count(total)")
_value("arith_add", T.total + T.okey + 7, "total + okey + 7")
_value("arith_sub", T.total - T.okey - 7, "total - okey - 7")
_value("arith_mul", T.total * T.prio * 3, "total * prio * 3")
_value("arith_neg", -T.total, "-total")
_value("arith_div", -T.total / 7, "-(total // 7)")
_value("arith_mod", -T.total % 7, "-(total % 7)")
_value("arith_pow", (T.prio - 40) ** 5, "(prio - 40) * (prio - 40) * (prio - 40) * (prio - 40) * (prio - 40)")
_value("pow_wraps", T.total**3, _WRAP.format("(total::HUGEINT * total % 18446744073709551616) * total % 18446744073709551616"))
_value("div_by_zero", T.total / (T.prio - 49), "CASE WHEN prio = 49 THEN 0 ELSE total // (prio - 49) END")
_value("mod_by_zero", T.total % (T.prio - 49), "CASE WHEN prio = 49 THEN 0 ELSE total % (prio - 49) END")
_value("add_wraps", T.total + (2**63 - 1), _WRAP.format("total::HUGEINT + 9223372036854775807"))
_value("mul_wraps", T.total * 2**40, _WRAP.format("total::HUGEINT * 1099511627776"))
for _n in ("sin", "cos", "tan", "atan"):
    _value(f"trig_{_n}", ["$mul", [f"${_n}", ["$div", "prio", 7.0]], 1000000.0], f"trunc({_n}(prio / 7.0::DOUBLE) * 1000000)")
for _n in ("asin", "acos"):
    _value(f"trig_{_n}", ["$mul", [f"${_n}", ["$div", "prio", 100.0]], 1000000.0], f"trunc({_n}(prio / 100.0::DOUBLE) * 1000000)")
_value("trig_atan2", ["$mul", ["$atan2", "prio", "status"], 1000000.0], "trunc(atan2(prio, status) * 1000000)")
_value("sqrt", T.total.sqrt(), "trunc(sqrt(total))")
_value("if2", ["$if", T.prio > 50, T.total], "CASE WHEN prio > 50 THEN total ELSE 0 END")
_value("if3", ["$if", T.prio > 50, T.total, -T.okey], "CASE WHEN prio > 50 THEN total ELSE -okey END")
_found("in_list", lambda f: f(T.prio.in_([49, 50]) & T.cust.in_([1, 2, 3, 4, 5])), f"SELECT {_O} FROM o WHERE prio IN (49, 50) AND cust IN (1, 2, 3, 4, 5)")
_found("in_empty", lambda f: f(T.prio.in_([])), f"SELECT {_O} FROM o WHERE false")
_RICH = "(SELECT cust FROM c WHERE balance > 500000)"
_found("in_table_semi", lambda f: f(T.cust.in_(ref("rich", 0))), f"SELECT {_O} FROM o WHERE cust IN {_RICH}")
_found("not_in_table_anti", lambda f: f(~T.cust.in_(ref("rich", 0)) & (T.prio == 49)), f"SELECT {_O} FROM o WHERE cust NOT IN {_RICH} AND prio = 49")
_found("in_missing_table", lambda f: f(T.cust.in_(ref("rich", 3)) | (T.prio == 49)), f"SELECT {_O} FROM o WHERE prio = 49")
_found("in_table_nested_or", lambda f: f(T.cust.in_(ref("rich", 0)) | (T.total > 30000000)), f"SELECT {_O} FROM o WHERE cust IN {_RICH} OR total > 30000000")
_add("in_table_as_value", lambda s, d: project(orders(s, d), ORDERS, _tables(s, d), v=T.cust.in_(ref("rich", 0)) * -5), f"SELECT _table, okey, CASE WHEN cust IN {_RICH} THEN 5 ELSE 0 END::BIGINT AS v FROM o")
_add("get_lookup", lambda s, d: project(customers(s, d), CUSTOMERS, _tables(s, d), v=["$get", "nation", "nation", 0, "region"]), "SELECT c._table, c.cust, coalesce(n.region, 0)::BIGINT AS v FROM c LEFT JOIN n ON c.nation = n.nation")
_DAY = "(TIMESTAMP '1970-01-01' + to_seconds(created))"
for _n in ("year", "month", "day"):
    _value(f"date_{_n}", [f"${_n}", "created"], f"{_n}({_DAY})")
_value("geo_pack", ["$geo_from_latlon", ["$sub", ["$div", ["$mod", ["$mul", "cust", 37], 18000], 100.0], 90], ["$sub", ["$div", ["$mod", ["$mul", "cust", 91], 36000], 100.0], 180]], "place", "c")
_B = "39.9, 116.4"
_CENTRE = geo.pack(39.9, 116.4)
_LATD, _LOND = "(90 - (place & 4294967295) * 180.0 / 4294967296)::DOUBLE", "((((place::HUGEINT + 18446744073709551616) % 18446744073709551616) // 4294967296) * 360.0 / 4294967296 - 180)::DOUBLE"
_CLAT, _CLON = geo.degrees(_CENTRE)
_DIST = f"floor(2 * asin(least(sqrt(pow(sin(radians(({_LATD} - {_CLAT!r}::DOUBLE) / 2)), 2) + cos(radians({_LATD})) * cos(radians({_CLAT!r}::DOUBLE)) * pow(sin(radians(({_LOND} - {_CLON!r}::DOUBLE) / 2)), 2)), 1.0)) * 6378137)::BIGINT"
_value("geo_dist", ["$dist", "place", _CENTRE], _DIST, "c")
_REACH = 214 * 3000000
_BAND = f"(place & 4294967295) BETWEEN {max(0, geo.unpack(_CENTRE)[0] - _REACH)} AND {min(geo.LOW, geo.unpack(_CENTRE)[0] + _REACH)}"
_K = "cust, nation, balance, place"
_found("geo_circle", lambda f: f(T.place.in_circle([_CENTRE, 3000000])), f"SELECT {_K} FROM c WHERE {_BAND} AND {_DIST} <= 3000000", "c")
_SQUARE = [geo.pack(-30.05, -60.05), geo.pack(-30.05, 80.05), geo.pack(40.05, 80.05), geo.pack(40.05, -60.05)]
_found("geo_polygon", lambda f: f(T.place.in_polygon(_SQUARE)), f"SELECT {_K} FROM c WHERE {_LATD} BETWEEN -30.05 AND 40.05 AND {_LOND} BETWEEN -60.05 AND 80.05", "c")
_add("geo_nearby", lambda s, d: nearby(customers(s, d), CUSTOMERS, "place", _CENTRE, 3000000, 15), f"SELECT _table, {_K}, {_DIST} AS distance FROM c WHERE {_BAND} AND {_DIST} <= 3000000 ORDER BY distance, cust LIMIT 15")
_add("table_pseudo_col", lambda s, d: project(events(s, d), EVENTS, None, v=T["_table"] * 2 + T.kind), "SELECT _table, event, (_table * 2 + kind)::BIGINT AS v FROM e")
_GROUP = "SELECT _count, {cols} FROM (SELECT *, count(*) OVER (PARTITION BY {g}) AS _count, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS k FROM {src}) WHERE k = 1"
_found("group_first", lambda f: f().group(T.cust), _GROUP.format(cols=_O, g="cust", order="okey", src="o"))
_found("group_sorted", lambda f: f(T.status == 79).group(T.cust % 100).sort(-T.total), _GROUP.format(cols=_O, g="cust % 100", order="-total, okey", src="o WHERE status = 79"))
_found("group_limit", lambda f: f().group(T.cust).limit(40), _GROUP.format(cols=_O, g="cust", order="okey", src="o") + " ORDER BY okey LIMIT 40")
_add("group_filtered_numitems", lambda s, d: find(orders(s, d), ORDERS, 0, T.status == 79).filter(T.total > 10000000).group(T.cust).limit(10).numbers(), "SELECT (SELECT count(*) FROM o WHERE status = 79) - (SELECT count(*) FROM o WHERE status = 79 AND total > 10000000) + (SELECT count(DISTINCT cust) FROM o WHERE status = 79 AND total > 10000000) AS num_items, (SELECT count(DISTINCT cust) FROM o WHERE status = 79 AND total > 10000000) > 10 AS has_more")
_found("sort_asc", lambda f: f().sort(T.total).limit(50), f"SELECT {_O} FROM o ORDER BY total, okey LIMIT 50")
_found("sort_desc", lambda f: f().sort(-T.total).limit(50), f"SELECT {_O} FROM o ORDER BY total DESC, okey LIMIT 50")
_found("sort_multi", lambda f: f().sort(T.prio, -T.created, T.cust % 10).limit(60), f"SELECT {_O} FROM o ORDER BY prio, created DESC, cust % 10, okey LIMIT 60")
_found("topk_offset", lambda f: f(T.created.year() == 1997).sort(-T.created).offset(20).limit(30), f"SELECT {_O} FROM o WHERE year({_DAY}) = 1997 ORDER BY created DESC, okey LIMIT 30 OFFSET 20")
_found("slice_rows", lambda f: f()[10:25], f"SELECT {_O} FROM o ORDER BY okey LIMIT 15 OFFSET 10")
_found("lineitem_scan", lambda f: f((T.flag == 82) & (T.qty > 30) & (T.discount > 5)), "SELECT line, okey, qty, price, discount, shipped, flag FROM l WHERE flag = 82 AND qty > 30 AND discount > 5", "l")
_add("find_each_table", lambda s, d: find(orders(s, d, False), ORDERS, None, T.prio > 49).sort(-T.total).limit(2).each(), f"SELECT _table, {_O}, k AS _place FROM (SELECT *, row_number() OVER (PARTITION BY _table ORDER BY -total, okey) AS k FROM ot WHERE prio > 49) WHERE k <= 2")
_E = "event, created, kind, value"
_add("multifind", lambda s, d: multifind(events(s, d), EVENTS, [1, 2, 3, 999999], T.kind == 99, limit=25).items(), f"SELECT _table, {_E} FROM e WHERE _table IN (1, 2, 3, 999999) AND kind = 99 ORDER BY event DESC, _table LIMIT 25")
_add("multifind_offset", lambda s, d: multifind(events(s, d), EVENTS, [1, 2, 3], None, offset=5, limit=10).items(), f"SELECT _table, {_E} FROM e WHERE _table IN (1, 2, 3) ORDER BY event DESC, _table LIMIT 10 OFFSET 5")
_add("multifind_dup_ids", lambda s, d: multifind(events(s, d), EVENTS, [1, 1, 2], T.kind == 99).items(), f"SELECT _table, {_E} FROM (SELECT * FROM e WHERE _table IN (1, 2) UNION ALL SELECT * FROM e WHERE _table = 1) WHERE kind = 99")
_add("multifind_num_items", lambda s, d: multifind(events(s, d), EVENTS, [1, 1, 2], T.kind == 99, limit=3).numbers(), "SELECT (SELECT count(*) FROM e WHERE _table IN (1, 2)) + (SELECT count(*) FROM e WHERE _table = 1) AS num_items, (SELECT count(*) FROM e WHERE _table IN (1, 2) AND kind = 99) + (SELECT count(*) FROM e WHERE _table = 1 AND kind = 99) > 3 AS has_more")
_add("num_items", lambda s, d: find(orders(s, d), ORDERS, 0, T.status == 79).filter(T.prio == 49).limit(10).numbers(), "SELECT count(*) FILTER (status = 79) AS num_items, count(*) FILTER (status = 79 AND prio = 49) > 10 AS has_more FROM o")
_add("has_more", lambda s, d: find(orders(s, d), ORDERS, 0).numbers(), "SELECT count(*) AS num_items, false AS has_more FROM o")
_add("pk_numbers", lambda s, d: find(orders(s, d), ORDERS, 0, pk=4711).numbers(), "SELECT 0::BIGINT AS num_items, false AS has_more")
_add("eval_const", lambda s, d: evaluate(s, ["$add", ["$mul", 6, 7], ["$if", ["$lt", 1, 2], 100]]), "SELECT 142::BIGINT AS value")


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth order with its key moved by 5 (so some exist and some don't) and total 1."""
    own = orders(spark, sf_dir)
    return own.where("okey % 10 = 0").select(TABLE, (F.col("okey") + 5).alias("okey"), "cust", F.lit(1).cast("bigint").alias("total"))


_NEW = "SELECT _table, okey + 5 AS okey, cust, 1::BIGINT AS total, 0::BIGINT AS created, 0::BIGINT AS status, 0::BIGINT AS prio FROM o WHERE okey % 10 = 0"
_ALL = f"_table, {_O}"
_add("insert_new", lambda s, d: dml.insert(orders(s, d), _offered(s, d).withColumn("okey", F.col("okey") + 10**9), ORDERS), f"SELECT {_ALL} FROM o UNION ALL SELECT _table, okey + 1000000000, cust, total, created, status, prio FROM ({_NEW})")
_add("insert_conflict", lambda s, d: dml.insert(orders(s, d), _offered(s, d), ORDERS), f"SELECT {_ALL} FROM o UNION ALL SELECT * FROM ({_NEW}) x WHERE okey NOT IN (SELECT okey FROM o)")
_add("upsert", lambda s, d: dml.insert(orders(s, d), _offered(s, d), ORDERS, overwrite=True), f"SELECT {_ALL} FROM o WHERE okey NOT IN (SELECT okey FROM ({_NEW})) UNION ALL {_NEW}")
_add("insert_modified", lambda s, d: dml.modified(orders(s, d), _offered(s, d), ORDERS), f"SELECT _table, okey, okey NOT IN (SELECT okey FROM o) AS modified FROM ({_NEW})")
_add("insert_if_none_match", lambda s, d: dml.insert(orders(s, d, False), _offered(s, d).withColumn("okey", F.col("okey") + 10**9).withColumn(TABLE, F.col("cust")), ORDERS, query=T.prio == 49), f"SELECT {_ALL} FROM ot UNION ALL SELECT cust, okey + 1000000000, cust, total, created, status, prio FROM ({_NEW}) WHERE cust NOT IN (SELECT cust FROM o WHERE prio = 49)")
_add("update_seq", lambda s, d: dml.update(orders(s, d), {"total": T.total + 1, "created": T.total * 2, "status": 1}, T.status == 79, ORDERS), "SELECT _table, okey, cust, CASE WHEN status = 79 THEN total + 1 ELSE total END AS total, CASE WHEN status = 79 THEN (total + 1) * 2 ELSE created END AS created, CASE WHEN status = 79 THEN 1 ELSE status END AS status, prio FROM o")
_add("update_wrap_bits", lambda s, d: dml.update(orders(s, d), {"status": T.total, "prio": -1}, None, ORDERS), "SELECT _table, okey, cust, total, created, total % 256 AS status, 255::BIGINT AS prio FROM o")
_add("remove", lambda s, d: dml.remove(orders(s, d), (T.status == 79) & (T.prio > 50), ORDERS), f"SELECT {_ALL} FROM o WHERE NOT (status = 79 AND prio > 50)")
_WIDER = Schema.of(Field("okey", 50, primary_key=True), Field("cust", 40), Field("total", 20), Field("created", 40), Field("status", 5, signed=True), Field("prio", 8), Field("likes", 20))
_add("schema_upgrade", lambda s, d: _WIDER.conform(orders(s, d)), "SELECT _table, okey, cust, total % 1048576 AS total, created, (status + 16) % 32 - 16 AS status, prio, 0::BIGINT AS likes FROM o")
_add("describe", lambda s, d: NATIONS.describe(s), "SELECT * FROM (VALUES (0, 'nation', 16, false, true), (1, 'region', 8, false, false)) t(position, name, nbits, is_signed, is_primary_key)")
_add("list_tables", lambda s, d: events(s, d).select(TABLE).distinct().orderBy(TABLE).limit(1024), "SELECT DISTINCT _table FROM e ORDER BY 1 LIMIT 1024")
_add("raw_roundtrip", lambda s, d: rawcodec.decode(rawcodec.encode(events(s, d), EVENTS), EVENTS), f"SELECT _table, {_E} FROM e")
_add("raw_tables_roundtrip", lambda s, d: rawcodec.import_tables(rawcodec.export_tables(events(s, d), EVENTS), EVENTS), f"SELECT _table, {_E} FROM e")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to the events: every fifth gets kind 7, every fifteenth goes, new ones come in."""
    own = events(spark, sf_dir)
    row = lambda df, op, shift: df.select((F.col("event") + shift).alias("position"), F.lit(op).alias("op"), *df.columns, F.lit(None).cast("string").alias("query"))
    change = row(own.where("event % 5 = 0").withColumn("kind", F.lit(7).cast("bigint")), "upsert", 0)
    gone = row(own.where("event % 15 = 0"), "remove", 10**9)
    new = row(own.where("event % 7 = 0").withColumn("event", F.col("event") + 10**8), "upsert", 2 * 10**9)
    return change.unionByName(gone).unionByName(new)


_add("changelog_replay", lambda s, d: changelog.replay(events(s, d), _log(s, d), EVENTS), f"SELECT _table, event, created, CASE WHEN event % 5 = 0 THEN 7 ELSE kind END AS kind, value FROM e WHERE event % 15 <> 0 UNION ALL SELECT _table, event + 100000000, created, kind, value FROM e WHERE event % 7 = 0")
_add("changelog_position", lambda s, d: changelog.position(_log(s, d)), "SELECT max(event) FILTER (event % 7 = 0) + 2100000000 AS position, count(*) FILTER (event % 5 = 0) + count(*) FILTER (event % 15 = 0) + count(*) FILTER (event % 7 = 0) AS changes FROM e")
_add("restrict_rows", lambda s, d: restrict(parts(s, d), (T.size > 20) & ~T.size.in_([30, 40]), PARTS), "SELECT _table, part, size, price FROM p WHERE size > 20 AND size NOT IN (30, 40)")
_add("first_row", lambda s, d: s.createDataFrame([find(orders(s, d), ORDERS, 0, T.status == 79).sort(-T.total).first()], ", ".join(f"{n} bigint" for n in ORDERS.names)), f"SELECT {_O} FROM o WHERE status = 79 ORDER BY total DESC, okey LIMIT 1")
_add("count_items", lambda s, d: s.range(1).select(F.lit(find(orders(s, d), ORDERS, 0, T.status == 79).count()).cast("bigint").alias("n")), "SELECT count(*) AS n FROM o WHERE status = 79")


def _clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator of the caller's own in a search."""
    register_op("clamp", lambda x, a, b: F.greatest(a, F.least(x, b)))
    return find(orders(spark, sf_dir), ORDERS, 0, T.prio.clamp(50, 52) == 52).items()


_add("registered_op", _clamped, f"SELECT {_O} FROM o WHERE greatest(50, least(prio, 52)) = 52")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders in the tables of their customers, of which some match the guard of those after them."""
    new = orders(spark, sf_dir).where("okey % 10 = 0").select(F.col("cust").alias(TABLE), (F.col("okey") + 10**9).alias("okey"), "cust", F.expr("(okey div 10) % 3").alias("total"), F.col("okey").alias("_seq"))
    return dml.insert(orders(spark, sf_dir, False), new, ORDERS, query=T.total == 1)


_add("insert_guard_in_turn", _guarded, f"""SELECT {_ALL} FROM ot UNION ALL SELECT x._table, okey + 1000000000, cust, total, 0, 0, 0 FROM (SELECT cust AS _table, okey, cust, (okey // 10) % 3 AS total FROM o WHERE okey % 10 = 0) x
LEFT JOIN (SELECT cust AS _table, min(okey) AS f FROM o WHERE okey % 10 = 0 AND (okey // 10) % 3 = 1 GROUP BY 1) y ON x._table = y._table WHERE (f IS NULL OR okey <= f) AND x._table NOT IN (SELECT cust FROM o WHERE total = 1)""")


def _stored(spark: SparkSession, sf_dir: str) -> Catalog:
    """The events in a catalog on storage, with a few commits: all in, some of table 1 updated, some of table 2 removed."""
    c = Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    c.alter_bucket("events", *EVENTS.fields)
    c.insert("events", None, events(spark, sf_dir))
    c.update("events", 1, T.kind == 99, {"value": T.value + 1})
    c.remove("events", 2, T.event % 2 == 0)
    return c


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the change feed, from its beginning to its end."""
    return _stored(spark, sf_dir).pages("events", limit=20_000).where("op <> 'alter'").select("op", TABLE, "event", "kind", "value")


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of one catalog's feed replayed in another, the first of them and the end twice over."""
    c, to = _stored(spark, sf_dir), Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    to.alter_bucket("events", *EVENTS.fields)
    to.catch_up("events", c, 20_000)
    to.replay("events", c.feed("events", -1, 20_000)[0])
    to.catch_up("events", c, 20_000)
    return to.rows("events")


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream, applied batch by batch to a snapshot."""
    at = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    events(spark, sf_dir).write.parquet(f"{at}/rows")
    log = _log(spark, sf_dir)
    log.repartitionByRange(3, "position").write.parquet(f"{at}/log")
    held = [f"{at}/rows", -1]

    def save(rows: DataFrame, position: int) -> None:
        rows.write.parquet(f"{at}/rows-{position}")
        held[:] = [f"{at}/rows-{position}", position]

    stream = spark.readStream.schema(log.schema).parquet(f"{at}/log")
    changelog.follow(stream, lambda: (spark.read.parquet(held[0]), held[1]), save, EVENTS, f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(held[0])


_KEPT = "SELECT _table, event, created, kind, CASE WHEN _table = 1 AND kind = 99 THEN value + 1 ELSE value END AS value FROM e WHERE NOT (_table = 2 AND event % 2 = 0)"
_add("catalog_rows", lambda s, d: _stored(s, d).rows("events"), _KEPT)
_add("catalog_find", lambda s, d: _stored(s, d).find("events", 1, T.kind == 99).sort(-T.created).limit(50).items(), f"SELECT event, created, kind, value FROM ({_KEPT}) WHERE _table = 1 AND kind = 99 ORDER BY created DESC, event LIMIT 50")
_add("catalog_tables", lambda s, d: _stored(s, d).table_ids("events"), "SELECT DISTINCT _table FROM e WHERE _table <> 2 OR event % 2 <> 0")
_add("catalog_buckets", lambda s, d: s.createDataFrame([(b,) for b in _stored(s, d).list_buckets()], "bucket string"), "SELECT 'events' AS bucket")
_add("changefeed_pages", _fed, "SELECT 'upsert' AS op, _table, event, kind, value FROM e UNION ALL SELECT 'upsert', _table, event, kind, value + 1 FROM e WHERE _table = 1 AND kind = 99 UNION ALL SELECT 'remove', _table, event, kind, value FROM e WHERE _table = 2 AND event % 2 = 0")
_add("changefeed_apply", _applied, _KEPT)
_add("changefeed_follow", _followed, SQL["changelog_replay"].removeprefix(WITH))
