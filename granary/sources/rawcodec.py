"""Packed records: the fields of a row back to back, lowest bit first, padded to whole bytes.

Bits are taken and put by Column arithmetic on the bytes, so a table of any size is packed where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.model import TABLE, Field, Schema, wrap_mode


def record_size(schema: Schema) -> int:
    return (sum(f.nbits for f in schema.fields) + 7) // 8


def get_bits(data: bytes, offset: int, f: Field) -> int:
    """A field's value from packed bytes."""
    raw = int.from_bytes(data, "little") >> offset & ((1 << f.nbits) - 1)
    return f.wrap_int(raw)


def pack_row(schema: Schema, values: dict[str, int]) -> bytes:
    out, at = 0, 0
    for f in schema.fields:
        out |= (values.get(f.name, 0) & ((1 << f.nbits) - 1)) << at
        at += f.nbits
    return out.to_bytes(record_size(schema), "little")


def unpack_row(schema: Schema, data: bytes) -> dict[str, int]:
    out, at = {}, 0
    for f in schema.fields:
        out[f.name] = get_bits(data, at, f)
        at += f.nbits
    return out


def _byte(parts: list[tuple[Column, int, int]], k: int) -> Column:
    """Byte ``k`` of a record, from the fields (value, offset, width) that reach into it."""
    out = F.lit(0).cast("bigint")
    for value, at, nbits in parts:
        if at < 8 * k + 8 and at + nbits > 8 * k:
            up = 8 * k - at
            bits = F.shiftrightunsigned(value, up) if up > 0 else F.shiftleft(value, -up)
            room = min(8, at + nbits - 8 * k)
            out = out.bitwiseOR(bits.bitwiseAND(F.lit((1 << room) - 1).cast("bigint")))
    return out


def encode(rows: DataFrame, schema: Schema) -> DataFrame:
    """_table, primary key and record (binary) of every row."""
    with wrap_mode(rows.sparkSession):
        parts, at = [], 0
        for f in schema.fields:
            parts.append((F.col(f.name), at, f.nbits))
            at += f.nbits
        hexed = F.concat(*[F.lpad(F.hex(_byte(parts, k)), 2, "0") for k in range(record_size(schema))])
        return rows.select(TABLE, schema.pk.name, F.unhex(hexed).alias("record"))


def decode(records: DataFrame, schema: Schema) -> DataFrame:
    """Rows from _table and record; bytes beyond the schema's are ignored."""
    with wrap_mode(records.sparkSession):
        byte = lambda k: F.conv(F.hex(F.substring("record", k + 1, 1)), 16, 10).cast("bigint")
        cols, at = [], 0
        for f in schema.fields:
            value = F.lit(0).cast("bigint")
            for k in range(at // 8, (at + f.nbits + 7) // 8):
                up = 8 * k - at
                value = value.bitwiseOR(F.shiftleft(byte(k), up) if up >= 0 else F.shiftrightunsigned(byte(k), -up))
            cols.append(f.wrap(value).alias(f.name))
            at += f.nbits
        return records.select(F.col(TABLE).cast("bigint").alias(TABLE), *cols)


def export_tables(rows: DataFrame, schema: Schema) -> DataFrame:
    """_table, chunk and data: the records of each table in key order; a large table comes in several chunks, in order of keys."""
    packed = encode(rows, schema).repartitionByRange(TABLE, schema.pk.name).withColumn("chunk", F.spark_partition_id())
    ordered = F.array_sort(F.collect_list(F.struct(F.col(schema.pk.name).alias("k"), F.hex("record").alias("h"))))
    return packed.groupBy(TABLE, "chunk").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("data"))


def import_tables(tables: DataFrame, schema: Schema) -> DataFrame:
    """Rows of exported tables, taken as they are: neither order nor keys are checked."""
    n = record_size(schema)
    starts = F.sequence(F.lit(0), F.floor(F.length("data") / n).cast("int") - 1)
    cut = F.transform(starts, lambda i: F.substr(F.col("data"), i * n + 1, F.lit(n)))
    return decode(tables.where(F.length("data") >= n).select(TABLE, F.explode(cut).alias("record")), schema)
