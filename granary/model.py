"""Schemas of integer records: bit widths, validation, wrapping stores and additive evolution."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE = "_table"
MAX_FIELDS, MAX_NAME = 64, 29


class GranaryError(Exception):
    """Base of all errors of this package."""


class SchemaError(GranaryError):
    pass


class ExprError(GranaryError):
    pass


class DataError(GranaryError):
    pass


@contextmanager
def wrap_mode(spark: SparkSession) -> Iterator[None]:
    """Plans built inside have integer arithmetic that wraps; the session's own setting comes back at the end."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@dataclass(frozen=True)
class Field:
    name: str
    nbits: int
    signed: bool = False
    primary_key: bool = False

    def wrap(self, value: Column) -> Column:
        """``value`` as the field stores it: modulo 2^nbits, in two's complement if signed."""
        if self.nbits == 64:
            return value
        if self.signed:
            up = F.shiftleft(value, 64 - self.nbits)
            return F.shiftright(up, 64 - self.nbits)
        return value.bitwiseAND(F.lit((1 << self.nbits) - 1).cast("bigint"))

    def wrap_int(self, value: int) -> int:
        value &= (1 << self.nbits) - 1
        top = self.nbits if self.signed else 64
        return value - (1 << top) if value >> (top - 1) & 1 and top <= self.nbits else value


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        fs = self.fields
        if len(fs) > MAX_FIELDS:
            raise SchemaError(f"{len(fs)} fields; {MAX_FIELDS} are the most")
        names = [f.name for f in fs]
        if len(set(names)) < len(names):
            raise SchemaError("a field name occurs twice")
        for f in fs:
            if not re.fullmatch(r"[0-9a-z_]+", f.name) or len(f.name) > MAX_NAME:
                raise SchemaError(f"bad field name {f.name!r}")
            if not 1 <= f.nbits <= 64 or f.signed and f.nbits == 64:
                raise SchemaError(f"{f.name}: {f.nbits} bits cannot be stored")
        if sum(f.primary_key for f in fs) != 1:
            raise SchemaError("a schema has exactly one primary key")

    @classmethod
    def of(cls, *fields: Field | dict) -> Schema:
        def one(f: Field | dict) -> Field:
            if isinstance(f, Field):
                return f
            return Field(f["name"], int(f["nbits"]), bool(f.get("is_signed", f.get("signed", False))), bool(f.get("is_primary_key", f.get("primary_key", False))))

        return cls(tuple(map(one, fields)))

    @property
    def pk(self) -> Field:
        return next(f for f in self.fields if f.primary_key)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ExprError(f"no field {name!r}")

    def struct(self) -> T.StructType:
        meta = lambda f: {"nbits": f.nbits, "signed": f.signed, "pk": f.primary_key}
        return T.StructType([T.StructField(TABLE, T.LongType(), False), *(T.StructField(f.name, T.LongType(), False, meta(f)) for f in self.fields)])

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.name, f.nbits, f.signed, f.primary_key) for i, f in enumerate(self.fields)]
        return spark.createDataFrame(rows, "position int, name string, nbits int, is_signed boolean, is_primary_key boolean")

    def to_json(self) -> str:
        return json.dumps([asdict(f) for f in self.fields])

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls(tuple(Field(**f) for f in json.loads(text)))

    def check_upgrade(self, new: Schema) -> None:
        """Raises unless rows of this schema may be read as rows of ``new``."""
        gone = set(self.names) - set(new.names)
        if gone:
            raise SchemaError(f"fields would be lost: {sorted(gone)}")
        a, b = self.pk, new.pk
        if a.name != b.name:
            raise SchemaError("the primary key keeps its name")
        if b.nbits < a.nbits or a.signed and not b.signed or b.signed and not a.signed and b.nbits <= a.nbits:
            raise SchemaError("the primary key would not hold its values")

    def conform(self, df: DataFrame) -> DataFrame:
        """Rows by field name: what is missing or null is 0, everything wraps to its width."""
        has = set(df.columns)
        with wrap_mode(df.sparkSession):
            cols = [f.wrap(F.coalesce(F.col(f.name).cast("bigint"), F.lit(0).cast("bigint")) if f.name in has else F.lit(0).cast("bigint")).alias(f.name) for f in self.fields]
            table = F.col(TABLE).cast("bigint") if TABLE in has else F.lit(0).cast("bigint")
            return df.select(table.alias(TABLE), *cols)


def check_columns(schema: Schema, columns: Iterable[str]) -> None:
    extra = set(columns) - set(schema.names) - {TABLE}
    if extra:
        raise DataError(f"unknown fields: {sorted(extra)}")
