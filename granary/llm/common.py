"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.shared import shared_dir

#: Words are maximal runs of anything but these: space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What this process remembers: Python workers outlive tasks and stages, and so does this.
_REMEMBERED: list[Any] = []


def remembered(maxsize: int) -> Callable[[Callable], Any]:
    """``functools.lru_cache`` for what a worker keeps from task to task, until another operator begins (see ``lean``)."""

    def cached(make: Callable) -> Any:
        _REMEMBERED.append(functools.lru_cache(maxsize=maxsize)(make))
        return _REMEMBERED[-1]

    return cached


def trim() -> None:
    """Gives free memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def lean(own: Any = None) -> None:
    """Drops what operators before this one left in a worker, except ``own``: a stage that follows another starts from an empty one."""
    others = [f for f in _REMEMBERED if f is not own and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()
    trim()


#: Scratch tables written so far by this driver.
_WRITTEN: list[str] = []


def written() -> int:
    """How many scratch tables this driver has written."""
    return len(_WRITTEN)


def drop_scratch(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Deletes the scratch tables written after the first ``since``, except some; results that read them must be written out by then."""
    for path in _WRITTEN[since:]:
        if path not in but:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN[since:] = [p for p in _WRITTEN[since:] if p in but]


def put(df: DataFrame, name: str) -> str:
    """The path of ``df``, written as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    path = put(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches, which Spark bounds by bytes, in pieces of a few hundred rows, for work that multiplies the size of a text."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` with more than 1 / (4 P) of its rows (P shuffle partitions), so at most 4 P of them, and in how many salts to deal each."""
    share = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n")).first()[0] or 0
    return counted.where(F.col("__n") * share > total).select(key, F.ceil(F.col("__n") * share / max(1, total)).cast("int").alias("__salts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: DataFrame | None = None) -> DataFrame:
    """``left`` with the row of ``right`` for its key, where there is one: hot keys are dealt by a hash of ``spread`` and their rows of ``right`` copied."""
    hot = F.broadcast(hot_keys(left, key) if hot is None else hot)
    dealt = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copies = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")
