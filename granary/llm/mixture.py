"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Of all document rates r with sum(size * r) = target in each source, balancing takes those nearest to 1 in relative
entropy: they are exp(lambda of the source), and lambda solves the convex dual sum(size) * exp(lambda) - target * lambda.
Newton's iterations run for all sources at once on their totals, which hold all that the dual needs of the documents, until
the largest residual is within ``CLOSE`` of its target; so do those for the level at which capped targets leave the rest.
Sources are a table like any other (they may be millions of hosts): nothing gathers them in one task.

Rates are rounded into copies: each document gets floor(rate), and the fraction decides how many documents of each cell
(source, size) get one more: first by running rounding over the cells from large to small, then what that leaves of the
target is filled up, or taken away, from the smallest sizes on. In a cell documents are taken by the hash of their number,
so reruns agree. Cells are small (a row for each size of a source); documents of a cell are dealt into parts of about
``PART`` by another hash and ranked within them, so that no source or size has to pass through one task.

Defined results: null text has size 0; a source without words takes nothing; null is a source, ranked last; repeated
rows count and are taken as rows of their own; rows without a number are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD_GAP, cut

WEIGHTS = (5, 2, 1)
CAP = 3
PART = 5000
#: Newton steps between two looks at the residual, and the residual (as a share of the target) at which they end.
STEPS, CLOSE = 12, 1e-12


def size_of(text: Column) -> Column:
    """Number of words."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    blank = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    n = F.size(parts) - blank(1) - F.when(F.size(parts) > 1, blank(-1)).otherwise(0)
    return n.cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank by code point, null last, from 0: sorted by ranges, and counted on from range to range."""
    order = F.col("source").asc_nulls_last()
    dealt = cut(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, nth = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row a range
    return dealt.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + nth).drop("__part", "__before", "__at")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size: one row each) with weight and target.

    All sizes are shared by weight; a target stops at ``cap`` times its source's size and the excess is shared among the
    others. So targets are min(cap * size, level * weight), and the level is what the capped ones leave by the weight that is
    left: each step takes it from those that are capped at the level before, and ends when these stay the same.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(_ranked(sources).withColumn("weight", weight).drop("rank"), "weights")
    limit = F.lit(float(cap)) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = limit <= F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        total, kept, left, n = ranked.agg(F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == capped or not left:
            break
        level, capped = ((total or 0) - (kept or 0.0)) / left, n
    return ranked.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def rates(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` (source_size, target) with rate = exp(lambda), by Newton's method on the dual."""
    size, goal = F.col("source_size").cast("double"), F.col("target")
    newton = lambda lam, _: lam - (size * F.exp(lam) - goal) / (size * F.exp(lam))
    some = (size > 0) & (goal > 0)
    now = sources.withColumn("lam", F.lit(0.0))
    while True:
        step = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("lam"), newton)
        now = cut(now.withColumn("lam", F.when(some, step).otherwise(F.lit(0.0))), "lambdas")
        worst = now.where(some).agg(F.max(F.abs(size * F.exp("lam") - goal) / goal)).first()[0]
        if worst is None or worst <= CLOSE:
            break
    rate = F.when(some, F.least(F.exp("lam"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    # an integer within rounding errors is that integer
    return now.withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)).drop("lam")


def _cells(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """source, size, n, base and extra: how many of the n documents of a cell get a copy more than base."""
    cells = docs.where(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n"))
    joined = cells.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    cells = joined.select("c.source", "c.size", "c.n", "s.target", F.floor("s.rate").alias("base"), (F.col("s.rate") - F.floor("s.rate")).alias("part"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source")
    upto = F.sum("n").over(down)
    cells = cells.withColumn("upto", upto)
    half = F.lit(0.5)
    cells = cells.withColumn("first", F.when(F.col("part") > 0, F.floor(F.col("upto") * F.col("part") + half) - F.floor((F.col("upto") - F.col("n")) * F.col("part") + half)).otherwise(F.lit(0)))
    cells = cells.withColumn("first", F.least(F.greatest(F.col("first"), F.lit(0)), F.col("n")))
    lack = F.col("target") - F.sum((F.col("n") * F.col("base") + F.col("first")) * F.col("size")).over(whole)
    cells = cells.withColumn("lack", F.when(F.col("part") > 0, lack).otherwise(F.lit(0.0)))
    spare = F.when(F.col("lack") >= 0, F.col("n") - F.col("first")).otherwise(F.col("first"))
    cells = cells.withColumn("spare", spare).withColumn("reach", F.sum(F.col("spare") * F.col("size")).over(up))
    room = F.abs("lack") - (F.col("reach") - F.col("spare") * F.col("size"))
    more = F.greatest(F.lit(0), F.least(F.col("spare"), F.floor(room / F.col("size"))))
    return cells.select("source", "size", "n", "base", (F.col("first") + F.signum("lack").cast("bigint") * more).alias("extra"))


def _rank_hash() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("mark"), F.lit(17))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row of ``docs`` (doc_id, text, source)."""
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")), "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = cut(rates(sources, cap), "sources")
    cells = cut(_cells(sized, sources), "cells")
    cells = cells.withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))
    part = F.coalesce(F.pmod(F.xxhash64("d.doc_id", "d.mark", F.lit(29)), F.col("c.parts")), F.lit(0)).cast("int")
    dealt = sized.alias("d").join(cells.alias("c"), same, "left").select("d.*", "c.n", "c.base", "c.extra", part.alias("part"))
    # the quota of a part: running rounding over the parts of its cell
    held = dealt.where(F.col("extra") > 0).groupBy("source", "size", "part").agg(F.count("*").alias("held"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    upto = F.sum("held").over(Window.partitionBy("source", "size").orderBy("part"))
    share = lambda k: F.floor(k * F.col("extra") / F.col("n"))
    quotas = held.withColumn("upto", upto).select("source", "size", "part", (share(F.col("upto")) - share(F.col("upto") - F.col("held"))).alias("quota"))
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(_rank_hash(), "doc_id", "mark"))
    placed = dealt.withColumn("place", place)
    fits = F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.size") == F.col("q.size")) & (F.col("p.part") == F.col("q.part"))
    copied = placed.alias("p").join(quotas.alias("q"), fits, "left").select("p.doc_id", "p.source", "p.size", (F.coalesce("p.base", F.lit(0)) + F.when(F.col("p.place") <= F.coalesce("q.quota", F.lit(0)), 1).otherwise(0)).alias("copies"))
    out = copied.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
    return out.select("d.doc_id", "d.size", "s.source_size", "s.target", (F.col("d.copies") * F.col("d.size")).cast("bigint").alias("taken"))
