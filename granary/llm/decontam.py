"""Benchmark decontamination, in DataFrame operations alone.

Documents are cut into windows as wide as a benchmark item. A window is contaminated if the multiset of its word shingles
(runs of ``K`` words, lower case, no punctuation) has a weighted Jaccard similarity of at least ``PERCENT`` with the item's;
the weight of a shingle is the number of its occurrences.

1. A window so similar lacks at most 20 % of an item's shingles, so of each item's rarest shingles just over 20 % serve as
   anchors: every such window holds one. Anchors are looked up in all documents at once (by broadcast up to
   ``BROADCAST_ROWS``, by shuffle beyond) and tell which windows of an item's size are cut at all; of these, ones with too few of
   the item's shingles, counted exactly, are left out. This is exact and only there because windows at every place of every
   document, in every size, could not be fingerprinted.
2. Windows and items get SimHash fingerprints of ``BITS`` bits; windows of equal words share one. A multi-index finds the items
   for a window: fingerprints fall into ``BLOCKS`` blocks, and of two within ``RADIUS`` bits at least one block differs in
   ``PROBE`` bits or fewer, so each item is posted under every value within ``PROBE`` bits of each of its blocks, and windows are
   joined to items of their size by (block, value). The population count of the XOR then holds all 256 bits to the radius.
   At the threshold 38.9 bits differ, give or take 5.7; the radius is 4.5 deviations wide.
3. What is left is decided on the shingles themselves, by integers.

Defined results: null and empty texts are clean; an item of fewer than ``K`` words is one shingle of all its words, and an
item without words matches nothing; a document shorter than an item is one window; repeated rows are each reported; rows
are told apart by number and text, so rows that share a number are judged one by one. Items are told apart by their words:
those of equal words are judged once and reported under each of their numbers; of different ones that share a number, or
have none, each is judged, and the number (null too) is reported once, with the largest similarity.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut

K, PERCENT = 5, 80
BITS, RADIUS, BLOCKS, PROBE = 256, 65, 22, 2
#: More anchors, or links between windows and items, than this are joined by shuffle; so are more than five times as many postings.
BROADCAST_ROWS = 200_000
#: Where the blocks of a fingerprint begin and end; none crosses two of its 64-bit words.
EDGES = [(w * 64 + lo, w * 64 + hi) for w, n in enumerate((6, 6, 5, 5)) for lo, hi in [(round(i * 64 / n), round((i + 1) * 64 / n)) for i in range(n)]]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: the optimizer may move a column's definition into a lambda that runs for every element, but not this variable's."""
    return F.transform(F.array(value), then)[0]


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, in order; none if there are fewer words."""
    run = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    return _let(hashes, run)


def _counted(shingles: Column) -> Column:
    """A multiset as a set: the i-th occurrence of a shingle is an element of its own."""

    def count(own: Column) -> Column:
        nth = lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(own, F.lit(1), i + 1), lambda x: x == h)))
        plain = F.size(F.array_distinct(own)) == F.size(own)
        return F.when(plain, F.transform(own, lambda h: F.xxhash64(h, F.lit(1)))).otherwise(F.transform(own, nth))

    return _let(shingles, count)


def _simhash(elements: Column, most: int) -> Column:
    """Words of 64 bits; a bit is set where more elements have it than not. ``most``: no array has more elements.

    The 64 bits of a word are counted side by side: slice i of the counter holds bit i of all 64 counts, and an element is
    added by carrying it through the slices.
    """
    zero, ones = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    slices = max(1, most.bit_length())

    def word(seed: int) -> Column:
        def add(acc: Column, h: Column) -> Column:
            out, carry = [], h
            for i in range(slices):
                out.append(acc[f"s{i}"].bitwiseXOR(carry).alias(f"s{i}"))
                carry = acc[f"s{i}"].bitwiseAND(carry)
            return F.struct(*out)

        def above_half(acc: Column) -> Column:
            above, same = zero, ones
            for i in reversed(range(slices)):
                # all 64 counts are compared with half of the elements, bit by bit from the top
                half = -F.call_function("shiftright", F.call_function("shiftright", F.size(elements).cast("bigint"), F.lit(1)), F.lit(i)).bitwiseAND(F.lit(1).cast("bigint"))
                above = above.bitwiseOR(same.bitwiseAND(acc[f"s{i}"]).bitwiseAND(F.bitwise_not(half)))
                same = same.bitwiseAND(F.bitwise_not(acc[f"s{i}"].bitwiseXOR(half)))
            return above

        seeded = F.transform(elements, lambda h: F.xxhash64(h, F.lit(seed)))
        return F.aggregate(seeded, F.struct(*[zero.alias(f"s{i}") for i in range(slices)]), add, above_half)

    return F.array(*[word(100 + i) for i in range(BITS // 64)])


def _fingerprinted(df: DataFrame, shingles: str, elements: str, fp: str, most: int) -> DataFrame:
    """``df`` with the elements and the fingerprint of a column of shingles, written down: each is used many times."""
    counted = cut(df.withColumn(elements, _counted(F.col(shingles))), elements)
    return cut(counted.withColumn(fp, _simhash(F.col(elements), most)), fp)


def _blocks(fp: str) -> Column:
    """The blocks of a fingerprint, as structs of number, value and width."""

    def one(b: int, lo: int, hi: int) -> Column:
        down = F.call_function("shiftrightunsigned", F.col(fp)[lo // 64], F.lit(lo % 64)).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint"))
        return F.struct(F.lit(b).alias("b"), down.alias("v"), F.lit(hi - lo).alias("wide"))

    return F.array(*[one(b, lo, hi) for b, (lo, hi) in enumerate(EDGES)])


def _flips(wide: int) -> list[int]:
    """All patterns of at most ``PROBE`` bits in so many."""
    return [sum(1 << i for i in some) for n in range(PROBE + 1) for some in combinations(range(wide), n)]


def _apart(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)])


def propose(windows: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """``windows`` (k, s, own_fp and others) with the item of every item (item, k, s, fp) of their size whose fingerprint is within the radius."""
    widths = sorted({hi - lo for lo, hi in EDGES})
    masks = reduce(lambda c, w: c.when(F.col("x.wide") == w, F.array(*[F.lit(m).cast("bigint") for m in _flips(w)])), widths[1:], F.when(F.col("x.wide") == widths[0], F.array(*[F.lit(m).cast("bigint") for m in _flips(widths[0])])))
    posted = items.select("item", "k", "s", "fp", F.explode(_blocks("fp")).alias("x")).select("item", "k", "s", "fp", "x.b", "x.v", F.explode(masks).alias("mask"))
    posted = posted.select("item", "k", "s", "fp", "b", F.col("v").bitwiseXOR(F.col("mask")).alias("v"))
    asked = windows.withColumn("x", F.explode(_blocks("own_fp"))).select(*windows.columns, "x.b", "x.v")
    met = asked.join(F.broadcast(posted) if small else posted, ["k", "s", "b", "v"]).where(_apart("own_fp", "fp") <= RADIUS)
    return met.select("k", "s", "wid", "item").distinct()


def _named(benchmark: DataFrame) -> DataFrame:
    """item_id, w (hashed words) and item (a hash of these) of items that have words."""
    hashed = benchmark.select("item_id", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    return hashed.withColumn("item", F.xxhash64("w"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a hash of its words), k (its shingle width), m (words), s (shingles), these, elements and fp of items that have words, once each."""
    hashed = _named(benchmark).dropDuplicates(["item"])
    k = F.least(F.size("w"), F.lit(K))
    own = F.when(F.size("w") >= K, _shingles(F.col("w"), K)).otherwise(F.array(F.xxhash64("w")))
    out = hashed.select("item", k.alias("k"), F.size("w").alias("m"), own.alias("shingles")).withColumn("s", F.size("shingles"))
    most = out.agg(F.max("s")).first()[0] or 0
    return _fingerprinted(out, "shingles", "elements", "fp", most)


def _anchors(items: DataFrame) -> DataFrame:
    """k, sh, item, s: of each item the rarest shingles that together outweigh what a similar window may lack."""
    placed = items.select("item", "k", "m", "s", F.posexplode("shingles").alias("off", "sh"))
    common = placed.groupBy("k", "sh").agg(F.count_distinct("item").alias("df"))
    rare = Window.partitionBy("item", "k", "m").orderBy("df", "sh", "off")
    ranked = placed.join(common, ["k", "sh"]).withColumn("rank", F.row_number().over(rare) - 1)
    # ranks 0 to floor(s / 5) hold s / 5 occurrences and one more
    return ranked.where(F.col("rank") <= F.floor(F.col("s") * (100 - PERCENT) / 100)).select("k", "sh", "item", "s").distinct()


def _hashed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash and all shingles of every row, in order."""
    every = _shingles(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)), k)
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), every.alias("all"))


def _region() -> list[Column]:
    """What windows that hold the shingle at ``pos`` can reach: base (where it begins) and region."""
    base = F.greatest(F.col("pos") - F.col("s") + 1, F.lit(0))
    return [base.alias("base"), F.slice("all", base + 1, F.col("s") * 2 - 1).alias("region")]


def _starts() -> Column:
    """Where in a region windows begin that hold the anchor, no anchor before it, and enough of the item's shingles.

    An occurrence of one of the item's shingles counts however often the item has it, so the count is never too small; an
    earlier anchor of the item opens the windows that hold it itself.
    """
    own = F.col("pos") - F.col("base")
    places = F.sequence(F.lit(0), F.size("region") - 1)
    before = F.array_max(F.filter(places, lambda i: (i < own) & F.array_contains("anchors", F.get("region", i))))
    low = F.greatest(F.coalesce(before + 1, F.lit(0)), F.lit(0))
    high = F.least(F.col("pos"), F.greatest(F.col("n") - F.col("s"), F.lit(0))) - F.col("base")
    least = F.ceil((F.col("s") + F.least("s", "n")) * PERCENT / (100 + PERCENT))

    def enough(met: Column) -> Column:
        within = lambda at: F.size(F.filter(met, lambda p: (p >= at) & (p < at + F.col("s")))) >= least
        every = F.sequence(low, F.greatest(low, high))
        return F.when((low <= high) & (F.size(met) >= least), F.filter(every, lambda at: within(at)))

    return _let(F.filter(places, lambda i: F.array_contains("shingles", F.get("region", i))), enough)


def _opened(hits: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """The windows of hits (item, k, s, n, pos, base, region): their size, words and a hash of these."""
    own = items.select("item", "shingles", "anchors")
    seen = hits.join(F.broadcast(own) if small else own, "item").withColumn("at", F.explode(_starts()))
    return seen.select("doc_id", "text_hash", "k", "s", F.slice("region", F.col("at") + 1, F.col("s")).alias("window")).withColumn("wid", F.xxhash64("window"))


def _near(docs: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Hits with their regions, by a broadcast of the anchors: they are sliced where the text lies, and nothing else is moved."""
    spread = _hashed(docs, k).select("doc_id", "text_hash", "all", F.size("all").alias("n"), F.posexplode("all").alias("pos", "sh"))
    hits = spread.join(F.broadcast(anchors.where(F.col("k") == k)), "sh")
    return hits.select("doc_id", "text_hash", "item", F.lit(k).alias("k"), "s", "n", "pos", *_region())


def _far(docs: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Hits with their regions, by a shuffle of shingles: only places pass through it, and texts with places are hashed once more."""
    spread = _hashed(docs, k).select("doc_id", "text_hash", F.posexplode("all").alias("pos", "sh"))
    hits = spread.join(anchors.where(F.col("k") == k), "sh")
    seen = hits.select("doc_id", "text_hash", "item", "s", "pos").distinct()
    places = seen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "s", "pos")).alias("places"))
    places = cut(places, "places").withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    held = own.join(places, own["doc_id"].eqNullSafe(F.col("id")) & (own["text_hash"] == F.col("hash"))).select("doc_id", "text", "places")
    again = cut(held, "held").select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode("places").alias("x"), _shingles(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)), k).alias("all"))
    return again.select("doc_id", "text_hash", "x.item", "x.s", "x.pos", "all", F.size("all").alias("n")).select("doc_id", "text_hash", "item", F.lit(k).alias("k"), "s", "n", "pos", *_region())


def find(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id and similarity of every contaminated document and the items in it."""
    items = _items(benchmark)
    anchors = cut(_anchors(items), "anchors")
    small = anchors.count() <= broadcast_rows
    widths = sorted(r["k"] for r in items.select("k").distinct().collect())  # K of them at most
    docs = docs.select("doc_id", "text")
    if not widths:
        kind = benchmark.schema["item_id"].dataType
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(None).cast(kind).alias("item_id"), F.lit(None).cast("double").alias("similarity")).where(F.lit(False))
    hits = reduce(DataFrame.unionByName, [(_near if small else _far)(docs, anchors, k) for k in widths])
    held = anchors.groupBy("item").agg(F.collect_set("sh").alias("anchors"))
    opened = cut(_opened(hits, items.join(held, "item"), small), "opened")
    windows = opened.groupBy("k", "s", "wid").agg(F.first("window").alias("window"))
    marked = _fingerprinted(windows, "window", "mine", "own_fp", items.agg(F.max("s")).first()[0])
    postings = items.count() * sum(len(_flips(hi - lo)) for lo, hi in EDGES)
    pairs = propose(marked.select("k", "s", "wid", "own_fp"), items, postings <= 5 * broadcast_rows)
    known = items.select("item", "elements")
    near = pairs.join(marked.select("k", "s", "wid", "mine"), ["k", "s", "wid"]).join(F.broadcast(known) if small else known, "item")
    common = F.size(F.array_intersect("mine", "elements"))
    union = F.size("mine") + F.size("elements") - common
    sure = near.select("k", "s", "wid", "item", common.alias("common"), union.alias("union")).where(F.col("common") * 100 >= F.col("union") * PERCENT)
    sure = cut(sure, "sure")
    few = sure.count() <= broadcast_rows
    places = opened.select("doc_id", "text_hash", "k", "s", "wid").distinct()
    sure = places.join(F.broadcast(sure) if few else sure, ["k", "s", "wid"])
    names = _named(benchmark).select("item", "item_id").distinct()
    told = sure.join(F.broadcast(names) if small else names, "item")
    return told.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.col("common") / F.col("union")).alias("similarity"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and item_id (of the most similar item) of every row of ``docs`` (doc_id, text)."""
    found = find(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.max_by("item_id", F.struct("similarity", -F.col("item_id"))).alias("item_id"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_hash"] == found["text_hash"])
    out = rows.join(found, same, "left").select(rows["doc_id"], "n_items", "item_id")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), "item_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = find(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")
