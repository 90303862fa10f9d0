"""Near-duplicate documents: banded MinHash finds candidates, odd sketches thin them out, full shingle sets confirm.

1. Each text gives its set of shingles (runs of ``k`` words, hashed to 64 bits), ``BANDS * rows`` MinHash samples, a key
   for each band of samples, and an odd sketch: sample values are folded into ``SKETCH`` bits by parity, so the population
   count of the XOR of two sketches tells how many samples differ. Texts with equal sets are one class from here on.
2. Classes that share the key of a band are candidates. A bucket is never paired out: in each round every member meets one
   member of its bucket, another in each round, and what is linked by then needs no second link. What has not come together
   after ``ROUNDS`` meets the members of other components of its bucket, and only those whose sketches leave a similarity of
   the threshold possible.
3. The parities of whole sets bound their difference from below, without error. Candidates within both ranges are confirmed on the full sets, by integers: 100 * common >= threshold * union.
4. Components by smallest label with pointer jumping; every step is written to the shared folder.

With bands of ``rows`` samples a link at the threshold is missed with a probability below 1e-5; ``rows`` follows from the
threshold. Sketch range is five standard deviations wide.

Defined results: a text without words, or null, has no shingles and stands alone; with fewer words than ``k`` all of them
are one shingle; repeated rows are each reported. A row belongs to the component of its text: rows that share a number but
not a text may be in several components, of which each is known by the smallest number in it (null if it has none).

Skew: exact copies are one class before anything is joined; copies, members of a bucket and partners of one hub are dealt in
salts where they are more than a share of the rows (``spread_join``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, hot_keys, lean, spread_join, trim

BANDS, SKETCH, PARITY, ROUNDS = 40, 512, 1024, 3
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, _U), np.full(n, base, _U))), dtype=_U)


_POWERS: list[np.ndarray] = [_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word: prefix sums of byte values times powers, differences brought back to power 0."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if n >= len(_POWERS[0]):
        _POWERS[:] = [_powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)]
    inside = np.concatenate(([False], ~_GAPS[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[raw] * _POWERS[0][:n], dtype=_U)))
    return _mix((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(_U))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, _U)
    if not len(w):
        return w
    wide = min(k, len(w))
    out = np.full(len(w) - wide + 1, wide, _U)
    for i in range(wide):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + w[i : len(w) - wide + 1 + i])
    return np.unique(out)


def rows_for(threshold: int, bands: int = BANDS) -> int:
    """The most samples a band may have for a miss below 1e-5 at the threshold (in percent)."""
    per_band = 1 - 1e-5 ** (1 / bands)
    return max(1, int(math.log(per_band) / math.log(threshold / 100)))


def _words64(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


class Sketcher:
    def __init__(self, rows: int):
        self.rows, self.samples = rows, rows * BANDS
        seeds = _mix(np.arange(1, 2 * self.samples + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
        self.mult = (seeds[: self.samples] >> _U(32)).astype(np.uint32) | np.uint32(1)
        self.add = (seeds[self.samples :] >> _U(32)).astype(np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> _U(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        out = np.full(self.samples, 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            for s in range(0, self.samples, 64):
                h = part[None, :] * self.mult[s : s + 64, None]
                h += self.add[s : s + 64, None]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                np.minimum(out[s : s + 64], h.min(axis=1), out=out[s : s + 64])
        return out

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Band keys, the odd sketch of the samples and that of the whole set, as 64-bit words."""
        least = self.minima(shingles).astype(_U)
        at = np.arange(self.samples, dtype=_U)
        keys = np.zeros(BANDS, _U) + np.arange(BANDS, dtype=_U)
        for row in least.reshape(BANDS, self.rows).T:
            keys = _mix(keys * _U(0x9E3779B97F4A7C15) + row)
        flips = _mix(least + (at << _U(32))) % _U(SKETCH)
        bits = np.bincount(flips.astype(np.int64), minlength=SKETCH) & 1
        whole = np.bincount((shingles % _U(PARITY)).astype(np.int64), minlength=PARITY) & 1
        return keys.view(np.int64), _words64(bits), _words64(whole)


def sketch_range(threshold: int, samples: int) -> int:
    """The most bits in which the odd sketches of two sets at the threshold differ, five standard deviations included."""
    j = threshold / 100
    low = max(0.0, j - 5 * math.sqrt(j * (1 - j) / samples + 1 / samples / 4))
    return math.ceil(SKETCH / 2 * (1 - math.exp(-2 * (2 * (1 - low) * samples) / SKETCH)) + 5)


SIGNED = "text_hash bigint, cls bigint, n bigint, bands array<bigint>, sketch array<bigint>, parity array<bigint>"


def signatures(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """row (a number of its own), doc_id, text_hash, and of the text's set: cls (64 bits that tell sets apart), n, band keys and odd sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        own = Sketcher(rows)
        for b in batches:
            out = []
            for t in b["text"]:
                s = shingle_set(t if isinstance(t, str) else None, k)
                if len(s):
                    keys, sketch, parity = own.of(s)
                    cls = (_mix(s).sum(dtype=_U) + _U(len(s))).view(np.int64)
                    out.append((int(cls), len(s), keys, sketch, parity))
                else:
                    out.append((None, 0, None, None, None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield b.drop(columns="text").assign(cls=pd.array(cols[0], "Int64"), n=cols[1], bands=cols[2], sketch=cols[3], parity=cols[4])
            del b, out, cols
            trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, f"row bigint, doc_id {kind}, {SIGNED}")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """cls and the full set of shingles of every row of ``docs`` (cls, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "shingles": [shingle_set(t, k).tobytes() for t in b["text"]]})

    return docs.select("cls", "text").mapInPandas(run, "cls bigint, shingles binary")


def _differing(a: str, b: str, bits: int) -> Column:
    """Bits in which two odd sketches differ."""
    parts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough. A class of many pairs has its set copied to the salts of these, not to one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for p in batches:
            good = []
            for x, y in zip(p["sa"], p["sb"], strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= threshold * (len(both) - common))
            yield p.loc[good, ["a", "b"]]

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    pairs = cut(pairs, "pairs")
    met = spread_join(spread_join(pairs, left, "a", F.col("b")), right, "b", F.col("a"), hot_keys(pairs, "b"))
    return met.select("a", "b", "sa", "sb").mapInPandas(run, "a bigint, b bigint")


def components(nodes: DataFrame, links: DataFrame, name: str = "label") -> DataFrame:
    """``nodes`` (cls) with the smallest cls that the links (a, b) reach."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = cut(nodes.select("cls", F.col("cls").alias(name)), "labels")
    while True:
        near = both.join(now.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.min(name).alias("near"))
        step = now.join(near, now["cls"] == near["a"], "left").select("cls", F.col(name).alias("was"), F.least(name, "near").alias("mid"))
        jump = step.select(F.col("cls").alias("mid"), F.col("mid").alias("far"))
        new = cut(step.join(jump, "mid", "left").select("cls", "was", F.least("mid", "far").alias(name)), "labels")
        if new.where(F.col("was") != F.col(name)).isEmpty():
            return new.select("cls", name)
        now = new.select("cls", name)


def _split(held: DataFrame) -> DataFrame:
    """key, most (the label of most rows, of several the largest, so that every evaluation agrees) and parts of buckets of several labels."""
    sized = held.groupBy("key", "label").agg(F.count("*").alias("c"))
    return sized.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1")


def link_classes(docs: DataFrame, signed: DataFrame, k: int, threshold: int, rows: int) -> DataFrame:
    """cls and label (the component's smallest cls) of the classes that have any candidate."""
    reach = sketch_range(threshold, rows * BANDS)
    # one row of each class, which is told by its number, so that copies meet in no task
    heads = signed.where("n > 0").groupBy("cls").agg(F.min("row").alias("row")).select("row")
    classes = cut(signed.join(heads, "row", "left_semi"), "classes")
    posted = classes.select("cls", F.explode("bands").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = cut(posted.join(shared, "key"), "members")
    crowded = cut(hot_keys(members, "key"), "crowded")
    alive = members.select("cls").distinct()
    met = cut(classes.drop("bands").join(alive, "cls", "left_semi"), "sketches")
    small = met.select("cls", "n", "sketch", "parity")
    # the text of one document of each class stands for its set; rows may be repeated
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    first = met.select("cls", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = own.join(first, (own["text_hash"] == F.col("hash")) & own["doc_id"].eqNullSafe(F.col("id"))).select("cls", "text").dropDuplicates(["cls"])
    sets = cut(sets_of(texts, k), "sets")
    left = small.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("oa"), F.col("parity").alias("pa"))
    right = small.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("ob"), F.col("parity").alias("pb"))
    fits = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (_differing("oa", "ob", SKETCH) <= reach)
    # sets at the threshold differ in so many shingles at most, and parity bits can't differ in more places: exact
    fits = fits & ((100 + threshold) * _differing("pa", "pb", PARITY) <= (100 - threshold) * (F.col("na") + F.col("nb")))
    label = small.select("cls", F.col("cls").alias("label"))
    links = None
    for turn in range(ROUNDS):
        held = members.join(label, "cls")
        chance = F.xxhash64("cls", F.lit(turn))
        host = held.groupBy("key").agg(F.min_by(F.struct("cls", "label"), chance).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
        met = spread_join(held, host.select("key", "h"), "key", F.col("cls"), crowded).where(F.col("label") != F.col("h.label"))
        pairs = cut(met.select("cls", F.least("cls", "h.cls").alias("a"), F.greatest("cls", "h.cls").alias("b")).distinct(), "met")
        near = spread_join(spread_join(pairs, left, "a", F.col("b")), right, "b", F.col("a"), hot_keys(pairs, "b")).where(fits)
        if turn == 0:  # to begin with each member takes the closest host of its buckets: one link each brings most groups together
            near = near.groupBy("cls").agg(F.min_by(F.struct("a", "b"), F.struct(_differing("pa", "pb", PARITY), F.col("a"), F.col("b"))).alias("p")).select("p.*")
        near = near.select("a", "b").distinct()
        found = cut(confirm(near, sets, threshold), "found")
        links = found if links is None else links.union(found)
        # what a link has joined so far: the smallest label at either end, taken one step on
        ends = found.join(label.withColumnRenamed("cls", "a").withColumnRenamed("label", "la"), "a").join(label.withColumnRenamed("cls", "b").withColumnRenamed("label", "lb"), "b")
        down = ends.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to")).where(F.col("label") != F.col("to")).groupBy("label").agg(F.min("to").alias("to"))
        label = cut(label.join(down, "label", "left").select("cls", F.coalesce("to", "label").alias("label")), "label")
    label = components(small.select("cls"), links)
    held = members.join(label, "cls")
    split = _split(held)
    open_ = held.join(split, "key").join(small, "cls")
    # pairs across components: one side is outside the largest component of the bucket; each pair is met once
    a = open_.where(F.col("label") != F.col("most")).select("key", F.col("cls").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("sketch").alias("oa"), F.col("parity").alias("pa"))
    b = open_.select("key", F.col("cls").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("sketch").alias("ob"), F.col("parity").alias("pb"), (F.col("label") == F.col("most")).alias("top"))
    once = F.col("top") | (F.col("a") < F.col("b"))
    crossed = a.join(b, (a["key"] == b["key"]) & (F.col("la") != F.col("lb")) & once & fits)
    late = crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = cut(confirm(late, sets, threshold), "found")
    if more.isEmpty():
        return label
    # components of components
    joined = more.join(label.withColumnRenamed("cls", "a").withColumnRenamed("label", "la"), "a").join(label.withColumnRenamed("cls", "b").withColumnRenamed("label", "lb"), "b")
    over = components(label.select(F.col("label").alias("cls")).distinct(), joined.select(F.col("la").alias("a"), F.col("lb").alias("b")), "root")
    return label.join(over.withColumnRenamed("cls", "label"), "label").select("cls", F.col("root").alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its group) and kept of every row of ``docs`` (doc_id, text)."""
    rows = rows_for(threshold)
    docs = docs.select("doc_id", "text")
    signed = cut(signatures(docs, k, rows), "signed")
    label = cut(link_classes(docs, signed, k, threshold, rows), "components")
    least = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    grouped = least.join(label, "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = grouped.join(smallest, "label").select("cls", "component_id")
    mine = signed.select("row", "doc_id", "cls", F.col("n").alias("n_shingles"))
    found = spread_join(mine.where("cls IS NOT NULL"), by_class, "cls", F.col("row"))
    out = found.unionByName(mine.where("cls IS NULL"), allowMissingColumns=True)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
