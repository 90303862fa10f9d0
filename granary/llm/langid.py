"""Language identification with words first and character n-grams behind them.

A word is a run of letters (Unicode categories L*), in lower case. A model has, for each language, log frequencies of words
and of character n-grams of 1 to 5 letters of ``^word$``, whose ends are marked; every length is a distribution of its own.
A text is scored word by word: a known word by its log frequencies, an unknown one by its n-grams of the longest length of
which the model knows any, else of the next shorter length. The language with the largest sum wins; ties go to the language
with more training documents, then to the smaller name.

Training: at most ``TRAIN_DOCS`` documents of each language in expectation, taken by a hash of their number, so the cost of
fitting does not grow with the corpus; the model is a table in the shared folder with every word and n-gram of that sample;
prediction covers every document and its whole text, and uses nothing but that text.

Defined results: a null text or one without letters is ``und`` with score 0, as are all if nothing could be learned; rows
with null language or number are not learned from; a text of unknown letters alone gets the most frequent language;
repeated rows are kept.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, lean, put, remembered, trim

TRAIN_DOCS = 3000
LONGEST = 5
NONE = "und"
CACHE = 100_000
#: Places of a long word whose n-grams are made at once.
STRIDE = 4096
_ALNUM = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _numerals() -> dict[int, str]:
    """Signs such as one half or Roman eight, which Python's \\w has and letters have not, as gaps."""
    return {i: " " for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Nl", "No")}


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    text = text.lower()
    if not text.isascii():
        gaps = _numerals()
        if any(ord(c) in gaps for c in set(text)):
            text = text.translate(gaps)
    return _ALNUM.findall(text)


def _sample(rows: DataFrame, counts: dict[str, int], key: Column) -> DataFrame:
    """Of each language the rows whose hash falls in a share that leaves about ``TRAIN_DOCS``."""
    cuts = [F.when(F.col("lang") == lang, F.lit(min(1.0, TRAIN_DOCS / n))) for lang, n in counts.items()]
    return rows.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < F.coalesce(*cuts) * (1 << 30))


def fit(docs: DataFrame, learn: Column, key: Column) -> dict[str, Any]:
    """The model of the labelled rows (text, lang) for which ``learn`` holds; ``key`` tells rows apart."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if not langs:
        return {"langs": []}
    tokens = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    met = _sample(rows, counts, key).select("lang", tokens.alias("word")).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    met = cut(met, "words")
    marked, size = F.concat(F.lit("^"), F.col("word"), F.lit("$")), F.length("word") + 2
    # a long word is cut at every STRIDE places, so that no row holds more than their n-grams
    strides = met.select("lang", "n", marked.alias("marked"), size.alias("size"), F.explode(F.sequence(F.lit(1), size, F.lit(STRIDE))).alias("at"))
    end = lambda k: F.least(F.col("at") + STRIDE - 1, F.col("size") - k + 1)
    one = lambda k: F.when(end(k) >= F.col("at"), F.transform(F.sequence(F.col("at"), end(k)), lambda i: F.substr(F.substr("marked", F.col("at"), F.lit(STRIDE + LONGEST)), i - F.col("at") + 1, k))).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), one))
    by_gram = strides.select("lang", F.explode(grams).alias("entry"), "n").where(~F.col("entry").isin("^", "$"))
    # words are of length 0
    every = by_gram.select(F.length("entry").alias("k"), "entry", "lang", "n").unionByName(met.select(F.lit(0).alias("k"), F.col("word").alias("entry"), "lang", "n"))
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)]
    return {"langs": langs, "path": put(every.groupBy("k", "entry").agg(*by_lang), "model")}


def read(model: dict[str, Any], k: int) -> tuple[pa.Array, np.ndarray]:
    """The entries of one length, by their length in bytes and then sorted, and their log frequencies by language."""
    system, path = fs.FileSystem.from_uri(model["path"] if "://" in model["path"] else f"file://{model['path'].removeprefix('file:')}")
    found = pq.read_table(path, filesystem=system, filters=[("k", "=", k)])
    entries = found["entry"].combine_chunks().cast(pa.binary())
    order = pc.sort_indices(pa.table({"n": pc.binary_length(entries), "e": entries}), [("n", "ascending"), ("e", "ascending")])
    # the sums do not depend on the order
    counts = np.stack([found[f"l{i}"].to_numpy().astype(np.float64) for i in range(len(model["langs"]))], axis=1) + 0.5
    return entries.take(order), np.log(counts / counts.sum(axis=0))[order.to_numpy()]


class Words:
    """Places of words in a list: fixed-width arrays of the words of each length in bytes, a tenth of what a dict takes."""

    def __init__(self, entries: pa.Array):
        self.entries, self.of = entries, {}
        sizes = np.asarray(pc.binary_length(entries))
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        data = entries.buffers()[2]
        base = int(np.frombuffer(entries.buffers()[1], np.int32)[entries.offset]) if len(entries) else 0
        for n, at, many in zip(*np.unique(sizes, return_index=True, return_counts=True), strict=True):
            self.of[int(n)] = np.frombuffer(data, f"S{n}", int(many), base + int(ends[at])), int(at)

    def place(self, word: str) -> int | None:
        raw = word.encode()
        found = self.of.get(len(raw))
        if found is None:
            return None
        at = int(found[0].searchsorted(raw))
        return found[1] + at if at < len(found[0]) and found[0][at] == raw else None

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self) -> Iterator[str]:
        return (x.as_py().decode() for x in self.entries)


class Identifier:
    """Scores texts; words met are remembered up to ``CACHE``, and only these are in a dict."""

    def __init__(self, model: dict[str, Any]):
        self.langs, self.base, self.known, self.grams = model["langs"], Words(pa.array([], pa.binary())), np.zeros((0, 0)), {}
        if self.langs:
            entries, self.known = read(model, 0)
            self.base = Words(entries)
            for k in range(1, LONGEST + 1):
                entries, logs = read(model, k)
                entries = np.array(entries.cast(pa.string()).to_pylist(), f"U{k}")
                order = entries.argsort()
                self.grams[k] = entries[order], logs[order]
            trim()
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.matrix = np.zeros((CACHE, max(1, len(self.langs))))

    def logs(self, word: str) -> np.ndarray:
        """The log frequencies of a word by language."""
        at = self.base.place(word)
        return self.backed_off(word) if at is None else self.known[at]

    def backed_off(self, word: str) -> np.ndarray:
        """The mean of the log frequencies of the longest n-grams known, taken as one word."""
        marked = f"^{word}$"
        for k in range(LONGEST, 0, -1):
            entries, logs = self.grams[k]
            met = [g for g in (marked[i : i + k] for i in range(len(marked) - k + 1)) if g not in "^$"]
            if met and len(entries):
                met = np.array(met, entries.dtype)
                at = np.minimum(np.searchsorted(entries, met), len(entries) - 1)
                at = at[entries[at] == met]
                if len(at):
                    return logs[at].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else []
        if not found or not self.langs:
            return NONE, 0.0
        if len(self.index) + len(found) > len(self.matrix):
            self.reset()
        rows = list(map(self.index.get, found))
        if None in rows:
            for i, at in enumerate(rows):
                if at is None:
                    word = found[i]
                    at = self.index.get(word)
                    if at is None:
                        if len(self.index) >= len(self.matrix):
                            self.matrix = np.concatenate((self.matrix, np.zeros_like(self.matrix)))
                        at = self.index[word] = len(self.index)
                        self.matrix[at] = self.logs(word)
                    rows[i] = at
        total = self.matrix[rows].sum(axis=0)
        best = int(total.argmax())
        odds = np.exp((total - total[best]) / math.sqrt(len(found)))
        return self.langs[best], float(1.0 / odds.sum())


@remembered(1)
def _loaded(langs: tuple[str, ...], path: str | None) -> Identifier:
    """The model of a worker, read once."""
    return Identifier({"langs": list(langs), "path": path})


def predict(docs: DataFrame, model: dict[str, Any]) -> DataFrame:
    """``docs`` (text) with lang_pred and score; no shuffle, and only texts go to Python. Workers read the model from the shared folder."""
    langs, path = tuple(model["langs"]), model.get("path")

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean(_loaded)
        own = _loaded(langs, path)
        for b in batches:
            # texts become Python's one by one: a batch of them is held once
            found = [own.predict(t.as_py()) for t in b]
            del b
            trim()
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang_pred", "score"])

    # as it may not be evaluated twice, for a filter and for the result
    seen = docs.withColumn("__seen", run.asNondeterministic()("text"))
    return seen.select(*docs.columns, "__seen.lang_pred", "__seen.score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held = F.coalesce(fold == 2, F.lit(False))
    model = fit(docs.select("doc_id", "text", "lang"), F.coalesce(fold != 2, F.lit(False)), F.col("doc_id"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
