"""Token-id output as wavelet matrices: one compressed file per shard, read back by rank and select.

A shard holds the ids of consecutive documents.  Plane ``l`` has bit ``width - 1 - l`` of every id, in the order that a
stable sort by the planes before it gives; ``zeros[l]`` counts its 0 bits.  Planes are cut into blocks of ``BLOCK`` bits, and
the file holds the rank before each.  With that a shard answers ``access(i)``, ``rank(id, i)``, ``select(id, k)`` and
``count(id)`` from one or two blocks of each plane; no other is inflated.

File format (little-endian): magic ``WVM2``, u32 width, u64 n ids, u64 n documents, u64 zeros per plane; for each plane the
u64 ranks before its blocks and after the last; the u32 sizes of the zstd frames, then these: one for the document lengths (u64
each), and plane by plane one for each block (packed bits, first bit lowest).
The shards of a table are the rows of a Parquet dataset, one payload a row, so any store that Spark writes to will do.

Defined results: null text has no ids but the end id; documents are ordered by their number, null first, repeated
numbers by text hash; an empty table gives no shard; a text longer than a shard gets a shard of its own.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import lean, pieces, remembered, trim
from granary.sources.shared import shared_dir

MAGIC = b"WVM2"
BLOCK = 1 << 16
#: A shard closes with the document that brings it to so many ids.
SHARD_IDS = 1 << 20
CACHE = 400_000


class WaveletMatrix:
    """Bit-planes of a sequence of non-negative ids in blocks, with the ranks before these; ``block(level, c)`` gives a block's bytes."""

    def __init__(self, block: Callable[[int, int], np.ndarray], ranks: list[np.ndarray], zeros: list[int], n: int):
        self.block, self.ranks, self.zeros, self.n, self.width = block, ranks, zeros, n, len(zeros)

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n, width = len(ids), max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(width):
            bit = (now >> now.dtype.type(width - 1 - level)) & now.dtype.type(1)
            ones = bit.astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            ranks.append(np.concatenate(([0], np.cumsum([np.count_nonzero(ones[a : a + BLOCK]) for a in range(0, n, BLOCK)], dtype=np.int64))))
            # compress goes by places: several times faster than a mask on bits without order
            low = now.compress(~ones)
            zeros.append(len(low))
            now = np.concatenate((low, now.compress(ones)))
        return cls(lambda level, c: planes[level][c * BLOCK // 8 : (c + 1) * BLOCK // 8], ranks, zeros, n)

    @property
    def blocks(self) -> int:
        return -(-self.n // BLOCK)

    def bits(self, level: int) -> np.ndarray:
        whole = np.concatenate([self.block(level, c) for c in range(self.blocks)]) if self.n else np.zeros(0, np.uint8)
        return np.unpackbits(whole, count=self.n, bitorder="little").view(bool)

    def ids(self) -> np.ndarray:
        """All ids in order: the stable sorts are undone from the last plane to the first."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            ones, z = self.bits(level), self.zeros[level]
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = now[:z]
            out[np.flatnonzero(ones)] = now[z:] | kind(1 << (self.width - 1 - level))
            now = out
        return now

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        c, rest = divmod(i, BLOCK)
        ones = int(self.ranks[level][c])
        if rest:
            part = self.block(level, c)
            ones += int(np.bitwise_count(part[: rest // 8]).sum())
            if rest % 8:
                ones += (int(part[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return ones

    def bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // BLOCK)[i % BLOCK // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            b, ones = self.bit(level, i), self.rank1(level, i)
            value, i = value << 1 | b, self.zeros[level] + ones if b else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(self.width):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id among the first ``end``."""
        if value < 0 or value >> self.width:
            return 0
        lo, hi = self._range(value, end)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of an id; -1 if there are fewer."""
        if not 0 <= k < self.count(value):
            return -1
        at = self._range(value, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - level) & 1
            at = self._place(level, at - self.zeros[level] if one else at, one)
        return at

    def _place(self, level: int, k: int, one: int) -> int:
        """The place of bit number ``k`` that is ``one`` in a plane."""
        ranks = self.ranks[level]
        seen = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        c = int(np.searchsorted(seen, k, "right")) - 1
        part = np.unpackbits(self.block(level, c), bitorder="little")
        return c * BLOCK + int(np.flatnonzero(part == one)[k - int(seen[c])])


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A shard's file."""
    import zstandard

    w = WaveletMatrix.of(ids)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    frames = [squeeze(lengths.astype("<u8").tobytes()), *(squeeze(w.block(level, c).tobytes()) for level in range(w.width) for c in range(w.blocks))]
    head = MAGIC + struct.pack(f"<IQQ{w.width}Q", w.width, w.n, len(lengths), *w.zeros) + b"".join(r.astype("<u8").tobytes() for r in w.ranks)
    return head + np.array([len(f) for f in frames], "<u4").tobytes() + b"".join(frames)


def unpack(data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    """A shard's matrix, whose blocks are inflated when they are asked for, and the lengths of its documents."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    width, n, _ = struct.unpack_from("<IQQ", data, 4)
    zeros, at, blocks = struct.unpack_from(f"<{width}Q", data, 24), 24 + 8 * width, -(-n // BLOCK)
    ranks = np.frombuffer(data, "<u8", width * (blocks + 1), at).astype(np.int64).reshape(width, blocks + 1)
    at += ranks.nbytes
    sizes = np.frombuffer(data, "<u4", 1 + width * blocks, at)
    ends = np.cumsum(sizes, dtype=np.int64) + at + sizes.nbytes
    inflate = zstandard.ZstdDecompressor().decompress

    def frame(k: int) -> bytes:
        return inflate(data[int(ends[k]) - int(sizes[k]) : int(ends[k])])

    @functools.lru_cache(maxsize=256)
    def block(level: int, c: int) -> np.ndarray:
        return np.frombuffer(frame(1 + level * blocks + c), np.uint8)

    return WaveletMatrix(block, list(ranks), list(zeros), n), np.frombuffer(frame(0), "<u8").astype(np.int64)


_FIRST = itemgetter(0)
#: In this pattern a run of letters, a digit and a run of other signs are one match each, as far as there is no apostrophe.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The signs of a byte-level vocabulary for bytes that have none of their own.
_SIGNS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: The same for all bytes; the space stays, as it parts words.
_SIGN_OF = np.array([b if b == 32 else _SIGNS.get(b, b) for b in range(256)], "<u4")
#: White space for Python, not for the tokenizers library.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
#: Latin-1 signs that are what they are after every step of such a file: no capitals, no apostrophe, nothing a special string begins with.
_PLAIN = [c for c in map(chr, range(33, 256)) if c not in "'<" and c == c.lower() and unicodedata.category(c)[0] not in "CZ"]
_LETTERS, _DIGITS = ("".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN")
_WORD, _MIXED, _RUNS = f"^[{_LETTERS}]+$", f"^[{''.join(map(re.escape, _PLAIN))}]+$", f"[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+"


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _strings(offsets: np.ndarray, data: pa.Buffer | bytes | None) -> pa.LargeBinaryArray:
    """Byte strings of which each ends where the next begins."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data or b"")])


def _offsets(strings: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)


def _ends(sizes: np.ndarray | list[int]) -> np.ndarray:
    return np.cumsum([0, *sizes], dtype=np.int64) if isinstance(sizes, list) else np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _groups(parts: list[str]) -> Iterator[list[str]]:
    """Parts in runs of about 2^15 characters, each of which goes through the library as one text."""
    number = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) >> 15
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(parts)] if parts else []
    return (parts[a:b] for a, b in itertools.pairwise(edges))


def _merges_only(spec: dict) -> bool:
    """Whether a file cuts plain Latin parts into runs of letters, digits and runs of signs, whose bytes byte-pair merges alone turn into ids, the last of each marked as an end."""

    def steps(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else [s for y in x[inner] for s in steps(y, inner)] if x["type"] == "Sequence" else [x]

    changes = [s for s in steps(spec["normalizer"], "normalizers") if s["type"] not in ("NFC", "Lowercase") and not (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"})]
    cuts = steps(spec["pre_tokenizer"], "pretokenizers")
    split = [s["type"] for s in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PATTERN} and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
    if changes or not split or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"] or spec["model"]["type"] != "BPE" or spec["model"]["dropout"]:
        return False
    end, signs = spec["model"]["end_of_word_suffix"], [chr(_SIGNS.get(b, b)) for b in range(256)]
    return bool(end) and not spec["model"]["continuing_subword_prefix"] and all(c in spec["model"]["vocab"] and c + end in spec["model"]["vocab"] for c in signs)


class Encoder:
    """Ids by the tokenizers library; parts between white space are cut into pre-tokens, which are encoded once and remembered."""

    _GAP = re.compile(r"[ \t\n\r]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        #: Parts may be encoded apart only where the file drops white space and starts a new pre-token after it.
        self.apart = '"Removed"' in steps and "[^\\\\s" in steps and not any(x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16
        self.lowers = '"Lowercase"' in steps
        #: The library with the file's merges only, for pre-tokens that are what they are after every step; no ids but the last of each are ``closing``.
        self.merges = None
        if self.apart and _merges_only(spec):
            self.merges = Tokenizer(self.library.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.closing = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.closing[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        #: Numbers of what was encoded, and the ids by number, in two generations: the older goes when the younger is half of ``CACHE``.
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.table = self.old_table = pa.array([], pa.large_binary())

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def learn(self, parts: list[str]) -> list[bytes]:
        """Ids of parts not met before: many go through the library as one text, told apart by their places in it."""
        out = []
        for some in _groups(parts):
            whole = self.library.encode(" ".join(some), add_special_tokens=False)
            begins = np.fromiter(map(_FIRST, whole.offsets), np.int64)
            edges = (np.searchsorted(begins, _ends([len(p) + 1 for p in some]), "left") * self.kind().itemsize).tolist()
            raw = self.raw(whole.ids)
            out += [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def merge(self, words: list[str]) -> pa.LargeBinaryArray:
        """Ids of pre-tokens of ``_PLAIN`` signs, by the merges of the library's model."""
        found = []
        for some in _groups(words):
            signs = _SIGN_OF[np.frombuffer(" ".join(some).encode(), np.uint8)].tobytes().decode("utf-32-le")
            found.append(np.array(self.merges.encode_batch_fast([signs], add_special_tokens=False)[0].ids, self.kind))
        ids = np.concatenate(found) if found else np.zeros(0, self.kind)
        return _strings(np.concatenate(([0], np.flatnonzero(self.closing[ids]) + 1)) * ids.itemsize, ids.tobytes())

    def lowered(self, text: str) -> str | None:
        """A Latin-1 text that may be cut at all white space, with its letters lowered, as the file does so in any case; a
        special string must not arise from that. None for other texts."""
        if (text.isascii() or _latin(text)) and not any(c in text for c in _NO_SPACE):
            return text if not self.lowers or "<|" in text else text.lower()
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [self.raw(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        # millions of strings and pairs of numbers without a cycle among them: the collector would go through them in vain
        on = gc.isenabled()
        gc.disable()
        try:
            return self._by_parts(texts)
        finally:
            if on:
                gc.enable()

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        plain = [self.lowered(t) for t in texts]
        found = pc.ascii_split_whitespace(pa.array([t for t in plain if t is not None], pa.large_string()))
        cut = iter(self._of_lists(found.flatten(), found.offsets.to_numpy()))
        lists = [self._GAP.split(t) for t, low in zip(texts, plain, strict=True) if low is None]
        others = iter(self._of_lists(pa.array([p for ps in lists for p in ps], pa.large_string()), _ends(np.array([len(ps) for ps in lists], np.int64))))
        return [next(others if low is None else cut) for low in plain]

    def _of_lists(self, parts: pa.Array, edges: np.ndarray) -> list[bytes]:
        """Ids of lists of parts: they are numbered, only the different ones are looked up, and the ids of each are laid in the places of its number."""
        coded = parts.dictionary_encode()
        whole = self.ids_of(coded.dictionary).take(coded.indices)
        cuts, data = _offsets(whole)[edges].tolist(), memoryview(whole.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids_of(self, parts: pa.Array) -> pa.LargeBinaryArray:
        """Ids of different parts."""
        if self.merges is None:
            return self.recall(parts, 0)
        word = pc.match_substring_regex(parts, _WORD).to_numpy(zero_copy_only=False)
        more = np.flatnonzero(~word)
        good = pc.match_substring_regex(parts.take(pa.array(more)), _MIXED).to_numpy(zero_copy_only=False)
        words, mixed, odd = np.flatnonzero(word), more[good], more[~good]
        # a word is known by itself, whatever stands beside it: plain parts are cut into their pre-tokens
        runs = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(parts.take(pa.array(mixed)), f"({_RUNS})", "\\1 ")))
        plain = pa.concat_arrays([parts.take(pa.array(words)), runs.flatten()]).dictionary_encode()
        different = len(plain.dictionary)
        ids = self.recall(pa.concat_arrays([plain.dictionary, parts.take(pa.array(odd))]), different)
        pieces = ids.take(pa.array(np.concatenate((plain.indices.to_numpy(), np.arange(different, len(ids))))))
        ends = _offsets(pieces)[_ends(np.concatenate((np.ones(len(words), np.int64), np.diff(runs.offsets.to_numpy()), np.ones(len(odd), np.int64))))]
        place = np.empty(len(parts), np.int64)
        place[np.concatenate((words, mixed, odd))] = np.arange(len(parts))
        return _strings(ends, pieces.buffers()[2]).take(pa.array(place))

    def recall(self, parts: pa.Array, plain: int) -> pa.LargeBinaryArray:
        """Ids of different pre-tokens, of which the first ``plain`` need merges only, and parts."""
        keys = parts.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        # what was met in the last generation moves over
        before = np.fromiter(map(self.old.get, [keys[i] for i in new.tolist()], itertools.repeat(-1)), np.int64, len(new)) if self.old else np.full(len(new), -1)
        moved, new = new[before >= 0], new[before < 0]
        merged, others = new[new < plain], new[new >= plain].tolist()
        joint = [i for i in others if keys[i] and (keys[i].isascii() or _latin(keys[i]))]
        single = sorted(set(others).difference(joint))
        raw = self.learn([keys[i] for i in joint]) + [self.raw(self.library.encode(keys[i], add_special_tokens=False).ids) if keys[i] else b"" for i in single]
        more = [self.old_table.take(pa.array(before[before >= 0])), self.merge([keys[i] for i in merged.tolist()]), pa.array(raw, pa.large_binary())]
        at = [*moved.tolist(), *merged.tolist(), *joint, *single]
        number[at] = np.arange(len(self.table), len(self.table) + len(at))
        self.known.update(zip([keys[i] for i in at], number[at].tolist(), strict=True))
        self.table = pa.concat_arrays([self.table, *more])
        out = self.table.take(pa.array(number))
        if len(self.known) > CACHE // 2:
            self.old, self.old_table, self.known, self.table = self.known, self.table, {}, self.table[:0]
        return out


@remembered(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


SHARDS = "part int, seq int, n_docs bigint, n_tokens bigint, doc_ids binary, nulls binary, payload binary"


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order, write the shards to ``out`` and return them, read back."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean(encoder)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        end = own.raw([end_id])
        ids, numbers, lengths, total = [], [], [], 0

        def shard() -> pd.DataFrame:
            null = np.array([x is None for x in numbers])
            keys = np.array([0 if x is None else x for x in numbers], "<i8")
            data = pack(np.frombuffer(b"".join(ids), own.kind), np.array(lengths))
            return pd.DataFrame([[part, seq, len(numbers), total, keys.tobytes(), np.packbits(null).tobytes(), data]], columns=[x.split()[0] for x in SHARDS.split(", ")])

        for b in pieces(batches, 2048):
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for number, raw in zip(b["doc_id"], own.encode(texts), strict=True):
                ids += (raw, end)
                numbers.append(None if number is None or number != number else int(number))
                lengths.append(len(raw) // own.kind().itemsize + 1)
                total += lengths[-1]
                if total >= shard_ids:
                    yield shard()
                    ids, numbers, lengths, total, seq = [], [], [], 0, seq + 1
        if numbers:
            yield shard()
        trim()

    rows = docs.select(F.col("doc_id").cast("bigint").cast("decimal(20,0)").alias("doc_id"), "text", F.xxhash64("text").alias("__h"))
    (rows.repartitionByRange(parts, "doc_id", "__h").sortWithinPartitions("doc_id", "__h").drop("__h").mapInPandas(build, SHARDS).write.parquet(out))
    return spark.read.schema(SHARDS).parquet(out)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean(encoder)
        for b in batches:
            for r in b.itertuples():
                matrix, lengths = unpack(r.payload)
                ids, ends = matrix.ids().astype("<u4"), np.cumsum(lengths)
                null = np.unpackbits(np.frombuffer(r.nulls, np.uint8), count=r.n_docs).view(bool)
                numbers = pd.array(np.frombuffer(r.doc_ids, "<i8").astype(np.int64), dtype="Int64")
                numbers[null] = pd.NA
                starts = ends - lengths
                yield pd.DataFrame({"doc_id": numbers, "start": r.before + starts, "n_tokens": lengths, "ids_crc32": [zlib.crc32(ids[a:z]) for a, z in zip(starts, ends, strict=True)]})

    # Places of the shards: their sizes are summed by part, then the parts before each are; no window spans all shards.
    sizes = shards.select("part", "seq", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    before = sizes.withColumn("own", own).join(parts, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("before"))
    placed = shards.join(F.broadcast(before), ["part", "seq"]) if before.count() <= 100_000 else shards.join(before, ["part", "seq"])
    return placed.select("n_docs", "doc_ids", "nulls", "payload", "before").mapInPandas(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Write the shards, read them back, and return the documents found in them."""
    out = out or f"{shared_dir(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    return read_documents(write_shards(docs, path, out, end_id))
