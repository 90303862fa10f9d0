"""Token counts by prefix dynamic programming over byte-pair encodings.

For a pre-token ``w`` the last token of the encoding of every prefix ``w[:i]`` is found from shorter prefixes:
it is the one vocabulary entry ``t`` that ends at ``i`` and may follow the last token of ``w[:i - len(t)]``, which is
so when encoding the two together gives the two back.  The count at ``i`` is then one more than at ``i - len(t)``.
A text's counts are the sums over its pre-tokens.  ``PrefixTable`` stores the count at every prefix of a text, so truncation
is a lookup and a budget a binary search; ``token_counts`` needs it only for the part in which a text meets its limit.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; other columns stay away
from the result unless asked for with ``keep``; texts may be of any length (work is linear in it).
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from granary.llm.common import pieces


#: Entries kept in a worker's caches before they are emptied: bounds its memory, not the result.
CACHE = 500_000
PAIR_CACHE = 500_000
#: Bytes by which the tokens that may end a prefix are found.
END = 4
#: Bytes of pieces that are compared to see how far two begin alike.
HEAD = 32
#: Letters that are letters in any Unicode version, after a space or none, and one stop or comma, which is a token of its own.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_RUN = re.compile(r"\s\s")
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: White space for Python, not for the tokenizers library.
_NO_SPACE = "\x1c\x1d\x1e\x1f"


def _blank(text: str) -> bool:
    return text.isspace() and not any(c in text for c in _NO_SPACE)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of one byte-level BPE file of the tokenizers library, for whole texts and all prefixes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        as_byte = _byte_chars()
        raw = lambda s: bytes(as_byte[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if all(c in as_byte for c in s)}
        self.longest = max(map(len, self.vocab))
        self.as_byte = as_byte
        special = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.tokens = sorted(self.vocab)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        sizes: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) >= END:
                sizes.setdefault(t[-END:], set(range(1, END))).add(len(t))
        #: For the last bytes of a prefix how long tokens that end there may be, longest first.
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in sizes.items()}
        #: As ``pairs``, by token numbers: the first times the number of tokens plus the second; no first is one beyond the last.
        self.known: dict[int, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain byte-pair merging of a short piece; serves only to judge pairs of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank, none = self.rank.get, 1 << 30
        while len(parts) > 1:
            ranks = [rank(x, none) for x in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` then ``b`` is how the two are encoded together; with no ``a``, whether ``b`` alone is one token."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def prefixes(self, piece: bytes, after: tuple[bytes, list[int], list[bytes]] | None = None) -> tuple[bytes, list[int], list[bytes]]:
        """Token count and last token of ``piece[:i]`` for i from 0 to its length; taken over from ``after``, the table of another piece, as far as both begin alike."""
        vocab, longest, pairs = self.vocab, self.longest, self.pairs
        counts, last = [0], [b""]
        if after:
            n = len(os.path.commonprefix((piece, after[0])))
            counts, last = after[1][: n + 1], after[2][: n + 1]
        for i in range(len(counts), len(piece) + 1):
            for j in range(max(0, i - longest), i):
                t = piece[j:i]
                if t not in vocab:
                    continue
                fits = pairs.get((last[j], t))
                if self.may_follow(last[j], t) if fits is None else fits:
                    counts.append(counts[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends {piece[:i]!r}")
        return piece, counts, last

    def pieces(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a chunk without special strings, by the library's own rule; a space and plain letters are one."""
        if chunk.isascii() and chunk[1:].isalpha() and chunk[0] == " ":
            return [chunk.encode()]
        return [bytes(map(self.as_byte.__getitem__, s)) for s, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def fresh(self, chunk: str) -> tuple[int, list[bytes]]:
        """The number of special strings in a chunk, and the pre-tokens between them."""
        if not self.special or "<" not in chunk or not self.special.search(chunk):
            return 0, self.pieces(chunk)
        return len(self.special.findall(chunk)), [p for x in self.special.split(chunk) if x for p in self.pieces(x)]

    def totals(self, pieces: list[bytes]) -> list[int]:
        """Counts of whole pieces, in sorted order: each takes over the table of the one before as far as both begin alike."""
        head = np.array(pieces, f"S{HEAD}").view(np.uint8).reshape(-1, HEAD)
        alike = (head[1:] == head[:-1]).cumprod(axis=1, dtype=np.uint8).sum(axis=1).tolist()
        ids, sizes, pairs, many, short = self.ids.get, self.sizes.get, self.known.get, len(self.ids), range(END - 1, 0, -1)
        out, counts, last = [], [0], [many]
        for piece, n in zip(pieces, [0, *alike], strict=True):
            n = min(n, len(piece), len(counts) - 1)
            del counts[n + 1 :], last[n + 1 :]
            for i in range(n + 1, len(piece) + 1):
                for n in sizes(piece[i - END : i], short) if i >= END else short:
                    if n > i or (t := ids(piece[i - n : i])) is None:
                        continue
                    j = i - n
                    k = last[j] * many + t
                    fits = pairs(k)
                    if fits is None:
                        fits = self._judge(k)
                    if fits:
                        counts.append(counts[j] + 1)
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no token ends {piece[:i]!r}")
            out.append(counts[-1])
        return out

    def _judge(self, k: int) -> bool:
        """``may_follow`` for the pair of token numbers in ``k``."""
        a, b = divmod(k, len(self.ids))
        if len(self.known) >= PAIR_CACHE:
            self.known.clear()
        a, b = self.tokens[a] if a < len(self.tokens) else b"", self.tokens[b]
        fits = self.known[k] = self.merged(a + b) == ([a, b] if a else [b])
        return fits

    def learn(self, chunks: set[str]) -> dict[str, int]:
        """Counts of chunks not met before. Letters, with a stop or comma or not, are cut here, and then known by the letters."""
        words = {c: m for c in chunks if (m := _WORD.fullmatch(c))}
        found = {c: self.fresh(c) for c in chunks if c not in words}
        known = self.chunks.get
        need = {w.encode(): w for w in {m[1] for m in words.values()} if known(w) is None}
        order = sorted(need.keys() | {p for _, ps in found.values() for p in ps})
        of = dict(zip(order, self.totals(order), strict=True)) if order else {}
        out = {w: of[p] for p, w in need.items()}
        for c, m in words.items():
            if c not in out:
                n = out.get(m[1])
                out[c] = (known(m[1]) if n is None else n) + len(m[2])
        return out | {c: n + sum(map(of.__getitem__, ps)) for c, (n, ps) in found.items()}

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each whole text."""
        return [n for n, _ in self.fits(texts)]

    def fits(self, texts: list[str], limit: int | None = None) -> list[tuple[int, int]]:
        """The number of tokens of each whole text, and the most characters of a prefix with at most ``limit`` tokens."""
        parts = [self.cuts(t) if t else [] for t in texts]
        now = self.learn({c for cs in parts for c in cs if c not in self.chunks})
        if len(self.chunks) + len(now) > CACHE:
            now |= {c: self.chunks[c] for cs in parts for c in cs if c in self.chunks}
            self.chunks = {}
        self.chunks |= now
        out = []
        for t, cs in zip(texts, parts, strict=True):
            n = sum(map(self.chunks.__getitem__, cs))
            out.append((n, len(t) if limit is None or n <= limit else self._fit(cs, limit)))
        if len(self.chunks) > CACHE:
            self.chunks = {}
        return out

    def _fit(self, parts: list[str], limit: int) -> int:
        """The most characters with at most ``limit`` tokens of a text that has more: the part that reaches the limit decides."""
        upto = list(accumulate(map(self.chunks.__getitem__, islice((c for c in parts if c), limit + 1))))
        some = [c for c in islice((c for c in parts if c), limit + 1)]
        k = bisect_left(upto, limit)
        chars = sum(map(len, some[:k]))
        if upto[k] == limit:
            return chars + len(some[k])
        room = limit - (upto[k - 1] if k else 0)
        counts = self.chunk_prefixes(some[k])
        return chars + max(i for i, n in enumerate(counts) if n <= room)

    def _plain_prefixes(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without special strings, by character."""
        out, base, before, last = [0], 0, 0, ""
        for piece in self.pieces(text):
            s, table = piece.decode(), self.prefixes(piece)[1]
            at, ends = 0, []
            for c in s:
                at += len(c.encode())
                ends.append(at)
            counts = [base + table[e] for e in ends]
            if len(s) > 1 and s[0] == "'" and s[1:].isalpha():
                # cut short, an apostrophe and letters are two pre-tokens
                letters = self.prefixes(s[1:].encode())[1]
                counts[1:-1] = [base + table[1] + letters[e - 1] for e in ends[1:-1]]
            if last and _blank(last) and _blank(s[0]):
                # white space is one pre-token until something follows it
                counts[0] = before + self.prefixes((last + s[0]).encode())[1][-1]
            out += counts
            before, base, last = base, base + table[-1], s
        return out

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Counts of all prefixes of a chunk, by character."""
        if not self.special or "<" not in chunk:
            return self._plain_prefixes(chunk)
        out, base, at = [0], 0, 0
        for m in self.special.finditer(chunk):
            # the beginning of a special string is plain text still
            plain = self._plain_prefixes(chunk[at : m.end() - 1])
            out += [base + n for n in plain[1:]]
            base, at = base + plain[m.start() - at] + 1, m.end()
            out.append(base)
        return out + [base + n for n in self._plain_prefixes(chunk[at:])[1:]]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The text in parts that are encoded apart: it is cut before each single space between non-spaces."""
        first, *rest = _GAP.split(text) if _RUN.search(text) else text.split(" ")
        return [first, *(" " + x for x in rest)]

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Exact counts of every prefix of one text, by character offset."""

    def __init__(self, counter: PrefixCounter, text: str):
        known: dict[str, list[int]] = {}
        self.counts = array("q", [0])
        for chunk in counter.cuts(text) if text else []:
            if chunk not in known:
                known[chunk] = counter.chunk_prefixes(chunk)
            base = self.counts[-1]
            self.counts.extend(base + n for n in known[chunk][1:])
        self.total = self.counts[-1]
        # the least count of this or a longer prefix, which never falls
        self._least = array("q", list(accumulate(reversed(self.counts), min))[::-1])

    def at(self, chars: int) -> int:
        """Tokens of ``text[:chars]``."""
        return self.counts[min(chars, len(self.counts) - 1)]

    def fit(self, budget: int) -> int:
        """The most characters of a prefix with at most ``budget`` tokens."""
        return max(0, bisect_right(self._least, budget) - 1)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """``keep``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) and fit_chars (of the longest prefix within the limit) for each row; no shuffle."""
    fields = [docs.schema[c] for c in keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for b in pieces(batches):
            texts = [t if isinstance(t, str) else "" for t in b["__text"]]
            n, fit = zip(*own.fits(texts, limit), strict=True) if texts else ((), ())
            out = b.drop(columns="__text")
            yield out.assign(n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=[x > limit for x in n], fit_chars=fit)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    return docs.select(*keep, docs[text].alias("__text")).mapInPandas(count, out)
