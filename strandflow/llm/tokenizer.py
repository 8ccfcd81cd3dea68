"""Encoding of a corpus with a byte-level BPE vocabulary, as arrays over whole batches.

Texts are split by the vocabulary's pattern with array operations on the UTF-8 buffer; equal pre-tokens of a chunk, found
by a hash and compared byte by byte, are encoded once. Merges run from a queue of buckets that hold linked-list positions
by merge rank under a two-level bitmap: find-first-set gives the next bucket, stale entries are skipped, and all places of
a bucket are merged at once. Long pre-tokens have a bucket for every rank, so that they take as many steps as they have
different ranks, not places. Those of up to LONG bytes share buckets of WIDTH ranks; there, in each pre-token the lowest
rank of the bucket is merged first and the rest waits in the bucket, which gives the same merges in fewer steps.

Defined results: null and empty texts have no ids (an empty list). The vocabulary file is a parameter, read on the driver
and sent to the executors; nothing is trained.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WIDTH, LONG, NONE, CHUNK = 1024, 256, np.int32(2**30), 4_000_000
#: The white space of the pattern's \\s (fixed by Unicode).
SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, BLANK = range(4)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


@functools.cache
def char_classes() -> np.ndarray:
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))[0]
        kinds[i] = LETTER if c == "L" else NUMBER if c == "N" else OTHER
    kinds[SPACE] = BLANK
    return kinds


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


class RankQueue:
    """Buckets of `width` ranks with the positions pushed for them, under a bitmap of two levels of 256 bits and more."""

    def __init__(self, width: int):
        self.width, self.buckets, self.top, self.low = width, {}, 0, {}

    def push(self, rank: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        bucket = rank // self.width if self.width > 1 else rank
        order = np.argsort(bucket, kind="stable")
        bucket, at = bucket[order], at[order]
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        ends = [0, *cuts.tolist(), len(at)]
        for b, i, j in zip(bucket[[0, *cuts]].tolist(), ends, ends[1:]):
            if b in self.buckets:
                self.buckets[b].append(at[i:j])
            else:
                self.buckets[b] = [at[i:j]]
                self.top |= 1 << (b >> 8)
                self.low[b >> 8] = self.low.get(b >> 8, 0) | 1 << (b & 255)

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest bucket and its positions, by the first set bits."""
        high = (self.top & -self.top).bit_length() - 1
        word = self.low[high]
        b = high << 8 | (word & -word).bit_length() - 1
        self.low[high] = word = word & (word - 1)
        if not word:
            self.top &= self.top - 1
        parts = self.buckets.pop(b)
        return b, parts[0] if len(parts) == 1 else np.concatenate(parts)


class Merges:
    """Ranks of pairs of token ids in an open hash table, and the queue that applies them."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.size = 1 << (len(keys) * 4).bit_length()
        self.keys, self.values = np.full(self.size, -1, np.int64), np.full(self.size, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) % self.size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * BASE) >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], NONE)
        todo = np.flatnonzero((at != keys) & (at != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % self.size
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at != -1)]
        return out

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end in data, and the number of ids of each word."""
        long = lengths > LONG
        if not long.any():
            return self.merged(data, lengths, WIDTH)
        at = np.repeat(long, lengths)
        out, count = None, np.zeros(len(lengths), np.int64)
        parts = [self.merged(data[at == kind], lengths[long == kind], width) for kind, width in ((False, WIDTH), (True, 1))]
        for kind, (_, n) in zip((False, True), parts):
            count[long == kind] = n
        out = np.empty(count.sum(), np.int32)
        from_long = np.repeat(long, count)
        for kind, (ids, _) in zip((False, True), parts):
            out[from_long == kind] = ids
        return out, count

    def merged(self, data: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        token, word = self.byte[data], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lengths)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        rank, alive = np.full(n, NONE, np.int32), np.ones(n, bool)
        least = np.full(len(lengths), NONE, np.int32)
        queue = RankQueue(width)
        first = np.flatnonzero(after >= 0).astype(np.int32)
        rank[first] = self.rank(token[first], token[after[first]])
        first = first[rank[first] < NONE]
        queue.push(rank[first], first)
        while queue.top:
            bucket, at = queue.pop()
            at = np.unique(at[rank[at] // width == bucket])  # without the stale
            if not len(at):
                continue
            wait, p = at[:0], at
            if width > 1:
                w, r = word[at], rank[at]
                np.minimum.at(least, w, r)
                take = r == least[w]
                least[w] = NONE
                wait, p = at[~take], at[take]
            # In a chain of one pair overlapping itself every second place is merged, from the left.
            chain = after[p[:-1]] == p[1:]
            if chain.any():
                chain, place = np.r_[False, chain], np.arange(len(p))
                p = p[(place - np.maximum.accumulate(np.where(chain, 0, place))) % 2 == 0]
            q = after[p]
            token[p], alive[q], rank[q] = rank[p], False, NONE
            nxt = after[q]
            after[p] = nxt
            linked = nxt >= 0
            before[nxt[linked]] = p[linked]
            prev = before[p]
            rank[p] = NONE
            pl = p[linked]
            rank[pl] = self.rank(token[pl], token[nxt[linked]])
            prev = prev[prev >= 0]
            rank[prev] = self.rank(token[prev], token[after[prev]])
            new = np.concatenate([wait, pl, prev])
            new = new[rank[new] < NONE]
            queue.push(rank[new], new)
        return token[alive], np.bincount(word[alive], minlength=len(lengths))


@functools.lru_cache(4)
def merges(vocabulary: bytes) -> Merges:
    return Merges(vocabulary)


def vocabulary_of(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file (about a megabyte) on every executor."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def split_points(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets where pre-tokens start in UTF-8 texts laid end to end; bounds are the offsets where texts start."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        m = np.flatnonzero((code >= low) & (code < high) & (data[at] >= low))
        if len(m):
            c = data[at[m]].astype(np.int32) & mask
            for i in range(1, more + 1):
                c = c << 6 | (data[at[m] + i] & 0x3F)
            code[m] = -c  # marked: not to be read as a lead byte again
    code = np.abs(code)
    n, kind = len(code), char_classes()[code]
    text = np.zeros(n + 1, bool)
    text[np.searchsorted(at, bounds[bounds < len(data)])] = True
    text[n] = True
    run = text.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[0] = True
    start = run.copy()
    # The last blank before other characters leaves its run; a plain space joins what follows.
    last = np.flatnonzero((kind == BLANK) & run[1:] & ~text[1:])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    # 's 't 're 've 'm 'll 'd where a token can begin.
    quote = np.flatnonzero((code == 39) & run[:n] & start[:n] & ~text[1:])
    if len(quote):
        pad = np.r_[code, 0, 0, 0]
        one, two = pad[quote + 1], np.where(text[np.minimum(quote + 2, n)], 0, pad[quote + 2])
        size = np.where(np.isin(one, [115, 116, 109, 100]), 2, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + size] = True
    return at[np.flatnonzero(start[:n])]


def unique_pieces(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces laid end to end: for each the number of its kind, and of each kind a piece. Pieces of a kind are equal byte by byte."""
    up, down = powers(1 << (len(data)).bit_length())
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    key = (total[begins + sizes] - total[begins]) * down[begins] ^ (sizes.astype(np.uint64) << np.uint64(40))
    code, unique = pd.factorize(key)
    first = np.empty(len(unique), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    # The key only proposes: what differs from the first of its kind is a kind of its own.
    other = sizes != sizes[first][code]
    same = np.flatnonzero(~other & (first[code] != np.arange(len(code))))
    n = sizes[same]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    differ = data[np.repeat(begins[same], n) + at] != data[np.repeat(begins[first[code[same]]], n) + at]
    if differ.any():
        other[same[np.add.reduceat(differ, ends - n) > 0]] = True
    if other.any():
        odd = np.flatnonzero(other)
        code[odd] = len(first) + np.arange(len(odd))
        first = np.r_[first, odd]
    return code, first


def encode_texts(data: np.ndarray, bounds: np.ndarray, merge: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end in UTF-8 (bounds: their offsets and the end), and the number of ids of each text."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
    begins = split_points(data, bounds[:-1])
    sizes = np.diff(np.r_[begins, len(data)])
    code, first = unique_pieces(data, begins, sizes)
    lengths = sizes[first]
    ends = np.cumsum(lengths)
    ids, count = merge.encode(data[np.repeat(begins[first] - (ends - lengths), lengths) + np.arange(ends[-1])], lengths)
    offset = np.cumsum(count) - count
    each = count[code]
    done = np.cumsum(each)
    out = ids[np.repeat(offset[code] - (done - each), each) + np.arange(done[-1])]
    # Texts begin where a pre-token begins; the rest is counting.
    before = np.r_[0, done][np.searchsorted(begins, bounds)]
    return out, np.diff(before)


def encoded(column: pa.Array, vocabulary: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows of a string column: first and last row, ids, and number of ids by row."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, merge = len(column), merges(vocabulary)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        ids, count = encode_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], merge)
        yield i, j, ids, count
        i = j


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """id_col, ids: the token ids of every text."""
    shared = vocabulary_of(df, path)

    def run(batches):
        for b in batches:
            for i, j, ids, count in encoded(b.column(1), shared.value):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], [id_col, "ids"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} long, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """id_col, n: the number of tokens of every text."""
    shared = vocabulary_of(df, path)

    def run(batches):
        for b in batches:
            parts = [count for *_, count in encoded(b.column(1), shared.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts or [np.zeros(0)]).astype(np.int64))], [id_col, "n"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} long, n long")
