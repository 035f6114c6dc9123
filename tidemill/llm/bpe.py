"""Byte-level BPE encoding and decoding.

The merges of one piece run through a queue of buckets, one bucket for each merge rank. A bucket
holds positions of a doubly linked list of parts; a two-level bitmap over the ranks gives the
lowest rank that has entries by two find-first-set steps. Entries whose pair has changed
since are skipped when they come up. The work for a piece of n bytes is O(n) queue operations, so
pieces of megabytes (a text without any space) need no other path.

Rows are independent: one pass, no shuffle. A null text counts as the empty text: no ids, and the
digests are those of no bytes. Repeated rows each give a row; other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick, ship

#: Pieces that a worker remembers, and the longest piece, in characters, that it remembers.
CACHE_PIECES, CACHE_CHARS = 220_000, 48
#: Pieces of one text that are handled at once.
STRETCH = 1 << 16


#: Single bits of one word of the bitmap.
_BIT = [1 << k for k in range(256)]


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap; empty again after each piece.

    ``low`` has a bit for each rank in words of 256 bits, ``top`` a bit for each word that is not
    zero. The loop in :meth:`Codec.merge` works on these fields directly, as calls would cost more
    than the steps themselves.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 256 + 1)


class Codec:
    """Encoder and decoder for a table of ranks (token bytes to id) and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        # The same pattern for ASCII texts, where the classes of letters, digits and spaces are
        # short lists that the standard module scans faster. Used only if nothing else is in it.
        plain = (
            pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t\n\x0b\x0c\r A-Za-z0-9]")
            .replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
            .replace(r"\s", r"[\t\n\x0b\x0c\r ]").replace(r"\S", r"[^\t\n\x0b\x0c\r ]")
        )
        self.split_ascii = re.compile(plain) if "\\p" not in plain else None
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.cache = _Pieces(self)

    @classmethod
    def of(cls, table: bytes, pattern: str) -> Codec:
        """From the content of a rank file: a base64 token and its rank on each line."""
        rows = (line.split() for line in table.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in rows}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, buckets, low, top, bit = len(piece), self.queue.buckets, self.queue.low, 0, _BIT
        after, before = list(range(1, n + 2)), list(range(-1, n))
        # Rank of the part at a position joined with the next one; -1: none, or no part there.
        pair = [get(piece[i : i + 2], -1) for i in range(n)]
        pair[n - 1] = -1
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    word = rank >> 8
                    top |= bit[word]
                    low[word] |= bit[rank & 255]
                bucket.append(i)
        while top:
            # Find first set: the lowest rank that has entries.
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            lower = False
            while bucket and not lower:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[gone]
                pair[gone] = -1
                after[i] = end
                if end < n:
                    before[end] = i
                    pair[i] = new = get(piece[i : after[end]], -1)
                    if new >= 0:
                        other = buckets[new]
                        if not other:
                            w = new >> 8
                            top |= bit[w]
                            low[w] |= bit[new & 255]
                        heappush(other, i)
                        lower = new < rank
                else:
                    pair[i] = -1
                i = before[i]
                if i >= 0:
                    new = get(piece[i:end], -1)
                    if new != pair[i]:
                        pair[i] = new
                        if new >= 0:
                            other = buckets[new]
                            if not other:
                                w = new >> 8
                                top |= bit[w]
                                low[w] |= bit[new & 255]
                            heappush(other, i)
                            lower = lower or new < rank
            if not bucket:
                low[word] &= ~bit[rank & 255]
                if not low[word]:
                    top &= ~bit[word]
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(get(piece[i:end]))
            i = end
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        split = self.split_ascii if self.split_ascii and text.isascii() else self.split
        one = self.cache.__getitem__
        if len(text) <= 1 << 22:
            return b"".join(map(one, split.findall(text)))
        found, parts = split.finditer(text), []
        while stretch := b"".join(one(m.group()) for m in islice(found, STRETCH)):
            parts.append(stretch)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian unsigned 32-bit ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Ids of the pieces seen lately, in two generations: when the young one is full, it replaces the old one."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            merged = self.codec.merge(piece.encode("utf-8", "surrogatepass"))
            ids = pack(f"<{len(merged)}I", *merged)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[tuple[str, str], Codec] = {}


def codec_for(table: bytes, pattern: str) -> Codec:
    """The codec of a rank table, built once in each worker."""
    key = hashlib.sha256(table).hexdigest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec.of(table, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, table_path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, ids (binary, little-endian unsigned 32-bit), n_tokens and the
    decoded bytes' SHA-256, for each row of ``docs``.

    ``table_path`` is read on the driver, and its content (a vocabulary file, under a megabyte) goes
    along with the tasks.
    """
    ship(docs.sparkSession)
    with open(table_path, "rb") as file:
        table = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("ids binary, n_tokens bigint, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_for(table.value, pattern)
        for texts in batches:
            ids = [codec.encode(text) for text in texts]
            yield pd.DataFrame({
                "ids": ids,
                "n_tokens": [len(x) // 4 for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            })

    some = pick(docs, "doc_id", "text", *keep)
    return some.withColumn("_c", coded("text")).select("doc_id", *keep, "_c.*")


def bpe_digests(docs: DataFrame, table_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's text."""
    out = encode_documents(docs, table_path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
