"""A vectorised automaton over the bytes of an Arrow column of texts: words, and CRC-32 sums of words and of runs of words.

A-Z are lower-cased and every byte is classed by a lookup table: digits, a-z and all bytes of characters beyond ASCII
belong to words. Word borders are where the class changes, found by differences; a text's end is a border too. The sums
of all words advance side by side, a byte of each in a step, through the usual table of 256 entries. Words are held by
falling length, so those that still have bytes are always the first ones.

CRC-32 is linear, so a word longer than ``STEPS`` bytes is cut in blocks of ``BLOCK`` that advance side by side and are
folded in pairs, each fold shifting the left sum by the length of the right one. A word of n bytes takes
O(n) work in O(log n) array steps, whatever n.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

STEPS, BLOCK = 1024, 64


def _byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


TABLE = _byte_table()
_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z lower-cased, other bytes as they are.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Whether a lower-cased byte belongs to a word.
IN_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return TABLE[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


@lru_cache(maxsize=64)
def _shifts(power: int) -> np.ndarray:
    """Four tables that together advance a state by 2**power zero bytes."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    if power == 0:
        return step(values, np.uint32(0))
    half = _shifts(power - 1)
    return _shifted(half, _shifted(half, values))


def _shifted(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    m = np.uint32(0xFF)
    return (
        tables[0][state & m] ^ tables[1][(state >> np.uint32(8)) & m]
        ^ tables[2][(state >> np.uint32(16)) & m] ^ tables[3][state >> np.uint32(24)]
    )


def _long(state: np.uint32, piece: np.ndarray) -> np.uint32:
    """The state after a long piece: blocks side by side from zero, folded in pairs, and the first state shifted past all."""
    blocks = -(-len(piece) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[len(padded) - len(piece):] = piece
    rows = padded.reshape(blocks, BLOCK)
    sums = np.zeros(blocks, np.uint32)
    for k in range(BLOCK):
        sums = step(sums, rows[:, k])
    power = BLOCK.bit_length() - 1
    while len(sums) > 1:
        if len(sums) % 2:
            sums = np.concatenate([np.zeros(1, np.uint32), sums])
        sums = _shifted(_shifts(power), sums[0::2]) ^ sums[1::2]
        power += 1
    first = np.array([state], np.uint32)
    for bit in range(len(piece).bit_length()):
        if len(piece) >> bit & 1:
            first = _shifted(_shifts(bit), first)
    return first[0] ^ sums[0]


class Words:
    """The words of the texts of a string array. A null text has none.

    ``data``: the lower-cased bytes. ``start``, ``size``: place and bytes of each word. ``text_at``: for each text the
    number of its first word, and last the number of all words.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
        low, high = int(at[0]), int(at[-1])
        raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
        at = at - low
        self.data = LOWER[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = IN_WORD[self.data]
        change = np.diff(inside)
        # A text's first byte starts a word even where the text before it ends in one.
        joint = at[1:-1]
        joint = np.unique(joint[(joint > 0) & (joint < len(raw))])
        joint = joint[(inside[joint] == 1) & (inside[joint + 1] == 1)]
        self.start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        if len(joint):
            self.start = np.sort(np.concatenate([self.start, joint]))
            end = np.sort(np.concatenate([end, joint]))
        self.size = end - self.start
        self.text_at = np.searchsorted(self.start, at)
        short = np.minimum(self.size, STEPS).astype(np.uint16)
        self._order = np.argsort(np.uint16(STEPS) - short, kind="stable")
        self._active = len(short) - np.cumsum(np.bincount(short, minlength=STEPS + 1))

    def __len__(self) -> int:
        return len(self.start)

    def advance(self, state: np.ndarray, at: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """``state`` of each word after all of its bytes; and after its first k bytes for each k of ``at`` (at most
        ``STEPS``), with the words that have so many."""
        order = self._order
        now, begin, found = state[order], self.start[order], {}
        most = int(self.size.max(initial=0))
        for k in range(min(most, STEPS)):
            n = int(self._active[k])
            now[:n] = step(now[:n], self.data[begin[:n] + k])
            if k + 1 in at:
                found[k + 1] = (order[:n], now[:n].copy())
        out = np.empty_like(now)
        out[order] = now
        if most > STEPS:
            for i in np.flatnonzero(self.size > STEPS):
                out[i] = _long(state[i], self.data[self.start[i]: self.start[i] + self.size[i]])
        return out, found

    def runs(self, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of every run of 1 to ``most`` consecutive words of a text, joined by one space, and the number of its text."""
        n = len(self)
        of = np.repeat(np.arange(len(self.text_at) - 1), np.diff(self.text_at))
        state, _ = self.advance(np.full(n, 0xFFFFFFFF, np.uint32))
        sums, texts = [~state], [of]
        # A run is held at its last word: the state of the run without it, a space, and then the word.
        for k in range(1, most):
            if n <= k:
                break
            ahead = np.full(n, 0xFFFFFFFF, np.uint32)
            ahead[k:] = step(state[k - 1: n - 1], np.uint32(32))
            state, _ = self.advance(ahead)
            whole = of[k:] == of[: n - k]
            sums.append(~state[k:][whole])
            texts.append(of[k:][whole])
        return np.concatenate(sums), np.concatenate(texts)
