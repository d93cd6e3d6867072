"""Byte-pair merges of many short words at once, on numpy arrays.

Both tokenizers here merge, again and again, the adjacent pair of the best rank, the leftmost first.
Words are columns of a matrix of symbols; a step finds the best pair of every column by one minimum
over keys (rank, position) and joins it. Nothing is remembered between calls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words of more symbols are left to the tokenizer's library.
LONGEST = 64
NONE = np.int32(2**31 - 1)
#: Bytes of text that are handled at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20


class PairTable:
    """Ranks of adjacent pairs of symbols and the symbols they become, by open addressing.

    ``made[rank]`` is the symbol too, where all pairs of the rank become the same; else it is -1.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        if len(rank) and int(rank.max()) >= 2**31 // LONGEST - 1:
            raise ValueError("too many merges")
        self.made = np.full(int(rank.max(initial=0)) + 1, -1, np.int32)
        self.made[rank] = made
        self.made[rank[self.made[rank] != made]] = -1
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.became = np.full(1 << bits, -1, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[todo[free]]
            won = free & (self.keys[slots] == keys[todo])
            self.rank[slots[won]], self.became[slots[won]] = rank[todo[won]], made[todo[won]]
            lost = self.keys[slots] != keys[todo]
            todo, slots = todo[lost], (slots[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joins(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that pairs of known rank become."""
        out = self.made[rank]
        for k in np.flatnonzero(out < 0):
            key = int(left[k]) << 32 | int(right[k])
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] != key:
                slot = (slot + 1) & self.mask
            out[k] = self.became[slot]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is never joined."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.rank[slots], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & self.mask
            found = self.keys[slots]
            hit = found == keys[todo]
            out[todo[hit]] = self.rank[slots[hit]]
            more = ~hit & (found != -1)
            todo, slots = todo[more], slots[more]
        return out


def _merge_block(symbols: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> None:
    """Merge the columns of a (width, words) matrix in place; joined and unused cells become -1."""
    width, n = symbols.shape
    row = np.arange(width, dtype=np.int32)[:, None]
    keys = np.full((width, n), NONE, np.int32)
    there = row[1:] < sizes
    found = pairs.ranks(symbols[:-1][there], symbols[1:][there])
    at = np.broadcast_to(row[:-1], there.shape)[there]
    keys[:-1][there] = np.where(found == NONE, NONE, found * LONGEST + at)
    after = np.where(row + 1 < sizes, row + 1, -1).astype(np.int8)
    before = np.broadcast_to(row - 1, (width, n)).astype(np.int8)
    words = np.arange(n)
    while len(words):
        best = keys.min(axis=0) if len(words) == n else keys[:, words].min(axis=0)
        active = best != NONE
        words, best = words[active], best[active]
        i = best % LONGEST
        j = after[i, words]
        k = after[j, words]
        symbols[i, words] = pairs.joins(best // LONGEST, symbols[i, words], symbols[j, words])
        symbols[j, words] = -1
        keys[j, words] = NONE
        after[i, words] = k
        right = k >= 0
        before[k[right], words[right]] = i[right]
        p = before[i, words].astype(np.int32)
        left = p >= 0
        a = np.concatenate([i[right], p[left]])
        w = np.concatenate([words[right], words[left]])
        b = np.concatenate([k[right].astype(np.int32), i[left]])
        found = pairs.ranks(symbols[a, w], symbols[b, w])
        keys[i, words] = NONE
        keys[a, w] = np.where(found == NONE, NONE, found * LONGEST + a)


def merge(symbols: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of consecutive words (LONGEST at most each) to the merged ones and their number per word."""
    starts = np.cumsum(sizes) - sizes
    counts = sizes.astype(np.int64).copy()
    alive = np.ones(len(symbols), bool)
    out = symbols.astype(np.int32)
    low = 1
    for width in (2, 4, 6, 8, 10, 12, 16, 24, 40, LONGEST):
        chosen = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for at in range(0, len(chosen), 1 << 16):
            some = chosen[at : at + (1 << 16)]
            cells = starts[some] + np.arange(width)[:, None]
            there = np.arange(width)[:, None] < sizes[some]
            block = np.where(there, out[np.minimum(cells, len(out) - 1)], -1)
            _merge_block(block, sizes[some].astype(np.int32), pairs)
            out[cells[there]] = block[there]
            alive[cells[there]] = block[there] >= 0
            counts[some] = (block >= 0).sum(axis=0)
    return out[alive], counts


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of fixed-width values as one binary value each."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def joined(parts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes of a large-binary array without nulls, and where each value starts and ends in them."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset)
    data = parts.buffers()[2]
    return memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b""), offsets - offsets[0]


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut ``data`` before each start: (number of the distinct chunk at each place, all distinct chunks' bytes, their offsets)."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    held, edges = joined(chunks.dictionary)
    return chunks.indices.to_numpy(), np.frombuffer(held, np.uint8), edges


def slices(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges of texts of SLICE_BYTES together at most, or of one text."""
    out, first, held = [], 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > SLICE_BYTES:
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(lengths))] if len(lengths) > first else out
