"""Counting quotient filter over 64-bit fingerprints, on sorted numpy arrays.

A fingerprint is cut into a quotient (its high bits) and a remainder (the rest). A filter keeps
per quotient a run of sorted remainders with a count each. As quotient and remainder together are
the whole fingerprint, nothing is lost, and two filters merge by merging sorted remainders.

Layout of the bytes: quotient bits and number of runs and slots (three little-endian uint32), the
occupied quotients (delta-coded uint32), the length of each run (uint32), the remainders (uint64)
and their counts (uint64).
"""

from __future__ import annotations

import numpy as np


class CountingQuotientFilter:
    """occupied: ascending quotients; lengths: slots per run; remainders ascending within a run."""

    def __init__(self, q_bits: int, occupied: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q_bits, self.occupied, self.lengths, self.remainders, self.counts = q_bits, occupied, lengths, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, q_bits: int = 32) -> CountingQuotientFilter:
        """fingerprints: uint64 in any order, repeats allowed; counts: one for each, else 1."""
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order]
        weights = np.ones(len(ordered), np.uint64) if counts is None else counts[order].astype(np.uint64)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
        slots = ordered[first]
        summed = np.add.reduceat(weights, first) if len(first) else weights
        return cls._of_slots(slots, summed, q_bits)

    @classmethod
    def _of_slots(cls, slots: np.ndarray, counts: np.ndarray, q_bits: int) -> CountingQuotientFilter:
        """slots: distinct fingerprints, ascending."""
        r_bits = np.uint64(64 - q_bits)
        quotients = slots >> r_bits
        starts = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(slots) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[starts, len(slots)])
        return cls(q_bits, quotients[starts], lengths.astype(np.uint32), slots & ((np.uint64(1) << r_bits) - np.uint64(1)), counts)

    def fingerprints(self) -> np.ndarray:
        """All stored fingerprints, ascending."""
        return (np.repeat(self.occupied, self.lengths) << np.uint64(64 - self.q_bits)) | self.remainders

    def merge(self, others: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Two by two, so that each slot is moved as often as the number of filters has binary digits."""
        filters = [self, *others]
        while len(filters) > 1:
            pairs = [a._with(b) for a, b in zip(filters[::2], filters[1::2], strict=False)]
            filters = pairs + filters[2 * len(pairs) :]
        return filters[0]

    def _with(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """One pass over both: the other's remainders go to their places within this filter's runs.

        Runs are in order of quotients and ascending inside, so quotient and remainder together are
        one ascending sequence; an equal slot adds its count, any other is put in between.
        """
        if not len(other.remainders):
            return self
        own, new, counts = self.fingerprints(), other.fingerprints(), self.counts.copy()
        at = np.searchsorted(own, new)
        inside = at < len(own)
        inside[inside] = own[at[inside]] == new[inside]
        counts[at[inside]] += other.counts[inside]
        places = at[~inside]
        return self._of_slots(np.insert(own, places, new[~inside]), np.insert(counts, places, other.counts[~inside]), self.q_bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.q_bits, len(self.occupied), len(self.remainders)], "<u4").tobytes()
        deltas = np.diff(self.occupied, prepend=np.uint64(0)).astype("<u4").tobytes()
        return head + deltas + self.lengths.astype("<u4").tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q_bits, runs, slots = (int(x) for x in np.frombuffer(data, "<u4", 3))
        at = 12
        occupied = np.cumsum(np.frombuffer(data, "<u4", runs, at).astype(np.uint64), dtype=np.uint64)
        lengths = np.frombuffer(data, "<u4", runs, at + 4 * runs)
        at += 8 * runs
        return cls(q_bits, occupied, lengths, np.frombuffer(data, "<u8", slots, at).astype(np.uint64), np.frombuffer(data, "<u8", slots, at + 8 * slots).astype(np.uint64))
