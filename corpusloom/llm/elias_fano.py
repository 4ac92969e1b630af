"""Monotone sequences in Elias-Fano form, and an n-gram trie of such levels, in one mapped piece of memory."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.int64)
#: Place of the k-th set bit of a byte, 8 where there is none.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.int64)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    out, k, done = np.zeros(len(word), np.int64), k.astype(np.int64), np.zeros(len(word), bool)
    for b in range(8):
        byte = (word >> np.uint64(8 * b)).astype(np.int64) & 255
        n = _POPCOUNT[byte]
        here = ~done & (k < n)
        out[here] = 8 * b + _SELECT[byte[here], k[here]]
        done |= here
        k = np.where(done, k, k - n)
    return out


class Monotone:
    """A non-decreasing sequence of integers: low bits as they are, high parts in unary, with counts for each word."""

    def __init__(self, header: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.header, self.low, self.high, self.ones = header, low, high, ones
        self.n, self.bits, self.top = (int(x) for x in header)

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (last // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.int64) * bits
            part = values & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, at >> 6, part << (at & 63).astype(np.uint64))
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (64 - (at[over] & 63)).astype(np.uint64))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        top = (last >> bits) + 1
        words = (n + top) // 64 + 1
        unary = np.zeros(words * 64, np.uint8)
        unary[place] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(unary.reshape(-1, 64).sum(1, dtype=np.int64))])
        return cls(np.array([n, bits, top], np.int64), low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.header, self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the unary part."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(zeros, k, "right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - zeros[word])

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Where each value is (between begin and end, if given), -1 where it isn't: the place of its successor, if equal."""
        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        part = (values >> np.uint64(self.bits)).astype(np.int64)
        inside = (part >= 0) & (part < self.top)
        k = np.where(inside, part, 0)
        first = np.where(k > 0, self._zero(np.maximum(k - 1, 0)) - (k - 1), 0)
        stop = self._zero(k) - k
        if begin is not None:
            first, stop = np.maximum(first, begin), np.minimum(stop, end)
        low, limit = values & np.uint64((1 << self.bits) - 1), stop
        first, limit = first.copy(), np.maximum(limit, first)
        while (open_ := np.flatnonzero(first < limit)).size:
            middle = (first[open_] + limit[open_]) >> 1
            less = self._low(middle) < low[open_]
            first[open_[less]] = middle[less] + 1
            limit[open_[~less]] = middle[~less]
        found = inside & (first < stop)
        found[found] &= self._low(first[found]) == low[found]
        return np.where(found, first, -1)


class Trie:
    """Contexts with a code each, pointers to their successors, the successors, and a code for each of them.

    A successor is stored as context place * 2**32 + token, so that the whole level is
    one monotone sequence; a successor is looked for among its context's own, which lie
    between two pointers. Tokens have up to 32 bits, and contexts as many as a place in a sequence may have.
    """

    def __init__(self, contexts: Monotone, pointers: Monotone, successors: Monotone, codes: np.ndarray, weights: np.ndarray, memory: mmap.mmap | None = None):
        self.contexts, self.pointers, self.successors, self.codes, self.weights, self.memory = contexts, pointers, successors, codes, weights, memory

    @classmethod
    def of(cls, context: np.ndarray, token: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> Trie:
        """From different (context, token) in ascending order with codes, and codes of the different contexts."""
        different, first = np.unique(context, return_index=True)
        place = np.searchsorted(different, context).astype(np.uint64)
        return cls(Monotone.of(different), Monotone.of(np.append(first, len(context))), Monotone.of((place << np.uint64(32)) | token.astype(np.uint64)), codes.astype(np.uint8), weights.astype(np.uint8))

    def lookup(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each (context, token) and of its context, 0 where the trie has none."""
        code, weight = np.zeros(len(context), np.uint8), np.zeros(len(context), np.uint8)
        if not self.successors.n:
            return code, weight
        different, at = np.unique(context, return_inverse=True)
        place = self.contexts.find(different)
        known = np.maximum(place, 0)
        begin, end = (self.pointers.get(known + k).astype(np.int64) for k in (0, 1))
        some = np.flatnonzero(place[at] >= 0)
        own = at[some]
        weight[some] = self.weights[known[own]]
        spot = self.successors.find((known[own].astype(np.uint64) << np.uint64(32)) | token[some].astype(np.uint64), begin[own], end[own])
        code[some] = np.where(spot >= 0, self.codes[np.maximum(spot, 0)], 0)
        return code, weight

    def to_bytes(self) -> bytes:
        arrays = [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.codes, self.weights]
        head = np.array([len(a) for a in arrays], np.int64)
        return b"".join([head.tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])

    @classmethod
    def mapped(cls, stored: bytes) -> Trie:
        """The trie over a mapped file of its bytes, which is gone when it is closed; nothing is unpacked."""
        with tempfile.TemporaryFile() as file:
            file.write(stored)
            file.flush()
            memory = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        kinds = [*[np.int64, np.uint64, np.uint64, np.int64] * 3, np.uint8, np.uint8]
        head = np.frombuffer(memory, np.int64, len(kinds))
        arrays, at = [], head.nbytes
        for kind, n in zip(kinds, head.tolist(), strict=True):
            arrays.append(np.frombuffer(memory, kind, n, at))
            at += -(-arrays[-1].nbytes // 8) * 8
        levels = [Monotone(*arrays[4 * k : 4 + 4 * k]) for k in range(3)]
        return cls(*levels, arrays[-2], arrays[-1], memory)

    def __enter__(self) -> Trie:
        return self

    def __exit__(self, *_: object) -> None:
        """Let go of the mapped memory, which is freed with the last array over it."""
        self.contexts = self.pointers = self.successors = self.codes = self.weights = self.memory = None
