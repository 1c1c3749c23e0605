"""An FM-index over many short word segments: suffix array, Burrows-Wheeler transform in a bit-packed wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of symbols before positions, over bit planes packed 64 to a word with running counts."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = values.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bits = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, bool))), bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1]
            zeros = len(bits) - int(bits.sum())
            self.planes.append((packed, before, zeros))
            now = np.concatenate((now[~bits], now[bits]))
        every = np.arange(symbols, dtype=np.int64)
        self.first = self._down(every, np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (packed, before, zeros) in enumerate(self.planes):
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            bit = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """Index of segments of word codes (1 and up). Positions of the joined text follow the segments' order."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        """``codes`` holds all segments one after another; segment i is ``codes[starts[i]:starts[i + 1]]``."""
        segments = len(starts) - 1
        n = len(codes) + segments
        text = np.zeros(n, np.int64)  # 0 closes each segment
        inside = np.ones(n, bool)
        inside[starts[1:] + np.arange(segments)] = False
        text[inside] = codes
        self.text, self.begin = text, starts[:-1] + np.arange(segments)
        self.array = self._suffixes(text, segments)
        symbols = int(text.max()) + 1 if n else 1
        counts = np.bincount(text, minlength=symbols)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.matrix = WaveletMatrix(text[self.array - 1], symbols)
        self._least_tables()

    @staticmethod
    def _suffixes(text: np.ndarray, segments: int) -> np.ndarray:
        """All suffixes in order, by prefix doubling; each segment's end is a symbol of its own, in text order, so a segment's length bounds the rounds."""
        n = len(text)
        rank = text + segments
        ends = np.flatnonzero(text == 0)
        rank[ends] = np.arange(len(ends))
        width = 1
        while True:
            key = (rank.astype(np.uint64) + np.uint64(1)) << np.uint64(32)
            key[: n - width] |= (rank[width:] + 1).astype(np.uint64)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if n == 0 or fresh[-1] == n - 1:
                return order
            width *= 2

    def _least_tables(self, block: int = 16) -> None:
        """Least text position over stretches of the suffix array: block minima and their doubling table."""
        sa = self.array
        padded = np.concatenate((sa, np.full(-len(sa) % block + 2 * block, len(sa) + 1)))
        table = [padded.reshape(-1, block).min(axis=1)]
        while len(table[-1]) > 1:
            step = 1 << (len(table) - 1)
            if len(table[-1]) <= step:
                break
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        self.block, self.padded, self.table = block, padded, table

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least text position of each non-empty suffix-array interval."""
        b, steps = self.block, np.arange(self.block)
        left = self.padded[np.minimum(low[:, None] + steps, high[:, None] - 1)].min(axis=1)
        right = self.padded[np.maximum(high[:, None] - 1 - steps, low[:, None])].min(axis=1)
        out = np.minimum(left, right)
        first, last = -(-low // b), high // b
        for k, row in enumerate(self.table):
            size = last - first
            mine = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            if len(mine):
                out[mine] = np.minimum(out[mine], np.minimum(row[first[mine]], row[last[mine] - (1 << k)]))
        return out

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with a symbol put before them."""
        both = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = self.before[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def earlier(self, window: int) -> np.ndarray:
        """For each text position, whether a window of so many words of one segment starts there whose words also start earlier.

        Segments are streamed from their ends. Where a window has an earlier place, its match grows by one word
        to the left, and the next window is decided by the longer match as long as that has one too; else the next
        window is searched afresh. A search ends as soon as its interval holds its own place only.
        """
        found = np.zeros(len(self.text) + 1, bool)
        size = np.diff(np.concatenate((self.begin, [len(self.text)]))) - 1
        lanes = np.flatnonzero(size >= window)
        at = self.begin[lanes] + size[lanes] - window  # the window under way in each lane
        stop = self.begin[lanes]
        low, high = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        matched = np.zeros(len(lanes), bool)
        while len(at):
            good = np.zeros(len(at), bool)
            grown = np.flatnonzero(matched)
            if len(grown):
                a, b = self.extend(self.text[at[grown]], low[grown], high[grown])
                ok = self.least(a, b) < at[grown]
                low[grown[ok]], high[grown[ok]] = a[ok], b[ok]
                good[grown[ok]] = True
            afresh = np.flatnonzero(~good)
            a, b = np.zeros(len(afresh), np.int64), np.full(len(afresh), len(self.text), np.int64)
            for k in range(window - 1, -1, -1):
                if not len(afresh):
                    break
                a, b = self.extend(self.text[at[afresh] + k], a, b)
                several = b - a > 1
                afresh, a, b = afresh[several], a[several], b[several]
            if len(afresh):
                ok = self.least(a, b) < at[afresh]
                low[afresh[ok]], high[afresh[ok]] = a[ok], b[ok]
                good[afresh[ok]] = True
            found[at[good]] = True
            matched, at = good, at - 1
            going = at >= stop
            at, stop, low, high, matched = at[going], stop[going], low[going], high[going], matched[going]
        return found[:-1]
