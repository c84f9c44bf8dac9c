"""A compressed FM-index of word sequences: a wavelet matrix over the Burrows-Wheeler transform, searched backward."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class WaveletMatrix:
    """A sequence of numbers as one bit vector for each bit of a number, each with the count of ones before every 64 bits."""

    def __init__(self, x: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (x >> shift) & 1
            packed = np.zeros(len(x) // 64 + 1, np.uint64)
            raw = np.packbits(bit.astype(bool), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)]
            self.levels.append((shift, len(x) - int(bit.sum()), packed, before))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, zeros, packed, before in self.levels:
            at = i >> 6
            ones = before[at] + np.bitwise_count(packed[at] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE))
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        return self._descend(c, i) - self.first[c]


class FmIndex:
    """Sequences of symbols 1..sigma-1, each closed by a 0, in the order of their suffixes' first `length` symbols.

    Rows are sorted by that many symbols only; backward search for patterns of up to `length` symbols needs no more. What
    stays is the transform's wavelet matrix and, for dropping symbols at a match's end, the number of symbols that each
    row shares with the one before it, a byte each, with its minima over 1, 2, 4 ... rows.
    """

    def __init__(self, text: np.ndarray, sigma: int, length: int) -> None:
        if length > 255:
            raise ValueError("shared symbols are held in a byte each")
        self.length, self.n = length, len(text)
        ranks, width = [text.astype(np.int64)], 1
        while width * 2 <= length:
            ranks.append(np.unique(self._joint(ranks[-1], width), return_inverse=True)[1])
            width *= 2
        rows = np.argsort(self._joint(ranks[-1], length - width) if length > width else ranks[-1], kind="stable")
        self.rows = rows.astype(np.int32)
        shared, above = np.zeros(self.n, np.int64), np.r_[rows[:1], rows[:-1]]
        for k in range(len(ranks) - 1, -1, -1):  # of each row and the one before it, by falling widths
            x, y = rows + shared, above + shared
            fits = (x < self.n) & (y < self.n)
            fits[fits] = ranks[k][x[fits]] == ranks[k][y[fits]]
            shared += fits.astype(np.int64) << k
        shared[:1] = 0
        self.minima = [np.minimum(shared, length).astype(np.uint8)]
        while 1 << len(self.minima) <= self.n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last, np.r_[np.zeros(half, np.uint8), last[:-half]]))
        self.matrix = WaveletMatrix(text[rows - 1], sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))[:-1]]

    @staticmethod
    def _joint(rank: np.ndarray, shift: int) -> np.ndarray:
        """Of each place its rank and, where there is one, the rank `shift` places on, as one number."""
        after = np.zeros(len(rank), np.int64)
        if shift < len(rank):
            after[: len(rank) - shift] = rank[shift:] + 1
        return rank * (int(rank.max(initial=0)) + 2) + after

    def shorter(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share their first `depth` symbols with a row."""
        low, high = row.copy(), row + 1
        for level in range(len(self.minima) - 1, -1, -1):
            least, step = self.minima[level], 1 << level
            inside = (least[low] >= depth) & (low >= step)
            low = np.where(inside, low - step, low)
            last = np.minimum(high + step - 1, self.n - 1)
            inside = (high + step <= self.n) & (least[last] >= depth)
            high = np.where(inside, high + step, high)
        return low, high

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with one more symbol on the left."""
        both = self.matrix.rank(np.r_[symbol, symbol], np.r_[low, high])
        k = len(symbol)
        return self.before[symbol] + both[:k], self.before[symbol] + both[k:]

    def statistics(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Matching statistics of sequences (start and size in text), streamed all at once from their ends: how many symbols,
        `length` at most, of what begins at each place weigh more than one together in the index. weight: of each place of
        the indexed text. A match that cannot grow to the left drops as many symbols at its end as it takes."""
        total = np.r_[0, np.cumsum(weight[self.rows])]
        out = np.zeros(len(text), np.int64)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        low, depth = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        high = np.full(len(size), self.n)
        for t in range(1, int(size[0]) + 1 if len(size) else 0):
            k = int(np.searchsorted(-size, -t, "right"))  # sequences that long come first
            place = start[:k] + size[:k] - t
            symbol = text[place]
            # the longest match that can take the symbol: as it is, or else found by halving, from none at all up
            least, most = np.zeros(k, np.int64), np.minimum(depth[:k], self.length - 1)
            found_low, found_high = np.zeros(k, np.int64), np.zeros(k, np.int64)
            best, goal, open_ = np.full(k, -1), most.copy(), np.arange(k)
            while len(open_):
                a, b = low[open_], high[open_]
                cut = np.flatnonzero(goal[open_] < depth[open_])
                if len(cut):
                    a[cut], b[cut] = self.shorter(low[open_[cut]], goal[open_[cut]])
                a, b = self.extend(symbol[open_], a, b)
                good = total[b] - total[a] > 1
                yes, no = open_[good], open_[~good]
                found_low[yes], found_high[yes], best[yes] = a[good], b[good], goal[yes]
                least[yes], most[no] = goal[yes] + 1, goal[no] - 1
                open_ = open_[least[open_] <= most[open_]]
                goal[open_] = (least[open_] + most[open_]) // 2
            fits = best >= 0
            low[:k], high[:k] = np.where(fits, found_low, 0), np.where(fits, found_high, self.n)
            depth[:k] = best + 1
            out[place] = depth[:k]
        return out

    def repeated(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A mask over text: where the matching statistic reaches the full length."""
        return self.statistics(text, start, size, weight) >= self.length
