"""Strings of a fixed length that occur again, found over a whole table: what substring and suffix dedup share.

A window is `length` consecutive units (bytes or words) of one document. Its anchor is the place of the smallest hash among
its `gram`-unit grams (the first, on ties), so equal windows have their anchors equally far in. Neighbouring windows with one
anchor travel together as a piece, those with more after the anchor apart from those with more before it: all of a piece's
windows share a string of `Spec.key` units around the anchor. That string's hash is the piece's key. It only routes: equal
windows have equal keys, and what is equal is decided by the content itself.

1. names: each batch of documents tells the keys of its pieces, with their counts, to the keys' shards; they tell back which
   occur twice or more in the whole table. No other piece can hold a repeated window.
2. pieces: each batch sends the distinct pieces under repeated keys to the keys' shards, once for all its copies, with the
   first place of each. Pieces under a key with more than `hot` places are sent window by window under the windows' own
   hashes, so that however often a string occurs no shard holds very many different pieces for it.
3. answers: each shard takes its pieces by key, about CHUNK bytes of different content at a time, indexes them and tells each
   batch which of its windows occur elsewhere (words: matching statistics from an FM-index) or earlier (bytes: suffixes
   sorted by hash comparison, verified).
4. marks: each batch removes the units under those windows.

Documents are shuffled once (one exchange feeds steps 1, 2 and 4). A task holds one batch of documents or the messages of one
shard, however many of either its partition has; long texts are read in overlapping segments.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm._fm_index import FmIndex
from larkspan.llm._shared import parts_for, row_slices, text_or_empty
from larkspan.llm._suffix_sort import Suffixes

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_BEFORE, _WINDOW = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BATCH_MB = 8
HOT = 8192
#: Bytes of text that are hashed at a time, and bytes of different pieces that are indexed at a time.
SLICE, CHUNK = 1 << 18, 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_powers_held: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, kept for the next call."""
    have = _powers_held.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1024), base, np.uint64)
        have[0] = 1
        _powers_held[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _strings(x: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, which: int) -> np.ndarray:
    """Polynomial hashes of x[start:end], from sums over x: the quotient of each by its start's power."""
    inverse = pow(_BASE[which], -1, 1 << 64)
    total = np.r_[_U(0), np.cumsum(x * _powers(_BASE[which], len(x)))]
    return _mix((total[end] - total[start]) * _powers(inverse, len(x) + 1)[start])


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(x) - k + 1
    return _strings(x, slice(0, n), slice(k, k + n), 0) if n > 0 else np.zeros(0, np.uint64)


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        x = op(x[: len(x) - width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = w - width
    return op(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first, count) + _within(count)


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Units:
    """Texts joined to one buffer. Unit i is buffer[start[i]:end[i]]; doc[j]:doc[j+1] are the units of text j."""

    buffer: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    words: bool

    @staticmethod
    def of_bytes(texts: list[bytes]) -> Units:
        doc = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        at = np.arange(doc[-1])
        return Units(b"".join(texts), at, at + 1, doc, False)

    @staticmethod
    def of_words(texts: list[bytes]) -> Units:
        lists = [t.split() for t in texts]  # splits at \x20 and \x09-\x0D
        doc = np.r_[0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]
        buffer = b" ".join([b" ".join(x) for x in lists if x])
        spaces = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        end = np.r_[spaces, len(buffer)] if buffer else np.zeros(0, np.int64)
        return Units(buffer, np.r_[0, spaces + 1] if buffer else end, end, doc, True)

    def hashes(self) -> np.ndarray:
        values = _BYTES[np.frombuffer(self.buffer, np.uint8)]
        return _strings(values, self.start, self.end, 1) if self.words and len(values) else values

    def valid(self, length: int) -> np.ndarray:
        """Starts of windows that lie in one text, as a mask over window starts."""
        n = self.doc[-1]
        mask = np.zeros(max(n - length + 1, 0) + 1, np.int8)
        sizes = np.diff(self.doc)
        has = sizes >= length
        np.add.at(mask, self.doc[:-1][has], 1)
        np.add.at(mask, self.doc[1:][has] - length + 1, -1)
        return np.cumsum(mask)[:-1].astype(bool)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Spec:
    words: bool
    length: int
    gram: int
    #: Only windows after the first of their content are marked (of bytes), not all of them (of words).
    later_only: bool
    #: Places of one key beyond which its windows travel one by one.
    hot: int = HOT

    @property
    def near(self) -> int:
        """Units before the anchor up to which a window counts as having more after it."""
        return (self.length - self.gram) // 2

    @property
    def key(self) -> int:
        return self.gram + min(self.length - self.gram - self.near, self.near + 1) if self.length > self.gram else self.gram

    @property
    def least(self) -> int:
        """Bytes of the shortest text that can hold a window."""
        return 2 * self.length - 1 if self.words else self.length

    def units(self, texts: list[bytes]) -> Units:
        return Units.of_words(texts) if self.words else Units.of_bytes(texts)

    def size(self, text: bytes) -> int:
        if not self.words:
            return len(text)
        blank = _SPACE[np.frombuffer(text, np.uint8)]
        return int(np.count_nonzero(~blank & np.r_[True, blank[:-1]]))

    def segments(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(number of its first unit, part of the text): each window lies in exactly one."""
        if len(text) <= SLICE:
            yield 0, text
        elif not self.words:
            for a in range(0, len(text) - self.length + 1, SLICE):
                yield a, text[a : a + SLICE + self.length - 1]
        else:
            at, base, span = 0, 0, SLICE
            while True:
                stop = _BLANK.search(text, at + span)
                part = text[at : stop.start() if stop else len(text)]
                tail = part.rsplit(None, self.length - 1) if self.length > 1 else [part]
                if stop and len(tail) < self.length:
                    span *= 2  # a few very long words: take more
                    continue
                yield base, part
                if not stop:
                    return
                at, base, span = at + len(tail[0]), base + self.size(tail[0]), SLICE

    def cut(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece: its first window, count of windows, units from there to the anchor, key; and the units' hashes."""
        u = units.hashes()
        n = len(u)
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none, np.zeros(0, np.uint64), u
        mask = _U((1 << n.bit_length()) - 1)
        g = (grams(u, self.gram) & ~mask) | np.arange(n - self.gram + 1, dtype=np.uint64)
        anchor = (_slide(g, self.length - self.gram + 1, np.minimum) & mask).astype(np.int64)
        first, stop = _runs(anchor, units.valid(self.length))
        p = anchor[first]
        turn = p - self.near  # windows from here on have more after the anchor
        a, b = np.minimum(stop, np.maximum(first, turn)), np.maximum(first, np.minimum(stop, turn))
        long = grams(u, self.key)
        behind, ahead = np.flatnonzero(a > first), np.flatnonzero(stop > b)
        begin, end, at = np.r_[first[behind], b[ahead]], np.r_[a[behind], stop[ahead]], np.r_[p[behind], p[ahead]]
        key = np.r_[long[p[behind] - (self.key - self.gram)] ^ _BEFORE, long[p[ahead]]]
        order = np.argsort(begin, kind="stable")
        return begin[order], (end - begin)[order], (at - begin)[order], key[order], u


def _runs(value: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one value: first windows, and the ones after the last."""
    if not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = value[1:] != value[:-1]
    first = np.flatnonzero(ok & np.r_[True, turn | ~ok[:-1]])
    return first, np.flatnonzero(ok & np.r_[turn | ~ok[1:], True]) + 1


@dataclass
class _Batch:
    """A batch's documents in an order of their own, alike however the rows arrived: by id (null first, those by a hash of
    their text), then text."""

    ids: list
    texts: list[bytes]
    #: Rank of a document: its id and, for null ids, its text's hash; and the units of those of equal rank before it.
    rank: np.ndarray
    before: np.ndarray

    @staticmethod
    def read(group: pa.Table, spec: Spec) -> _Batch:
        ids = group.column("doc_id").to_pylist()
        texts = [x or b"" for x in group.column("text").cast(pa.large_binary()).to_pylist()]
        rank = [(-(1 << 63), xxhash.xxh64_intdigest(t) >> 1) if i is None else (i, 0) for i, t in zip(ids, texts)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, rank[i], texts[i]))
        ids, texts, rank = [ids[i] for i in order], [texts[i] for i in order], [rank[i] for i in order]
        before = [0] * len(ids)
        for i in range(1, len(ids)):
            before[i] = before[i - 1] + spec.size(texts[i - 1]) if rank[i] == rank[i - 1] else 0
        return _Batch(ids, texts, np.array(rank, np.int64).reshape(-1, 2), np.array(before, np.int64))

    def pieces(self, spec: Spec) -> Iterator[tuple[Units, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By slice: units, their hashes, and of each piece its first window, count, anchor, key, the number that window has
        among all windows of the batch, and its (text's number, unit in the text)."""
        windows, most, at = 0, 0, -1
        for part in self._slices(spec):
            units = spec.units([x for *_, x in part])
            size, number, base, ahead = np.diff(units.doc), [], [], []
            for (t, b, _), n in zip(part, size.tolist()):
                if t != at:
                    windows, most, at = windows + most, 0, t
                number.append(t), base.append(b), ahead.append(windows + b)
                most = max(most, b + n - spec.length + 1)
            first, count, anchor, key, u = spec.cut(units)
            segment = np.searchsorted(units.doc, first, "right") - 1
            inside = first - units.doc[segment]
            yield units, u, first, count, anchor, key, np.array(ahead, np.int64)[segment] + inside, np.stack([np.array(number, np.int64)[segment], np.array(base, np.int64)[segment] + inside])

    def _slices(self, spec: Spec) -> Iterator[list[tuple[int, int, bytes]]]:
        held, size = [], 0
        for t, text in enumerate(self.texts):
            for base, part in spec.segments(text):
                if held and size + len(part) > SLICE:
                    yield held
                    held, size = [], 0
                held.append((t, base, part))
                size += len(part)
        if held:
            yield held


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = (keys % _U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        yield int(shard[part[0]]), part


_MESSAGE = [("to", pa.int64()), ("batch", pa.int64()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
MESSAGE = "to long, batch long, kind byte, a binary, b binary, c binary, d binary"
NAMES, PIECES, REPEATED, MARKED = range(4)


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_MESSAGE)], names=[n for n, _ in _MESSAGE])


def _names(spec: Spec, shards: int) -> Callable:
    """Step 1: a batch's keys, to their shards: those of one piece, and the others with their counts."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        batch, told = _Batch.read(group, spec), key[0].as_py()
        keys = [x[5] for x in batch.pieces(spec)]
        found, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))
        rows = []
        for s, i in _by_shard(found, shards):
            once, often = i[count[i] == 1], i[count[i] > 1]
            rows.append((s, told, NAMES, _blob(found[once]), _blob(found[often]), _blob(count[often].astype(np.uint32)), b""))
        return _messages(rows)

    return run


def _repeated(spec: Spec) -> Callable:
    """A shard's keys from all batches -> for each batch the ones with two places or more, and which of them are hot."""

    def run(group: pa.Table) -> pa.Table:
        batch = group.column("batch").to_pylist()
        once, often = ([np.frombuffer(x, np.uint64) for x in group.column(c).to_pylist()] for c in "ab")
        counts = [np.frombuffer(x, np.uint32) for x in group.column("c").to_pylist()]
        h = np.concatenate([x for pair in zip(once, often) for x in pair])
        count = np.concatenate([x for a, c in zip(once, counts) for x in (np.ones(len(a), np.int64), c.astype(np.int64))])
        edges = np.r_[0, np.cumsum([len(a) + len(b) for a, b in zip(once, often)])]
        _, place = np.unique(h, return_inverse=True)
        total = np.bincount(place, weights=count).astype(np.int64)[place] if len(h) else count
        rows = []
        for b, x, y in zip(batch, edges.tolist(), edges[1:].tolist()):
            keep = x + np.flatnonzero(total[x:y] >= 2)
            if len(keep):
                rows.append((0, b, REPEATED, _blob(h[keep]), _blob((total[keep] > spec.hot).astype(np.uint8)), b"", b""))
        return _messages(rows)

    return run


def _send(spec: Spec, shards: int) -> Callable:
    """Step 2: a batch's distinct pieces under repeated keys, to the keys' shards, and the windows that it can mark by itself."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        told = key[0].as_py()
        known = np.concatenate([np.frombuffer(x, np.uint64) for x in right.column("a").to_pylist()] or [np.zeros(0, _U)])
        hot = np.concatenate([np.frombuffer(x, np.uint8) for x in right.column("b").to_pylist()] or [np.zeros(0, np.uint8)])
        if not len(known):
            return _messages([])
        order = np.argsort(known)
        known, hot = known[order], hot[order].astype(bool)
        batch = _Batch.read(left, spec)
        number: dict[bytes, int] = {}
        which, held = [], []
        for units, u, first, count, anchor, keys, window, (doc, place) in batch.pieces(spec):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            same = known[at] == keys
            single = same & hot[at]
            parts = [(same & ~single, None), (single, grams(u, spec.length) ^ _WINDOW if single.any() else None)]
            for some, own in parts:
                i = np.flatnonzero(some)
                if not len(i):
                    continue
                f, c, o, k, w, d, p = (x[i] for x in (first, count, anchor, keys, window, doc, place))
                if own is not None:
                    n = _within(c)
                    f, o, w, d, p = (np.repeat(x, c) + y for x, y in ((f, n), (o, -n), (w, n), (d, 0), (p, n)))
                    c, k = np.ones(len(f), np.int64), own[f]
                texts = zip(units.start[f].tolist(), units.end[f + c + spec.length - 2].tolist())
                which += [number.setdefault(units.buffer[a:b], len(number)) for a, b in texts]
                held.append(np.stack([k.view(np.int64), *batch.rank[d].T, batch.before[d] + p, o, w, c]))
        if not held:
            return _messages([])
        pieces, which = np.concatenate(held, axis=1), np.array(which, np.int64)
        _, lead, again = np.unique(which, return_index=True, return_counts=True)
        # a content that the batch has twice: its later places (of bytes), or all of them (of words), are marked as they are
        mark = np.ones(len(which), bool)
        mark[lead if spec.later_only else lead[again == 1]] = False
        rows = [(told % shards, told, MARKED, _blob(pieces[5, mark]), _blob(pieces[6, mark].astype(np.uint32)), b"", b"")] if mark.any() else []
        contents = list(number)
        first = pieces[:, lead]
        for s, i in _by_shard(first[0].view(np.uint64), shards):
            mine = [contents[k] for k in i.tolist()]
            meta = np.stack([*first[:6, i], (again[i] > 1).astype(np.int64)])
            rows.append((s, told, PIECES, b"".join(mine), _blob(np.array([len(x) for x in mine], np.uint32)), _blob(meta), b""))
        return _messages(rows)

    return run


def _equal_classes(units: Units, spec: Spec, starts: np.ndarray, anchors: np.ndarray | None = None) -> np.ndarray:
    """Class of each window of bytes (number of its first equal in `starts`).

    anchors: each window's anchor; of two equal windows it stands equally far in. Anchors are sorted by what follows them
    and by what comes before them, backward; windows whose anchor is o bytes in are equal if nothing parts their anchors
    within length - o bytes ahead or o bytes back.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    if anchors is None:
        g = grams(units.hashes(), spec.gram)
        low = _slide(g, spec.length - spec.gram + 1, np.minimum)[starts]
        inside = g[starts[:, None] + np.arange(spec.length - spec.gram + 1)]
        anchors = starts + (inside == low[:, None]).argmax(axis=1)
    anchor, which = np.unique(anchors, return_inverse=True)
    back = anchors - starts
    data = np.frombuffer(units.buffer, np.uint8)
    inside = np.searchsorted(units.doc, anchor, "right") - 1
    ahead = Suffixes(data, anchor, np.minimum(units.doc[inside + 1] - anchor, spec.length))
    order_a, lcp_a = ahead.order()
    del ahead
    behind = Suffixes(data[::-1].copy(), len(data) - anchor, np.minimum(anchor - units.doc[inside], spec.length))
    order_b, lcp_b = behind.order()
    rank_a, rank_b = np.empty_like(order_a), np.empty_like(order_b)
    rank_a[order_a], rank_b[order_b] = np.arange(len(order_a)), np.arange(len(order_b))
    rep = np.empty(len(starts), np.int64)
    by = np.argsort(back, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(back[by])) + 1):
        o = int(back[part[0]])
        a, b = np.cumsum(lcp_a < spec.length - o)[rank_a[which[part]]], np.cumsum(lcp_b < o)[rank_b[which[part]]]
        _, first, group = np.unique(a * (len(anchor) + 1) + b, return_index=True, return_inverse=True)
        rep[part] = part[first[group]]
    return rep


def _repeated_windows(units: Units, spec: Spec, weight: np.ndarray) -> np.ndarray:
    """Which window starts of texts of words have copies: each text is streamed through an FM-index of all of them, where it
    counts `weight` times, and reported where its matching statistic reaches the window's length."""
    number: dict[bytes, int] = {}
    words = [units.buffer[a:b] for a, b in zip(units.start.tolist(), units.end.tolist())]
    symbols = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64)
    size = np.diff(units.doc)
    start = units.doc[:-1] + np.arange(len(size))  # a 0 closes each text
    text = np.zeros(len(symbols) + len(size), np.int64)
    text[_spread(start, size)] = symbols
    index = FmIndex(text, len(number) + 1, spec.length)
    return index.repeated(text, start, size, np.repeat(weight, size + 1))[_spread(start, size)]


def _marked(spec: Spec, contents: list[bytes], which: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of some keys, from all batches -> runs of windows to mark: number of the piece, first window, count.

    meta, by row: key, rank (two rows), place, anchor, window, whether its batch has more of it.
    """
    units = spec.units(contents)
    windows = np.diff(units.doc) - spec.length + 1
    if spec.later_only:  # of equal pieces the first stays; windows are compared between different ones
        order = np.lexsort((meta[3], meta[2], meta[1], which))
        lead = order[np.r_[True, which[order][1:] != which[order][:-1]]]  # by content
        rest = np.setdiff1d(np.arange(len(which)), lead, assume_unique=True)
        starts = _spread(units.doc[:-1], windows)
        rep = _equal_classes(units, spec, starts, np.repeat(units.doc[:-1] + meta[4, lead], windows))
        # pieces of a document share no windows, so in their order windows stand as in the table
        by = np.lexsort((meta[3, lead], meta[2, lead], meta[1, lead]))
        order = _spread((np.cumsum(windows) - windows)[by], windows[by])
        first = np.empty(len(rep), np.int64)
        first[rep[order[::-1]]] = order[::-1]
        mark = first[rep] != np.arange(len(rep))
        owner = np.repeat(lead, windows)
    else:
        weight = np.bincount(which, weights=1 + meta[6]).astype(np.int64)
        alone = weight[which] == 1
        rest, lead = np.flatnonzero(~alone & (meta[6] == 0)), np.flatnonzero(alone)
        found = _repeated_windows(units, spec, weight)
        count = windows[which[lead]]
        mark = found[_spread(units.doc[which[lead]], count)]
        owner, windows = np.repeat(lead, count), count
    hit, nth = np.flatnonzero(mark), _within(windows)
    edge = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)]) if len(hit) else hit
    whole = np.diff(units.doc)[which[rest]] - spec.length + 1
    return np.r_[owner[hit[edge]], rest], np.r_[nth[hit[edge]], np.zeros(len(rest), np.int64)], np.r_[np.diff(np.r_[edge, len(hit)]), whole]


def _answer(spec: Spec) -> Callable:
    """Step 3: a shard's pieces -> for each batch, its windows to mark."""

    def run(group: pa.Table) -> pa.Table:
        kinds = np.asarray(group.column("kind"))
        done = group.filter(pa.array(kinds == MARKED))
        rows = [(0, *r) for r in zip(*(done.column(c).to_pylist() for c in ("batch", "kind", "a", "b", "c", "d")))]
        group = group.filter(pa.array(kinds == PIECES))
        if not group.num_rows:
            return _messages(rows)
        batch = group.column("batch").to_pylist()
        joined = group.column("a").to_pylist()
        sizes = [np.frombuffer(x, np.uint32).astype(np.int64) for x in group.column("b").to_pylist()]
        meta = np.concatenate([np.frombuffer(x, np.int64).reshape(7, -1) for x in group.column("c").to_pylist()], axis=1)
        del group
        source = np.repeat(np.arange(len(batch)), [len(x) for x in sizes])
        end = np.concatenate([np.cumsum(x) for x in sizes])
        size = np.concatenate(sizes)
        order = np.argsort(meta[0], kind="stable")
        key = meta[0, order]
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(order)]
        piece, first, count = [], [], []
        at = 0
        while at < len(edges) - 1:
            distinct: dict[bytes, int] = {}
            which, held, begin = [], 0, at
            while at < len(edges) - 1 and held < CHUNK:
                for i in order[edges[at] : edges[at + 1]].tolist():
                    text = joined[source[i]][end[i] - size[i] : end[i]]
                    if (n := distinct.setdefault(text, len(distinct))) == len(distinct) - 1:
                        held += len(text)
                    which.append(n)
                at += 1
            some = order[edges[begin] : edges[at]]
            p, f, c = _marked(spec, list(distinct), np.array(which, np.int64), meta[:, some])
            piece.append(some[p]), first.append(f), count.append(c)
        piece, first, count = (np.concatenate(x) for x in (piece, first, count))
        for part in np.split(by := np.argsort(source[piece], kind="stable"), np.flatnonzero(np.diff(source[piece][by])) + 1):
            if len(part):
                rows.append((0, batch[source[piece[part[0]]]], MARKED, _blob(meta[5, piece[part]] + first[part]), _blob(count[part].astype(np.uint32)), b"", b""))
        return _messages(rows)

    return run


def _covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """A mask of n units: those from a start to its stop."""
    gone = np.zeros(n, bool)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    fresh = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    for a, b in zip(start[fresh].tolist(), stop[np.r_[fresh[1:], len(stop)] - 1].tolist()):
        gone[a:b] = True
    return gone


def _finish(spec: Spec, digest: Callable) -> Callable:
    """Step 4: marks the units of each text of the batch and digests it."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        batch = _Batch.read(left, spec)
        start = np.concatenate([np.frombuffer(x, np.int64) for x in right.column("a").to_pylist()] or [np.zeros(0, np.int64)])
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in right.column("b").to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
        order = np.argsort(start, kind="stable")
        start, count = start[order], count[order]
        out, windows = [], 0
        for i, text in zip(batch.ids, batch.texts):
            n = spec.size(text)
            stop = windows + max(0, n - spec.length + 1)
            a, b = np.searchsorted(start, [windows, stop])
            gone = _covered(start[a:b] - windows, start[a:b] - windows + count[a:b] + spec.length - 1, n) if b > a else None
            out.append((i, *digest(text, n, gone)))
            windows = stop
        return _digests(digest, out)

    return run


def _digests(digest: Callable, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), *digest.types])], names=["doc_id", *digest.columns])


def without(text: bytes, gone: np.ndarray | None, words: bool) -> bytes:
    """A text without its marked units; words are joined by a space."""
    raw = np.frombuffer(text, np.uint8)
    if not words:
        return text if gone is None else raw[~gone].tobytes()
    blank = _SPACE[raw]
    if gone is not None:
        word = np.cumsum(~blank & np.r_[True, blank[:-1]]) - 1
        blank = blank | gone[np.maximum(word, 0)]
    # of the blanks only the one right before a word stays, as a space
    before = np.r_[~blank[1:], np.zeros(min(1, len(blank)), bool)]
    return np.where(blank, np.uint8(32), raw)[~blank | before].tobytes().lstrip(b" ")


def remove_repeats(docs: DataFrame, spec: Spec, digest: Callable, schema: str) -> DataFrame:
    """(doc_id, text) -> one row per document with what digest makes of its text, its units' number and their marks."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_slices(batches, "text"):
            out = [(i, *digest(t, spec.size(t), None)) for i, t in zip(rows.column(0).to_pylist(), texts)]
            yield from _digests(digest, out).to_batches()

    size = F.octet_length("text")
    some = slim.where(size >= spec.least)
    batches = parts_for(some, "text", BATCH_MB)
    # partitions follow the session's setting, not the data; each takes its batches and shards one after the other
    parts = min(batches, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    dealt = some.withColumn("batch", F.pmod(by, F.lit(batches))).repartition(parts, "batch")
    named = dealt.groupBy("batch").applyInArrow(_names(spec, batches), MESSAGE)
    repeated = named.repartition(parts, "to").groupBy("to").applyInArrow(_repeated(spec), MESSAGE)
    sent = dealt.groupBy("batch").cogroup(repeated.repartition(parts, "batch").groupBy("batch")).applyInArrow(_send(spec, batches), MESSAGE)
    answers = sent.repartition(parts, "to").groupBy("to").applyInArrow(_answer(spec), MESSAGE)
    done = dealt.groupBy("batch").cogroup(answers.repartition(parts, "batch").groupBy("batch")).applyInArrow(_finish(spec, digest), schema)
    return done.unionByName(slim.where(size < spec.least).mapInArrow(whole, schema))
