"""Hierarchical multi-length packing of token ids (operator 8)."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._shared import row_slices, table, text_or_empty

TIERS = (128, 256, 512, 1024)
#: Segments a worker remembers at most; then it starts anew, so its memory is bounded.
CACHE = 500_000
_AFTER = [" " + c for c in "\t\n\x0b\x0c\r\x85\xa0"]
_RARE = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_END = b"\0\0\0\0"


class Encoder:
    """Ids of the byte-level vocabulary, as little-endian bytes, equal to the library's.

    A pre-token starts before every single space between other characters, so the segments between them encode alone.
    Texts with a special token's string go through the library itself.
    """

    def __init__(self, vocabulary: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self.segments: dict[str, bytes] = {}

    def _learn(self, segments: set[str]) -> None:
        """Ids of segments with a space before each; those that end in no white space are encoded side by side."""
        joint = [s for s in segments if s and s == s.strip()]
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(joint)) if joint else [], "<u4")
        ends = np.cumsum([len(s.encode()) + 1 for s in joint])
        stops = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1 if joint else []
        data, a = ids.tobytes(), 0
        for s, b in zip(joint, stops):
            self.segments[s], a = data[4 * a : 4 * b], b
        for s in segments.difference(joint):
            self.segments[s] = np.array(self.fast.encode_ordinary(" " + s), "<u4").tobytes()

    def _splits(self, text: str) -> bool:
        """Whether no run of white space, which is matched as one, holds a place before a single space."""
        if "  " in text or text[:1] == " " or text[-1:] == " " or any(x in text for x in _AFTER):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not _RARE.search(text)
        return True

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if self._splits(t) and not any(s in t for s in self.special) else None for t in texts]
        rest = set().union(*(x[1:] for x in split if x))
        if new := rest.difference(self.segments):
            if len(self.segments) + len(new) > CACHE:
                self.segments, new = {}, rest  # begun anew, with all that these texts need
            self._learn(new)
        get, out = self.segments.__getitem__, []
        for text, parts in zip(texts, split):
            if parts:
                ids = np.array(self.fast.encode_ordinary(parts[0]), "<u4").tobytes() + b"".join(map(get, parts[1:]))
            elif any(s in text for s in self.special):
                ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                ids = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            out.append(ids)
        return out


class Packer:
    """Pieces to sequences. What is left at the end of a round goes into the next one.

    Whole windows are cut off long documents. Each remainder goes to the smallest tier that holds it. From the
    longest tier down, the longest remainder opens a window; its gap is filled with the longest remainders of that
    and shorter tiers that fit, and its rest with a piece cut off a short one. Windows that cannot be filled are taken
    apart and cut in sequence. Only finish() may leave one sequence that is padded.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers, self.window = tiers, tiers[-1]
        self.left: list[tuple] = []

    def round(self, docs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """docs: (key, number of ids). Gives sequences of pieces (length, key, start)."""
        pools: dict[int, list] = {t: [] for t in self.tiers}
        for key, n in docs:
            whole = n - n % self.window
            for start in range(0, whole, self.window):
                yield [(self.window, key, start)]
            if n > whole:
                self._put(pools, (n - whole, key, whole))
        for piece in self.left:
            self._put(pools, piece)
        for pool in pools.values():
            pool.sort()
        loose: list[tuple] = []
        for t in reversed(self.tiers):
            while pools[t]:
                pieces = [pools[t].pop()]
                gap = t - pieces[0][0]
                for s in [x for x in reversed(self.tiers) if x <= t]:
                    while gap and pools[s] and (at := bisect_right(pools[s], (gap, float("inf"), 0))):
                        pieces.append(pools[s].pop(at - 1))
                        gap -= pieces[-1][0]
                if gap and (s := next((x for x in self.tiers if x <= t and pools[x]), None)):
                    n, key, start = pools[s].pop(0)
                    pieces.append((gap, key, start))
                    self._put(pools, (n - gap, key, start + gap), insort)
                    gap = 0
                if gap:
                    loose += pieces
                else:
                    yield pieces
        yield from self._stream(loose)

    def _put(self, pools: dict[int, list], piece: tuple, add=list.append) -> None:
        add(pools[next(t for t in self.tiers if piece[0] <= t)], piece)

    def _stream(self, loose: list[tuple]) -> Iterator[list[tuple]]:
        held, room = [], self.window
        for n, key, start in loose:
            while n:
                k = min(n, room)
                held.append((k, key, start))
                n, start, room = n - k, start + k, room - k
                if not room:
                    yield held
                    held, room = [], self.window
        self.left = held

    def finish(self) -> Iterator[list[tuple]]:
        """The rest, by falling tiers that it fills; what fills none is the one sequence to pad."""
        rest = self.left
        for t in reversed(self.tiers):
            if sum(n for n, *_ in rest) >= t:
                held, room, after = [], t, []
                for n, key, start in rest:
                    k = min(n, room)
                    if k:
                        held.append((k, key, start))
                        room -= k
                    if n > k:
                        after.append((n - k, key, start + k))
                yield held
                rest = after
        self.left = []
        if rest:
            yield rest


class StepGroups:
    """Deals sequences to groups of about one step's work: `size` ids each, and alike in the work that attention makes.

    A round's sequences, by falling work (the sum of its pieces' squared lengths), each go to the group with the least work
    so far of those that have room. What does not fill a group waits for the next round.
    """

    def __init__(self, size: int) -> None:
        self.size, self.next = size, 0
        self.wait: list[list[tuple]] = []

    def deal(self, sequences: list[list[tuple]], last: bool = False) -> Iterator[tuple[int, list[tuple]]]:
        """Sequences of pieces (length, ...) -> (group, sequence)."""
        every = self.wait + sequences
        length = [sum(n for n, *_ in s) for s in every]
        count = -(-sum(length) // self.size) if last else sum(length) // self.size
        if not count:
            self.wait = every
            return
        work = [sum(n * n for n, *_ in s) for s in every]
        open_ = [(0, g, 0) for g in range(count)]
        self.wait = []
        for i in sorted(range(len(every)), key=lambda i: (-work[i], -length[i], i)):
            full = []
            while open_ and open_[0][2] + length[i] > self.size:
                full.append(heappop(open_))
            if open_:
                done, g, used = heappop(open_)
                heappush(open_, (done + work[i], g, used + length[i]))
                yield self.next + g, every[i]
            else:
                self.wait.append(every[i])
            for x in full:
                heappush(open_, x)
        self.next += count
        if last and self.wait:  # what no group of the last round had room for
            yield from self.deal([], True)


_encoders: dict[str, Encoder] = {}


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", tiers: tuple[int, ...] = TIERS, group: int = 8, ids: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> one row per piece of a document in a sequence.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the sequence's size), step_group (sequences
    of group x the longest tier's ids together at most, balanced by their attention's work), and the ids themselves if
    asked for. A document is its
    ids and a final 0; a null or empty text is that 0 alone. Null and repeated ids: each row is packed. An empty table
    gives no rows; other columns are ignored. Each partition packs on its own, without a shuffle: at most one padded
    sequence a partition, and memory for one slice of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encode, packer = _encoders[vocabulary], Packer(tiers)
        steps = StepGroups(group * packer.window)
        base = TaskContext.get().partitionId() << 40
        sequence, known = 0, {}

        def rows(sequences: Iterator[list[tuple]], last: bool = False) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for step, pieces in steps.deal(list(sequences), last):
                size, offset = sum(n for n, *_ in pieces), 0
                for n, key, start in pieces:
                    doc, data = known[key]
                    own = data[4 * start : 4 * (start + n)]
                    out.append((doc, start, n, zlib.crc32(own), len(data) // 4, base + sequence, offset, size, base + step, own if ids else None))
                    offset += n
                sequence += 1
            cols = list(zip(*out)) if out else [[]] * 10
            arrays = [pa.array(c, pa.int64()) for c in cols[:9]]
            if ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[9]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        key = 0
        for part, texts in row_slices(batches, "text", 4 << 20):
            now = []
            for doc, data in zip(part.column(0).to_pylist(), encode([t.decode() for t in texts])):
                known[key] = doc, data + _END
                now.append((key, len(known[key][1]) // 4))
                key += 1
            yield rows(packer.round(now))
            known = {k: known[k] for k in {p[1] for p in packer.left} | {p[1] for s in steps.wait for p in s}}
        yield rows(packer.finish(), True)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * ids
    schema = ", ".join(f"{n} long" if n != "ids" else "ids array<int>" for n in names)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return slim.mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
