"""Near-duplicate groups by SimHash over a Gray-order hierarchical index (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._keys import KEY, keyed
from larkspan.llm._shared import components, cut, row_slices, table, text_or_empty

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
FANOUT = 8
#: Fingerprints that one group may hold before it is divided by further bits.
GROUP_LIMIT = 4096


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    rows = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): one row per input row; null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps)], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _thirds(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _masks(parts: int, depth: int) -> list[list[tuple[int, int, int]]]:
    """By level: (parent's number, own number, mask). A pair within parts - 1 differing bits agrees on one of any
    division of the bits in parts, so it shares a key at every level under a parent that it shares."""
    levels, above = [], [(0, 0, list(range(64)))]
    for _ in range(depth):
        now = []
        for _, own, rest in above:
            mask = 0 if len(above) == 1 and not levels else next(m for p, o, m in levels[-1] if o == own)
            for block in _thirds(rest, parts):
                got = mask | sum(1 << b for b in block)
                now.append((own, len(now), got, [b for b in rest if b not in block]))
        levels.append([(p, o, m) for p, o, m, _ in now])
        above = [(p, o, r) for p, o, _, r in now]
    return levels


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Fingerprints of several groups, each in Gray order, under nodes that hold the bits their members share.

    Level 0 are the fingerprints; every FANOUT neighbours get a node (mask of shared bits, their pattern), those nodes
    get nodes in turn, up to one root a group. A search adds up the differing bits from the root down, each bit once,
    and drops a node with all below it as soon as the sum passes the radius, or if all below it bears the query's label.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, label: np.ndarray | None = None) -> None:
        self.label = np.arange(len(codes)) if label is None else label
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(codes, full, np.arange(len(codes)), np.arange(1, len(codes) + 1), np.arange(len(codes)) + 1)]
        ones, zeros, owner, last = codes, ~codes, group, np.arange(len(codes)) + 1
        low = high = self.label
        self.labels = [(low, high)]
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(starts) == len(owner):
                break
            within = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            first = np.flatnonzero(within % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            end = np.r_[first[1:], len(owner)]
            owner, last = owner[first], last[end - 1]
            self.levels.append((ones, ones | zeros, first, end, last))
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.labels.append((low, high))
        self.roots = owner

    def links(self, codes: np.ndarray, root: np.ndarray, radius: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of positions in one group within the radius, block queries at a time. root: each query's root."""
        for a in range(0, len(codes), block):
            query = np.arange(a, min(a + block, len(codes)))
            node, known = root[query], np.zeros(len(query), np.uint64)
            seen, far = np.zeros(len(query), np.uint64), np.zeros(len(query), np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                pattern, mask, first, end, last = self.levels[level]
                if level < len(self.levels) - 1:
                    _, _, up_first, up_end, _ = self.levels[level + 1]
                    width = up_end[node] - up_first[node]
                    pick = np.repeat(np.arange(len(node)), width)
                    node = up_first[node][pick] + np.arange(len(pick)) - np.repeat(np.cumsum(width) - width, width)
                    query, seen, far = query[pick], seen[pick], far[pick]
                fresh = mask[node] & ~seen
                far = far + np.bitwise_count((codes[query] ^ pattern[node]) & fresh)
                low, high = self.labels[level]
                own = self.label[query]
                keep = (far <= radius) & (last[node] > query + 1) & ((low[node] != own) | (high[node] != own))
                query, node, seen, far = query[keep], node[keep], (seen | fresh)[keep], far[keep]
            found = node > query
            yield query[found], node[found]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = label[i], label[j]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _search(radius: int, limit: int | None):
    """Streams rows sorted by (mid, val, rank); groups over the limit are left to the next level."""

    def solve(codes: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        index = GrayIndex(codes, group)
        label, root = np.arange(len(codes)), np.searchsorted(index.roots, group)
        for i, j in index.links(codes, root, radius):
            _join(label, i, j)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(codes[moved].view(np.int64)), pa.array(codes[label[moved]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the open group's rows first, then complete ones are solved

        def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            edge = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]
            group = np.cumsum(edge) - 1
            size = np.bincount(group)[group]
            ok = (size > 1) & (size <= (limit or len(rows)))
            if ok.any():
                yield solve(rows[ok, 2].view(np.uint64), group[ok])

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            if sum(map(len, held)) < 65536:
                continue
            rows = np.concatenate(held)
            same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
            at = len(rows) - int(same.sum())
            yield from close(rows[:at])
            rest = rows[at:]
            # an open group that has passed the limit is not this level's: what marks it as too large is enough
            held = [rest[: limit + 1] if limit else rest]
        if held:
            yield from close(np.concatenate(held))

    return run


def near_links(nodes: DataFrame, radius: int = 2, limit: int = GROUP_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect all pairs within the radius, a spanning set per group.

    Pairs within the radius agree on at least one of radius + 1 blocks of bits: each block's table is sorted in Gray
    order and searched group by group through GrayIndex. A group over the limit is divided again by blocks of its
    remaining bits, as often as it takes; nothing is capped: the last level's groups are small by their number of bits.
    """
    levels = _masks(radius + 1, 4)
    parents, rows, found = None, nodes.select("fp"), None
    for depth, masks in enumerate(levels):
        if depth == 0:
            keys = F.array(*[F.struct(F.lit(o).alias("mid"), F.lit(_signed(m)).alias("mask")) for _, o, m in masks])
            rows = rows.select("fp", F.explode(keys).alias("k"))
        else:
            by_parent: dict[int, list] = {}
            for p, o, m in masks:
                by_parent.setdefault(p, []).append(F.struct(F.lit(o).alias("mid"), F.lit(_signed(m)).alias("mask")))
            children = F.element_at(F.array(*[F.array(*by_parent[p]) for p in sorted(by_parent)]), F.col("mid") + 1)
            rows = rows.join(parents, ["mid", "val"], "left_semi").select("fp", F.explode(children).alias("k"))
        rows = rows.select(F.col("k.mid").alias("mid"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("val"), "fp")
        final = depth == len(levels) - 1
        kept = rows
        if not final:
            parents = cut(rows.groupBy("mid", "val").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("mid", "val"))
            divided = not parents.isEmpty()
            if divided:
                kept = rows.join(parents, ["mid", "val"], "left_anti")
        ranked = kept.repartition("mid", "val").select("mid", "val", "fp", _rank_column().alias("rank"))
        here = ranked.sortWithinPartitions("mid", "val", "rank").drop("rank").mapInArrow(_search(radius, None if final else limit), "u long, v long")
        found = here if found is None else found.unionByName(here)
        if final or not divided:
            return found
    return found


def _rank_column():
    x = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row per input row.

    Null or wordless text: fingerprint zero, linked like any other. Null doc_id: the row is kept, and never names a
    component (one of only such rows has a null component_id). Repeated rows and ids: each row is returned. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_links(nodes, radius, limit))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = named.join(ids, "root").select("fp", "component_id")
    out = rows.join(names, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bands of a text's least shingle hashes, and hashes of a band.
BANDS, BAND = 12, 5
#: Bits that two fingerprints of one block may differ in: at similarity 0.8 about 10 of 64, less than 3.2 deviations over 12.
RADIUS = 22
#: Rows and bytes of text of a block of a key, at most about.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: The bands that each round looks at, and whether all blocks of a crowded key meet. The first round links what is nearest, so
#: that large groups are one by the last, which looks at everything.
ROUNDS = ((2, False), (BANDS, True))
#: Bits of the filter that picks texts to verify.
FILTER_BITS = 1 << 23
_SEEDS = np.random.default_rng(64).integers(1, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = 5) -> set[bytes]:
    """A text's distinct sequences of `shingle` words; one of all its words, if it has fewer."""
    words = text.lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """Hashes of a text's distinct shingles, rising."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist() if n > 1 else [0]
    stops = ends[shingle - 1 :].tolist() if n > 1 else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64))


def _votes(hashes: np.ndarray) -> int:
    """SimHash of distinct hashes, as a signed number."""
    if not len(hashes):
        return 0
    rows = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: two texts of similarity j agree on it with a chance of j to the power BAND."""
    if not len(hashes):
        return []
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 8192):
        x = hashes[a : a + 8192, None] * _SEEDS
        x ^= x >> np.uint64(29)
        least = np.minimum(least, x.min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, BAND).T:
        out = (out ^ x) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64).tolist()


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_slices(batches, "text"):
            out = []
            for t in texts:
                own = shingle_hashes(t, shingle)
                whole = xxhash.xxh3_128_digest(own.tobytes())
                out.append((*np.frombuffer(whole, np.int64).tolist(), len(t), _votes(own), _bands(own)))
            cols = [rows.column(rows.schema.get_field_index(c)) for c in KEY]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], [*KEY, "s1", "s2", "size", "fp", "bands"])

    return run


def _blocks(named: DataFrame, bands: int, cross: bool, block: int) -> DataFrame:
    """(node, root, size, bands) -> (node, root, k, b, side): rows of the keys that hold several roots, in blocks.

    A key's rows are one block if they are few. If not, they are dealt into parts: each is a block (not cross), or each two
    of them are, but for those of the key's largest root (side 1), which are linked: they meet the others' parts only.
    """
    keys = named.select("node", "root", "size", F.explode(F.slice("bands", 1, bands)).alias("k"))
    per = keys.groupBy("k", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    groups = per.groupBy("k").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "root")).alias("top")).where("roots > 1")
    parts = lambda n, s: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(s / BLOCK_BYTES)).cast("int")
    top, n, s = F.col("top"), F.col("n"), F.col("s")
    groups = groups.select("k", top["root"].alias("top"), parts(n, s).alias("all"), parts(top["n"], top["s"]).alias("own"), parts(n - top["n"], s - top["s"]).alias("rest"))
    rows = keys.join(groups, "k")
    side = (F.col("root") == F.col("top")).cast("int")
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    if not cross:
        return rows.select("node", "root", "k", part("all").alias("b"), F.lit(0).alias("c"), F.lit(-1).alias("side"))
    pair = lambda b, c: F.struct(b.alias("b"), c.alias("c"))
    low, high = (lambda c: F.least(part("rest"), c)), (lambda c: F.greatest(part("rest"), c))
    own, rest = F.sequence(F.lit(0), F.col("own") - 1), F.sequence(F.lit(0), F.col("rest") - 1)
    among = F.transform(rest, lambda c: pair(low(c), high(c)))
    against = F.transform(own, lambda c: pair(-1 - c, part("rest")))
    mine = F.transform(rest, lambda c: pair(-1 - part("own"), c))
    where = F.when(F.col("all") == 1, F.array(pair(F.lit(0), F.lit(0)))).when(side == 1, mine).otherwise(F.concat(among, against))
    return rows.select("node", "root", "k", F.explode(where).alias("w"), F.when(F.col("all") == 1, F.lit(-1)).otherwise(side).alias("side")).select("node", "root", "k", "w.b", "w.c", "side")


def _link(shingle: int, similarity: float, radius: int):
    """Streams rows (k, b, c, side, node, root, fp, text) sorted by block -> links (u, v) between roots of alike texts."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        group = np.cumsum([0, *(a[:3] != b[:3] for a, b in zip(rows, rows[1:]))])
        codes = np.array([r[6] for r in rows], np.int64).view(np.uint64)
        order = np.lexsort((_gray_rank(codes), group))
        rows, codes, group = [rows[i] for i in order.tolist()], codes[order], group[order]
        roots, label = np.unique([r[5] for r in rows], return_inverse=True)
        side = np.array([r[3] for r in rows])
        index = GrayIndex(codes, group, label)
        link, held = np.arange(len(roots)), {}

        def find(x: int) -> int:
            while link[x] != x:
                link[x] = x = link[link[x]]
            return int(x)

        def own(i: int) -> np.ndarray:
            node = rows[i][4]
            if node not in held:
                held[node] = shingle_hashes(rows[i][7], shingle)
            return held[node]

        found = []
        for i, j in index.links(codes, np.searchsorted(index.roots, group), radius):
            keep = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] < 0) | np.array([rows[x][1] >= 0 for x in i.tolist()], bool))
            order = np.argsort(i[keep], kind="stable")
            i, j = i[keep][order], j[keep][order]
            for a, others in zip(i[edge := np.flatnonzero(np.r_[True, i[1:] != i[:-1]])] if len(i) else [], np.split(j, edge[1:]) if len(i) else []):
                x, others = own(int(a)), others.tolist()
                for some in (others[n : n + 64] for n in range(0, len(others), 64)):
                    some = [o for o in some if find(label[o]) != find(label[a])]
                    sets = [own(o) for o in some]
                    fits = [k for k, y in enumerate(sets) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9]
                    some, sets = [some[k] for k in fits], [sets[k] for k in fits]
                    if not some:
                        continue
                    size = np.array([len(y) for y in sets])
                    every = np.concatenate(sets)
                    same = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
                    both = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64)
                    for k in np.flatnonzero(both >= similarity * (len(x) + size - both) - 1e-9).tolist():
                        u, v = find(label[a]), find(label[some[k]])
                        if u != v:
                            link[max(u, v)] = min(u, v)
                            found.append((roots[u], roots[v]))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:7]] + [batch.column(7).cast(pa.large_binary()).to_pylist()]
            for row in zip(*cols):
                if size > BLOCK_BYTES // 8 and row[:3] != held[-1][:3]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7]) + 256
        if held:
            yield solve(held)

    return run


def _texts_of(docs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of the nodes in rows. A bit filter over the hashes of texts, at most FILTER_BITS numbers that reach the
    driver, keeps most others out of the shuffle."""
    named = cut(rows.select("node").distinct().join(nodes.select("node", "rep.z", "rep.i", "rep.h"), "node"))
    slots = np.asarray(named.select(F.pmod("h", F.lit(FILTER_BITS)).cast("int").alias("b")).distinct().toArrow().column(0).combine_chunks())
    there = np.zeros(FILTER_BITS, bool)
    there[slots] = True
    packed, bits = np.packbits(there, bitorder="little"), FILTER_BITS

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.asarray(batch.column(2)) % bits
            yield batch.filter(pa.array((packed[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1))

    slim = keyed(docs).select(*KEY, "text").mapInArrow(some, "z boolean, i long, h long, text string")
    return slim.join(named, KEY).select("node", "text").dropDuplicates(["node"])


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, without near copies: of each group the one of smallest doc_id (nulls last, then by a
    hash of the text) stays.

    Near copies share `similarity` of their distinct `shingle`-word sequences or more (Jaccard). Texts with the same
    sequences are one from the start. Others are compared if they share the key of one of BANDS bands, each the least of the
    sequences' hashes under BAND orders: at similarity 0.8 a pair shares none with a chance of under 1 %, at any size of
    the table. Under a key, a Gray-order hierarchical index over the texts' SimHash fingerprints drops all rows out of
    radius and all that are linked already, whole nodes at a time; each pair that is left is decided by the exact share of
    its sequences' hashes. Every document is in every band; crowded keys are searched whole, in blocks of bounded size.
    Groups are what links reach. Texts of fewer words are one sequence; null, empty and blank texts are one group. Rows with
    equal id and text are one document. An empty table stays so. Of very long texts only the distinct sequences' hashes are
    held. Columns keep their names, whatever they are.
    """
    signed = keyed(docs).select(*KEY, "text").mapInArrow(_sign(shingle), "z boolean, i long, h long, s1 long, s2 long, size long, fp long, bands array<long>")
    sets = signed.groupBy("s1", "s2").agg(F.min(F.struct(*KEY, "size")).alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = cut(sets.select(F.monotonically_increasing_id().alias("node"), "rep", "fp", "bands"))
    named = nodes.select("node", "fp", "bands", "rep", F.col("rep.size").alias("size"), F.col("node").alias("root"))
    for bands, cross in ROUNDS:
        rows = cut(_blocks(named, bands, cross, block))
        full = rows.join(named.select("node", "fp"), "node").join(_texts_of(docs, nodes, rows), "node")
        dealt = full.select("k", "b", "c", "side", "node", "root", "fp", "text").repartition("k", "b", "c").sortWithinPartitions("k", "b", "c")
        found = dealt.mapInArrow(_link(shingle, similarity, RADIUS), "u long, v long")
        merged = components(found).select(F.col("node").alias("root"), F.col("root").alias("to"))
        named = named.join(merged, "root", "left").select("node", "fp", "bands", "rep", "size", F.coalesce("to", "root").alias("root"))
    kept = named.groupBy(F.col("root").alias("g")).agg(F.min("rep").alias("rep"))
    names = [f"{k}__key" for k in KEY]
    kept = kept.select(*[F.col(f"rep.{k}").alias(n) for k, n in zip(KEY, names)])
    text = text_or_empty()
    own = docs.withColumns({names[0]: F.col("doc_id").isNull(), names[1]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), names[2]: F.xxhash64(text)})
    return own.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)


def op1_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
