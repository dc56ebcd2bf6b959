"""N-gram Jaccard join: distinct sets of word shingles link when their intersection is large enough for their union.

1. Every text becomes a sorted array of 64-bit shingle hashes and a hashed bitmap. Equal sets are one set from here on. Arrays
   aren't stored: they are made again from the texts where they are needed, which moves and writes less.
2. Shingles are ordered by how often they occur (counted over the whole table in a bounded number of hashed counters), then by
   hash. Two sets that link share one of their first n - ceil(0.85 n) + 1 shingles in that order: those are the keys of tiles.
3. Within a tile rows stand by size, and a row meets those that are large enough for it; what two bitmaps have apart bounds
   the overlap from above. Pairs that pass connect candidates: of a small tile each pair goes on, once for the many tiles that it
   shares; large tiles are walked, and leave as few links as connect them.
4. Connected candidates come together once more, with their arrays. Each pair within the size band whose bitmaps allow it is
   intersected exactly. Links are counted for each set and leave as a spanning forest.

A tile that is too large is cut into size-banded blocks, of which each pair that can hold a link is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eligo.llm.common import ASCII_LOWER, attach, cut, id_and_text, partitions, shared_folder, slices, table
from eligo.llm.simhash import components

#: Bits of a bitmap of up to half as many shingles; larger sets have twice as many, again and again, up to LEVELS times.
#: Counters of shingles, and the slices in which they are added up; words whose hashes a task remembers.
BITS, LEVELS, COUNTERS, SLICES, WORDS = 1 << 10, 8, 1 << 18, 64, 1 << 20
#: A key that so many sets have, and that stands so far above the mean counter, is dealt out over SALT parts at once.
HOT_ROWS, HOT_MEAN, SALT = 1_000_000, 8, 64
#: A block of a tile: rows that meet by their bitmaps, shingles that meet as arrays.
BLOCK_ROWS, BLOCK_SHINGLES = 16_384, 350_000
#: Tiles of up to so many sets go on as pairs; others, of up to so many rows, are compared all at once.
PAIRS, SMALL = 8, 24
#: Tables of sets up to so many rows are broadcast.
BROADCAST_ROWS = 1_000_000
#: A row is a set, or a slice of a task's counters.
SETS_SQL = "row long, doc_id long, n int, a long, b long, text_hash long, bits binary, slice int, counts binary"
SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("text_hash", pa.int64()), ("bits", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])
ARRAYS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shingles", pa.binary())])
KEYS_SQL = "key long, salt int, n int, a long"
KEYS = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("n", pa.int32()), ("a", pa.int64())])
#: A pair (a, b) of a small tile, or a row a of a large one, under its key.
MET_SQL = "key long, a long, b long"
MET = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
LINKS_SQL = "a long, b long, links long"
_PARTIAL = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(31)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ASCII_LOWER).split()


def shingles(text: str | None, size: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `size` words, or of its whole sequence if that is shorter. Each is a
    64-bit mix of its words' XXH64: two different shingles count as one with a chance of 2^-64."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _PARTIAL + hashes[i : len(words) - k + 1 + i])
    return np.unique(h)


def bitmap(sets: np.ndarray) -> bytes:
    level = min(LEVELS, max(0, (2 * len(sets) - 1) // BITS).bit_length())
    marks = np.zeros(BITS << level, np.uint8)
    marks[sets >> np.uint64(64 - BITS.bit_length() + 1 - level)] = 1
    return np.packbits(marks).tobytes()


class Maps:
    """Bitmaps of several sizes. A map of twice the size is folded by joining neighbouring bits, so that sets of about one size
    meet at the smaller size of the two."""

    def __init__(self, maps: list[bytes]) -> None:
        sizes = np.fromiter(map(len, maps), np.int64, len(maps))
        self.level = np.log2(np.maximum(sizes * 8 // BITS, 1)).astype(np.int64)
        self.place = np.zeros(len(maps), np.int64)
        self.own: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        self.ones, self.half_ones = np.zeros(len(maps), np.int64), np.zeros(len(maps), np.int64)
        for level in np.unique(self.level).tolist():
            rows = np.flatnonzero(self.level == level)
            self.place[rows] = np.arange(len(rows))
            raw = np.frombuffer(b"".join([maps[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), -1)
            self.own[level] = raw.view(np.uint64)
            self.ones[rows] = np.bitwise_count(self.own[level]).sum(1, dtype=np.int64)
            if level:
                bits = np.unpackbits(raw, axis=1)
                self.half[level] = np.packbits(bits[:, ::2] | bits[:, 1::2], axis=1).view(np.uint64)
                self.half_ones[rows] = np.bitwise_count(self.half[level]).sum(1, dtype=np.int64)

    def most(self, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """An upper bound of what sets i and j share, n being their sizes: each bit that only one has is a shingle, at least, that
        the other lacks."""
        bound = np.minimum(n[i], n[j])
        x, y = self.level[i], self.level[j]
        for a, b in {*zip(np.broadcast_to(x, bound.shape).tolist(), np.broadcast_to(y, bound.shape).tolist(), strict=True)}:
            if abs(a - b) > 1:
                continue
            hit = np.flatnonzero((x == a) & (y == b))
            p, q = (np.broadcast_to(k, bound.shape)[hit] for k in (i, j))
            left, ones_p = (self.half[a], self.half_ones) if a > b else (self.own[a], self.ones)
            right, ones_q = (self.half[b], self.half_ones) if b > a else (self.own[b], self.ones)
            both = np.bitwise_count(left[self.place[p]] & right[self.place[q]]).sum(1, dtype=np.int64)
            bound[hit] = np.minimum(n[p] - ones_p[p] + both, n[q] - ones_q[q] + both)
        return bound


class Made:
    """Sets of texts within a task; a digest that it has seen is named again, but not shown again."""

    def __init__(self, size: int) -> None:
        self.size, self.known, self.seen = size, Words(), set()

    def of(self, text: str | None) -> tuple[np.ndarray, int, int, bool]:
        if len(self.known) > WORDS:
            self.known.clear()
        if len(self.seen) > WORDS:
            self.seen.clear()
        own = shingles(text, self.size, self.known)
        digest = xxhash.xxh3_128_digest(own.tobytes())
        new = digest not in self.seen
        self.seen.add(digest)
        return own, *np.frombuffer(digest, np.int64).tolist(), new


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, made, total, shift = TaskContext.get().partitionId() << 33, Made(size), np.zeros(COUNTERS, np.int64), np.uint64(64 - COUNTERS.bit_length() + 1)
        for batch in slices(batches):
            out, fresh = [], []
            for doc, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, a, b, new = made.of(text)
                out.append((row, doc, len(own), a, b, text_hash, bitmap(own) if new else None, None, None))
                row += 1
                if new:
                    fresh.append(own >> shift)
            if fresh:
                total += np.bincount(np.concatenate(fresh).astype(np.int64), minlength=COUNTERS)
            yield table(SETS, [*map(list, zip(*out, strict=True))])
        if total.any():
            yield table(SETS, [*(pa.nulls(SLICES, f.type) for f in [*SETS][:7]), [*range(SLICES)], [x.tobytes() for x in np.split(total, SLICES)]])

    return run


def _arrays(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Made(size)
        for batch in slices(batches):
            out = [(a, b, own.tobytes()) for own, a, b, new in map(made.of, batch.column(1).to_pylist()) if new]
            if out:
                yield table(ARRAYS, [*map(list, zip(*out, strict=True))])

    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[at] = total.get(at, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["slice", "counts"])


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, where each row's begin and end) of rows of binary hashes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64), np.r_[0, np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // 8)]


def _frequencies(sets: DataFrame) -> np.ndarray:
    parts = sets.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_added, "slice int, counts binary")
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in parts.collect():  # COUNTERS numbers
        out[r.slice] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _keys(size: int, counts: np.ndarray, percent: int):
    """The first n - ceil(percent n / 100) + 1 shingles of each set, rare ones first."""
    order = np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)
    hot = counts > max(HOT_ROWS, HOT_MEAN * counts.mean())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, made = np.uint64(64 - COUNTERS.bit_length() + 1), Made(size)
        for batch in slices(batches):
            taken, sizes, names = [np.zeros(0, np.uint64)], [], []
            for own, a, _, new in map(made.of, batch.column(1).to_pylist()):
                if new and (n := len(own)):
                    p = n + 1 - -(-percent * n // 100)
                    taken.append(own[np.argsort(order[own >> shift], kind="stable")[:p]])  # hashes ascend already
                    sizes.append((n, p))
                    names.append(a)
            key = np.concatenate(taken)
            n, p = np.array(sizes, np.int64).reshape(-1, 2).T
            a = np.repeat(np.array(names, np.int64), p)
            salt = np.where(hot[key >> shift], 1 + (a.view(np.uint64) % np.uint64(SALT)).astype(np.int32), 0).astype(np.int32)
            yield table(KEYS, [key.view(np.int64), salt, np.repeat(n, p).astype(np.int32), a])

    return run


def _neighbours(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by (key, salt, n, a): those that have a neighbour of another set within the size band. Rows of a salted
    key stay all, as their neighbours may be elsewhere."""
    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(4)]
        key, salt, n, a = now if held is None else [np.r_[x, y] for x, y in zip(held[0], now, strict=True)]
        if not len(key):
            continue
        new = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1])]
        passed = held is not None and held[1]  # the held row has met its neighbour before
        key, salt, n, a = key[new], salt[new], n[new], a[new]
        near = (key[1:] == key[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
        keep = np.r_[False, near] | np.r_[near, False] | (salt > 0)
        keep[0] |= passed
        held = ([x[-1:] for x in (key, salt, n, a)], bool(keep[-1]))
        keep[-1] = False
        yield key[keep], salt[keep], n[keep].astype(np.int64), a[keep]
    if held is not None and held[1]:
        key, salt, n, a = held[0]
        yield key, salt, n.astype(np.int64), a


def _met(percent: int):
    """Pairs of keys that PAIRS sets have at most, rows of others. No more than PAIRS rows of a key are held."""

    def pairs(key: np.ndarray, n: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, PAIRS):
            i = np.flatnonzero((key[:-step] == key[step:]) & (100 * n[:-step] >= percent * n[step:])) if len(key) > step else np.zeros(0, np.int64)
            left.append(np.minimum(a[i], a[i + step]))
            right.append(np.maximum(a[i], a[i + step]))
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        return table(MET, [pa.nulls(len(both), pa.int64()), both[:, 0], both[:, 1]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for rows in _neighbours(batches, percent):
            key, salt, n, a = rows if held is None else [np.r_[x, y] for x, y in zip(held, rows, strict=True)]
            held = None
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            wide = (size > PAIRS) | (salt[starts] > 0)
            wide[0] |= key[0] == large
            large = key[-1] if wide[-1] else None
            if large is None:
                held = [x[starts[-1] :] for x in (key, salt, n, a)]
            over, last = np.repeat(wide, size), len(key) if large is not None else starts[-1]
            yield table(MET, [key[over], a[over], pa.nulls(int(over.sum()), pa.int64())])
            small = ~over[:last]
            yield pairs(key[:last][small], n[:last][small], a[:last][small])
        if held is not None:
            yield pairs(held[0], held[2], held[3])

    return run


def _blocks(rows: DataFrame, by: str, weight: Column, most: int, percent: int) -> DataFrame:
    """rows with i, j, side. Groups whose weights sum to `most` or less are block pair (0, 0), side 0. Larger ones are cut
    along their sizes n into blocks of about `most`; a row goes to every pair of blocks in which sizes are near enough."""
    large = cut(rows.groupBy(by).agg(F.sum(weight).alias("total")).where(F.col("total") > most).select(by))
    one = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    if large.isEmpty():
        return one
    hint = F.broadcast if large.count() <= BROADCAST_ROWS else lambda x: x
    wide = rows.join(hint(large), by, "left_semi")
    sizes = wide.groupBy(by, "n").agg(F.sum(weight).alias("w"))
    start = F.sum("w").over(Window.partitionBy(by).orderBy("n")) - F.col("w")
    sizes = sizes.select(by, "n", F.floor(start / most).cast("int").alias("first"), F.ceil(F.col("w") / most).cast("int").alias("span"))
    placed = cut(wide.join(sizes, [by, "n"]).withColumn("own", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("span"))).cast("int")).drop("first", "span"))
    held = cut(placed.groupBy(by, "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    x, y = held.select(by, F.col("own").alias("i"), F.col("hi").alias("i_hi"), F.col("lo").alias("i_lo")), held.select(by, F.col("own").alias("j"), F.col("lo").alias("j_lo"), F.col("hi").alias("j_hi"))
    pairs = x.join(y, by).where("i <= j").where((100 * F.col("i_hi") >= percent * F.col("j_lo")) & (100 * F.col("j_hi") >= percent * F.col("i_lo"))).select(by, "i", "j")
    ends = F.array(F.struct(F.col("i").alias("own"), F.lit(0).alias("side")), F.struct(F.col("j").alias("own"), F.lit(1).alias("side")))
    sided = pairs.select(by, "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.slice(ends, 1, 1)).otherwise(ends)).alias("e")).select(by, "i", "j", "e.own", "e.side")
    return one.join(hint(large), by, "left_anti").unionByName(placed.join(sided, [by, "own"]).drop("own"))


def _grouped(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    return rows.select(by, "i", "j", "side", "n", *names).repartition(partitions(rows.sparkSession), by, "i", "j").sortWithinPartitions(by, "i", "j", "side", "n", "node")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, by the first three columns, of sorted batches; small groups of a batch come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(i).to_numpy() for i in range(3)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in x])) + 1
        if held and any(h[0].as_py() != c[0] for h, c in zip(held[-1].slice(held[-1].num_rows - 1).columns[:3], x, strict=True)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])]).combine_chunks()
            held = []
            batch = batch.slice(new[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(group: pa.Table) -> np.ndarray:
    x = [group.column(i).to_numpy() for i in range(3)]
    return np.r_[np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in x])]), group.num_rows]


def _once(group: pa.Table) -> pa.Table:
    """Without a set that several tasks have made: it stands beside itself."""
    node, side = group.column("node").to_numpy(), group.column("side").to_numpy()
    new = np.r_[True, (node[1:] != node[:-1]) | (side[1:] != side[:-1])]
    new[_starts(group)[:-1]] = True
    return group if new.all() else group.filter(pa.array(new)).combine_chunks()


def allowed(n: np.ndarray, maps: Maps, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes and bitmaps of rows i and j leave room for a link."""
    return (100 + percent) * maps.most(n, i, j) >= percent * (n[i] + n[j])


class Forest:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _connect(rows: np.ndarray, n: np.ndarray, maps: Maps, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect all allowed pairs: what is connected already isn't compared again."""
    todo = rows
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            p = front.pop()
            lo, hi = np.searchsorted(n[todo], (-(-percent * n[p] // 100), 100 * n[p] // percent + 1))
            hit = lo + np.flatnonzero(allowed(n, maps, p, todo[lo:hi], percent))
            for q in todo[hit].tolist():
                yield int(p), q
            front += todo[hit].tolist()
            todo = np.delete(todo, hit)


def _checked_pairs(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.concatenate([batch.column(i).to_numpy() for i in (2, 3)]).astype(np.int64)
                maps = Maps([*batch.column(4).to_pylist(), *batch.column(5).to_pylist()])
                i = np.arange(batch.num_rows)
                fine = pa.array(allowed(n, maps, i, i + len(i), percent))
                kept = [batch.column(x).filter(fine) for x in (0, 1)]
                yield table(LINKS, [*kept, pa.nulls(len(kept[0]), pa.int64())])

    return run


def _candidates(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for group in _groups(batches):
            at, node, n = _starts(group), group.column("node").to_numpy(), group.column("n").to_numpy().astype(np.int64)
            maps = Maps(group.column("bits").to_pylist())
            size = np.diff(at)
            links: list[tuple[int, int]] = []
            small = np.repeat(size <= SMALL, size)
            number = np.repeat(np.arange(len(size)), size)
            i, step = np.flatnonzero(small), 1
            while len(i := i[i + step < len(n)]) and len(i := i[number[i] == number[i + step]]):
                links += [(int(x), int(x) + step) for x in i[(100 * n[i] >= percent * n[i + step]) & allowed(n, maps, i, i + step, percent)]]
                step += 1
            for g in np.flatnonzero(size > SMALL).tolist():
                rows = at[g] + np.argsort(n[at[g] : at[g + 1]], kind="stable")
                links += _connect(rows, n, maps, percent)
            found = [(int(node[x]), int(node[y])) for x, y in links if forest.join(int(node[x]), int(node[y]))]
            if found:
                yield table(LINKS, [*map(list, zip(*found, strict=True)), pa.nulls(len(found), pa.int64())])
            if len(forest.parent) > WORDS:
                forest = Forest()

    return run


def intersections(own: np.ndarray, flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one sorted array with those of other rows."""
    sizes = at[rows + 1] - at[rows]
    ends = np.cumsum(sizes)
    if len(rows) == rows[-1] - rows[0] + 1:
        others = flat[at[rows[0]] : at[rows[-1] + 1]]
    else:
        others = flat[np.arange(ends[-1]) + np.repeat(at[rows] - (ends - sizes), sizes)]
    place = np.searchsorted(own, others)
    place[place == len(own)] = 0
    return np.diff(np.r_[0, np.cumsum(own[place] == others)[ends - 1]])


def _exact(percent: int, count: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in map(_once, _groups(batches)):
            at, node, n = _starts(group), group.column("node").to_numpy(), group.column("n").to_numpy().astype(np.int64)
            side, copies = group.column("side").to_numpy(), group.column("copies").to_numpy()
            flat, where = _flat(group.column("shingles"))
            maps = Maps([bitmap(flat[x:y]) for x, y in zip(where.tolist(), where[1:].tolist(), strict=False)])
            links, found = np.zeros(len(n), np.int64), []
            for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False):
                forest, label, middle = Forest(), np.arange(hi),  lo + int(np.searchsorted(side[lo:hi], 1))  # both sides stand by size
                for i in range(lo, middle if middle < hi else hi):
                    first = middle if middle < hi else i + 1
                    x, y = first + np.searchsorted(n[first:hi], (-(-percent * n[i] // 100), 100 * n[i] // percent + 1))
                    js = np.arange(x, y)
                    js = js if count else js[label[js] != label[i]]
                    js = js[allowed(n, maps, i, js, percent)]
                    if not len(js):
                        continue
                    common = intersections(flat[where[i] : where[i + 1]], flat, where, js)
                    js = js[100 * common >= percent * (n[i] + n[js] - common)]
                    links[i] += copies[js].sum()
                    links[js] += copies[i]
                    for j in js.tolist():
                        if forest.join(i, j):
                            found.append((int(node[i]), int(node[j])))
                            if not count:
                                label[lo:][label[lo:] == label[j]] = label[i]
            held = np.flatnonzero(links)
            yield table(LINKS, [[*(a for a, _ in found), *node[held].tolist()], [*(b for _, b in found), *[None] * len(held)], [*[None] * len(found), *links[held].tolist()]])

    return run


def small(df: DataFrame) -> DataFrame:
    """To be broadcast, where it is a table of BROADCAST_ROWS rows or fewer."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def exact(rows: DataFrame, by: str, percent: int, count: bool = True) -> DataFrame:
    """rows (by, node, n, copies, shingles): links (a, b) that connect all rows of one group that link, and, if they are counted,
    rows (a, null, links) of how many each links with, block by block. Not counted, what is connected isn't compared again."""
    return _grouped(_blocks(rows, by, F.col("n"), BLOCK_SHINGLES, percent), by, ["node", "copies", "shingles"]).mapInArrow(_exact(percent, count), LINKS_SQL)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs, null and repeated ids included.

    A row's set: distinct shingles of `size` words, ASCII capitals lower-cased; of fewer words the whole sequence; of none,
    or of a null text, no shingle, and no link. Rows link where 100 * intersection >= percent * union. component_id is the
    smallest id reachable, null where no row of the group has one, and a row's own id where it has no link. n_links is the
    number of other rows that it links with; rows of one text link with each other, whatever their ids. No pair is left out.
    An empty table gives no row. Counting links of a group takes time with the square of its number of different sets.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    folder = shared_folder(spark, "sets")
    texts.mapInArrow(_sets(size), SETS_SQL).write.parquet(folder)
    sets = spark.read.schema(SETS_SQL).parquet(folder)
    rows = sets.where("slice is null")
    first = lambda c: F.min_by(c, "row").alias(c)
    named = cut(rows.where("n > 0").groupBy("a", "b").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), first("text_hash"), first("bits")))
    keys = texts.mapInArrow(_keys(size, _frequencies(sets), percent), KEYS_SQL)
    met = cut(keys.repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "n", "a").mapInArrow(_met(percent), MET_SQL))
    side = lambda x: named.select(F.col("a").alias(x), F.col("node").alias(f"{x}_node"), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    pairs = met.where("b is not null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    near = pairs.select("a_node", "b_node", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(_checked_pairs(percent), LINKS_SQL)
    tiles = met.where("b is null").select("key", "a").join(named.select("a", "node", "n", "bits"), "a").drop("a")
    walked = _grouped(_blocks(tiles, "key", F.lit(1), BLOCK_ROWS, percent), "key", ["node", "bits"]).mapInArrow(_candidates(percent), LINKS_SQL)
    groups = components(near.unionByName(walked).select("a", "b").distinct())
    met = cut(groups.join(named.drop("bits", "first"), "node"))
    wanted = texts.join(small(met.select("text_hash").distinct()), "text_hash", "left_semi").select("doc_id", "text")
    arrays = wanted.mapInArrow(_arrays(size), "a long, b long, shingles binary").join(small(met.drop("text_hash")), ["a", "b"])
    found = cut(exact(arrays, "component", percent))
    counts = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links is null").select("a", "b"))
    rooted = cut(named.drop("bits", "text_hash").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).join(counts, "node", "left"))
    smallest = rooted.where("component is not null").groupBy("root").agg(F.min("first").alias("least"))
    result = rooted.join(smallest, "root", "left").select("a", "b", F.coalesce("least", "first").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies", F.col("component").isNotNull().alias("joined"))
    result = result.where("joined or copies > 1").drop("joined")
    own = attach(rows.select("doc_id", "n", "a", "b"), result, ["a", "b"], "copies")
    alone = F.col("n_links").isNull()
    return own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
