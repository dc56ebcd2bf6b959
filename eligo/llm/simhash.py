"""SimHash near-dedup by deletion variants: a 64-bit fingerprint is cut into so few segments that, within the distance,
one segment differs by at most one bit. Variants of the segments with one bit masked are the keys of an equality match,
and candidates are verified on all bits.

Only distinct fingerprints are matched, so copies cost nothing. A bucket over BUCKET rows goes on by the bits outside of its
segment: cut into one block more than bits may differ, one of the blocks must be equal. So it is dealt out by its blocks'
values, twice at most, and what is still over BUCKET then by pairs of salted blocks; no task holds an unbounded bucket.
Links leave a bucket as a spanning forest, not as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eligo.llm.common import ASCII_LOWER, attach, cut, partitions, slices, table, written_tables

#: A link (a, b) of a table, or a row of a bucket that is too large: its next key, and the bits in which its rows may still differ.
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("free", pa.int64()), ("table", pa.int32())])
LINKS_SQL = "a long, b long, key long, free long, table int"
#: Times that a large bucket is dealt out by the values of its blocks.
LEVELS = 2
#: Rows that a bucket compares at once.
BUCKET = 256
#: Bits of each byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words_per_shingle: int, seed: int = 42) -> int:
    """Unsigned SimHash of a text's word shingles by XXH64; zero where there is no word."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(words_per_shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[k:], strict=False)), np.uint64, len(words) - k + 1)
    return bits_of(hashes)


def bits_of(hashes: np.ndarray) -> int:
    """A bit is 1 where it is set in over half of the hashes."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _prints(words_per_shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, words_per_shingle) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) for each row, and its columns `keep`; fp is the unsigned fingerprint held in a signed long. Null and
    wordless texts get 0."""
    picked = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *keep)
    return picked.mapInArrow(_prints(words_per_shingle), StructType([StructField("fp", LongType()), *picked.schema.fields[1:]]))


def forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of the links that join something new."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    keep = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def near(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with equal keys and fingerprints within the distance; keys are sorted."""
    left, right = [], []
    step, at = 1, np.arange(len(key) - 1)
    while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
        hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        left.append(hit)
        right.append(hit + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One key of several; where two get the same by chance, candidates come together in vain, as all bits are verified."""
    out = np.zeros(len(parts[-1]), np.uint64)
    for part in parts:
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def blocks_of(free: int, n: int) -> list[int]:
    """The bits of `free` in n masks of about equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _found(a: np.ndarray, b: np.ndarray, of: np.ndarray, of_b: np.ndarray) -> pa.RecordBatch:
    """A forest of the links of each table; what a chance equality of keys brings together from two tables is none."""
    keep = [own[forest(a[own], b[own])] for t in np.unique(of).tolist() if len(own := np.flatnonzero((of == t) & (of_b == t)))]
    at = np.concatenate(keep) if keep else np.zeros(0, int)
    none = pa.nulls(len(at), pa.int64())
    return table(LINKS, [np.minimum(a[at], b[at]), np.maximum(a[at], b[at]), none, none, of[at]])


def _deal(key: np.ndarray, fp: np.ndarray, free: np.ndarray, of: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets under the value of each block of their free bits."""
    fps = fp.view(np.uint64)
    for mask in np.unique(free).tolist():
        own = free == mask
        for k, block in enumerate(blocks_of(mask & (1 << 64) - 1, distance + 1)):
            value = fps[own] & np.uint64(block)
            next_key = _mixed(key[own], np.full(len(value), k), value).view(np.int64)
            yield table(LINKS, [fp[own], pa.nulls(len(value), pa.int64()), next_key, np.full(len(value), _signed(mask & (1 << 64) - 1 & ~block)), of[own]])


def _first_variant(differ: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Of the variants under which two fingerprints meet, the first; `differ` has their differing bits."""
    first = np.full(len(differ), 64)
    for low, high in reversed([*zip(cuts, cuts[1:], strict=False)]):
        own = differ >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        bit = np.where(own == 0, 0, np.bitwise_count(own - np.uint64(1)))
        first = np.where(np.bitwise_count(own) <= 1, low + bit, first)
    return first


def _links(distance: int, deal: bool, cuts: list[int] | None = None):
    """cuts: keys are those of `_variant`, and a pair is a link under the first variant under which it meets; if that one's
    bucket is large, its rows go on and meet there."""

    def found(key, fp, of):
        fps = fp.view(np.uint64)
        i, j = near(key, fps, distance)
        if cuts:
            here = (key[i] >> 40 & 63) == _first_variant(fps[i] ^ fps[j], cuts)
            i, j = i[here], j[here]
        return _found(fp[i], fp[j], of[i], of[j])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key. Links of buckets of up to BUCKET rows; the rows of larger ones go on."""
        held, large = None, None
        for batch in batches:
            key, fp, free, of = (batch.column(i).to_numpy() for i in range(4))
            if held is not None:
                key, fp, free, of = (np.concatenate(x) for x in zip(held, (key, fp, free, of), strict=True))
            if not len(key):
                continue
            size = np.diff(np.r_[starts := np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
            over = size > BUCKET
            over[0] |= large is not None and key[0] == large
            large = key[-1] if over[-1] else None
            wide = np.repeat(over, size)
            if wide.any() and deal:
                yield from _deal(key[wide], fp[wide], free[wide], of[wide], distance)
            elif wide.any():
                yield table(LINKS, [fp[wide], pa.nulls(int(wide.sum()), pa.int64()), key[wide], free[wide], of[wide]])
            tail = starts[-1] if not over[-1] else len(key)
            small = ~wide[:tail]
            yield found(key[:tail][small], fp[:tail][small], of[:tail][small])
            held = (key[tail:], fp[tail:], free[tail:], of[tail:])
        if held is not None:
            yield found(held[0], held[1], held[3])

    return run


def _block_links(distance: int):
    """Rows of one bucket and one pair of blocks come together; they are few, as blocks are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            own, of = np.array([r[3] for r in held], np.int64), np.array([r[4] for r in held], np.int32)
            fp = own.view(np.uint64)
            i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance, 1))
            return _found(own[i], own[j], of[i], of[j])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return run


def links(prints: DataFrame, distance: int = 3, levels: int = LEVELS) -> DataFrame:
    """Links (table, a < b) between fingerprints: prints has one row (fp) for each distinct one, or (table, fp) for each of
    several tables, numbered below 2^16, that are matched at once, each by itself. Every pair of a table within the distance is
    connected by its links, each of which joins two fingerprints within the distance."""
    segments = distance // 2 + 1  # one of them then differs by at most one bit
    cuts = [64 * i // segments for i in range(segments + 1)]
    tagged = prints if "table" in prints.columns else prints.withColumn("table", F.lit(0))
    rows = tagged.select(F.col("table").cast("int").alias("table"), "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    n = partitions(prints.sparkSession)
    key, free = _variant(cuts)
    # a row is sent with the number of its variant alone, which says the rest
    wide, small = rows.repartition(n, key).select(key.alias("key"), "fp", free.alias("free"), "table"), None
    for level in range(levels + 1):
        met = cut(wide.sortWithinPartitions("key").mapInArrow(_links(distance, level < levels, cuts if level == 0 and segments > 1 else None), LINKS_SQL))
        own = met.where("key is null").select("table", "a", "b")
        small = own if small is None else small.unionByName(own)
        wide = met.where("key is not null").select("key", F.col("a").alias("fp"), "free", "table")
        if wide.isEmpty():
            return small.distinct()
        if level < levels:
            wide = wide.repartition(n, "key")
    sizes = wide.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BUCKET)).cast("int").alias("n"))
    blocks = wide.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")).cast("int"))
    pairs = blocks.select("key", "fp", "table", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", "table")
    dealt = pairs.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return small.unionByName(dealt.mapInArrow(_block_links(distance), LINKS_SQL).select("table", "a", "b")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variant(cuts: list[int]) -> tuple[Column, Column]:
    """The key of the variant with bit `bit` masked, and the bits that its key leaves free. The masked segment leaves its
    other bits free: they take the numbers of the variant and of the table, exact for segments of up to 40 bits."""
    masked = F.expr("fp & ~shiftleft(1L, bit)")
    segment, free = F.lit(None).cast("long"), F.lit(None).cast("long")
    for low, high in zip(cuts, cuts[1:], strict=False):
        mask, inside = (1 << (high - low)) - 1 << low, F.col("bit").between(low, high - 1)
        segment = F.when(inside, F.shiftrightunsigned(masked.bitwiseAND(F.lit(_signed(mask))), low)).otherwise(segment)
        free = F.when(inside, F.lit(_signed(~mask & (1 << 64) - 1))).otherwise(free)
    if len(cuts) == 2:
        return F.xxhash64("table", "bit", segment), free
    return F.expr("shiftleft(cast(table AS long), 48) | shiftleft(cast(bit AS long), 40)").bitwiseOR(segment), free


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with an edge, by contraction: nodes point to their
    smallest neighbour, pointers are followed to the root, edges within a tree vanish. All of it are joins and partial aggregates."""
    with written_tables(edges.sparkSession) as write:
        edges = write(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
        roots = None
        while not edges.isEmpty():
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            point = write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"))
            up = lambda p: p.select(F.col("node").alias("to"), F.col("to").alias("top"))
            while True:  # the way to a root halves each time, so long chains cost the logarithm of their length
                for _ in range(3):
                    point = point.join(up(point), "to").select("node", F.col("top").alias("to"))
                point = write(point)
                if point.join(up(point), "to").where("to <> top").isEmpty():
                    break
            a, b = point.select(F.col("node").alias("a"), F.col("to").alias("x")), point.select(F.col("node").alias("b"), F.col("to").alias("y"))
            edges = write(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
            if roots is None:
                roots = point.select("node", F.col("to").alias("component"))
            else:
                above = point.select(F.col("node").alias("component"), F.col("to").alias("top"))
                roots = roots.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            roots = write(roots)
        return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, distance: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row of docs, null and repeated ids included, and its columns `keep`.

    component_id is the smallest id reachable over fingerprints that differ in `distance` bits or fewer, null where no row
    of the group has one; root, one of the group's fingerprints, names the group always. Empty and null texts have
    fingerprint 0. Rows of one id that differ in text go by their texts. An empty table gives no row.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words_per_shingle, keep))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    nodes = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select("fp", "component_id", "root", "n"))
    return attach(prints, named, ["fp"], "n").select("doc_id", "fp", "component_id", "root", *keep)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs, words_per_shingle=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
