"""Near copies by word shingles, found by SimHash fingerprints over several tables.

One fingerprint within three bits finds few of the pairs that share four fifths of their shingles of five words. So a text has
`tables` fingerprints, of its distinct words under as many hashes; each table is matched by the deletion-variant index of
`simhash.links`, and what the tables connect are candidates, whose shingles are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm import jaccard
from eligo.llm.common import attach, cut, slices, table
from eligo.llm.simhash import bits_of, components, links

#: Tables that are matched at once: more of them take fewer Spark jobs, and with them less of the driver's memory, but more disk.
TABLES_AT_ONCE = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A row's key, its set's name and size, and the set where a task shows it first.
SETS_SQL = "k_a long, k_b long, component long, node long, n int, shingles binary"
SETS = pa.schema([("k_a", pa.int64()), ("k_b", pa.int64()), ("component", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary())])


def word_fingerprints(text: str | None, tables: int, known: dict) -> list[int]:
    """Signed fingerprints of a text's distinct words, one for each table; zeros where there is no word."""
    words = {*jaccard.words_of(text)}
    if not words:
        return [0] * tables
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return [int(np.uint64(bits_of(jaccard.mix(own + np.uint64(t) * _STEP))).view(np.int64)) for t in range(tables)]


def _prints(tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = jaccard.Words()
        for batch in slices(batches):
            prints = [word_fingerprints(t, tables, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(prints, pa.list_(pa.int64()))], names=["k_a", "k_b", "prints"])
            if len(known) > jaccard.WORDS:
                known.clear()

    return run


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = jaccard.Made(size)
        for batch in slices(batches):
            out = []
            for text, a, b, component in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, node, _, new = made.of(text)
                out.append((a, b, component, node, len(own), own.tobytes() if new else None))
            yield table(SETS, [*map(list, zip(*out, strict=True))])

    return run


def verified_groups(docs: DataFrame, key: tuple[str, str], text_col: str = "text", size: int = 5, percent: int = 80, tables: int = 8, distance: int = 3) -> DataFrame:
    """(k_a, k_b, root) for each row of docs, named by its two key columns (longs; equal rows may share them): rows of one root
    are connected by pairs that share `percent` of a hundred of the union of their shingles. Rows without a word, null texts
    included, are one group. Candidates beyond `distance` bits in every table are missed; the README has the recall."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(key[0]).alias("k_a"), F.col(key[1]).alias("k_b"))
    prints = cut(rows.mapInArrow(_prints(tables), "k_a long, k_b long, prints array<long>").withColumn("node", F.xxhash64("prints")))
    nodes = cut(prints.groupBy("node").agg(F.min("prints").alias("prints"), F.count("*").alias("n")))
    own = nodes.select("node", F.posexplode("prints").alias("table", "fp"))
    first = cut(own.groupBy("table", "fp").agg(F.min("node").alias("first")))
    found = None
    for low in range(0, tables, TABLES_AT_ONCE):
        some = links(first.where(F.col("table").between(low, low + TABLES_AT_ONCE - 1)).select("table", "fp"), distance)
        found = some if found is None else found.unionByName(some)
    of = lambda c: first.select("table", F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    across = found.join(of("a"), ["table", "a"]).join(of("b"), ["table", "b"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    edges = across.unionByName(own.join(first, ["table", "fp"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    grouped = components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    candidate = cut(nodes.select("node", "n").join(grouped, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component")))
    sizes = candidate.groupBy("component").agg(F.sum("n").alias("size"))
    candidate = cut(candidate.join(sizes, "component").select("node", "n", "component", (F.col("size") > 1).alias("shared")))
    placed = cut(attach(prints.select("k_a", "k_b", "node"), candidate, ["node"], "n"))
    wanted = placed.where("shared").select("k_a", "k_b", "component").distinct()
    alone = placed.where("not shared").select("k_a", "k_b", F.col("component").alias("root"))
    sets = cut(rows.join(wanted, ["k_a", "k_b"]).select("text", "k_a", "k_b", "component").mapInArrow(_sets(size), SETS_SQL))
    arrays = sets.where("shingles is not null and n > 0").select("component", "node", "n", F.lit(1).cast("long").alias("copies"), "shingles")
    found = cut(jaccard.exact(arrays, "component", percent, count=False))
    roots = components(found.select("a", "b"))
    named = sets.select("k_a", "k_b", "node").distinct().join(jaccard.small(roots), "node", "left").select("k_a", "k_b", F.coalesce("component", "node").alias("root"))
    return named.unionByName(alone).distinct()
