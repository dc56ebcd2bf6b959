"""Best-fit packing by length histogram: the plan is made over counts of lengths, whatever the number of documents, and
documents take the planned slots by their rank within their length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eligo.llm.common import cut, id_and_text, slices, table
from eligo.llm.tokens import WordEncoder, vocabulary

END_ID = 1
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
RESULT = pa.schema([*[PIECES.field(i) for i in range(5)], ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Slots(NamedTuple):
    """Ranks [rank, rank + bins * each) of a length go to sequences from `sequence` on, `each` to a sequence, from `offset` on."""

    length: int
    rank: int
    bins: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Slots]:
    """Best fit, longest first, over counts. Sequences with equal room are one group, so the work depends on the number
    of lengths (`capacity` at most), not on the number of documents."""
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out, used, shortest = [], 0, min(counts, default=0)

    def put(left: int, first: int, n: int) -> None:
        if n and left >= shortest:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            if (i := bisect_left(rooms, length)) < len(rooms):
                left = rooms[i]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[i]
            else:
                left = capacity
                first, n = used, -(-todo // (capacity // length))
                used += n
            each = min(left // length, todo)
            bins = min(n, todo // each)
            out.append(Slots(length, rank, bins, each, first, capacity - left))
            put(left - each * length, first, bins)
            put(left, first + bins, n - bins)
            rank += bins * each
            todo -= bins * each
    return out


def _pieces(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces with their rank within their length so far in this partition."""
        from pyspark import TaskContext

        encoder, part, seen = WordEncoder.of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, limit=2_000_000):
            ids, ends = encoder.encode_column(batch.column(1))
            docs, pieces, starts, lengths, crcs = [], [], [], [], []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(END_ID))
                for k, at in enumerate(range(0, len(own), capacity)):
                    docs.append(doc)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(min(capacity, len(own) - at))
                    crcs.append(zlib.crc32(own[at : at + capacity]))
            length = np.array(lengths, np.int64)
            order = np.argsort(length, kind="stable")
            first = np.r_[True, length[order][1:] != length[order][:-1]]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.maximum.accumulate(np.where(first, np.arange(len(length)), 0))
            rank += seen[length]
            np.add.at(seen, length, 1)
            yield table(PIECES, [docs, pieces, starts, length, crcs, np.full(len(length), part, np.int32), rank])

    return run


def _slots(slots: list[Slots]):
    arrays = [np.array(x, np.int64) for x in zip(*slots, strict=True)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, each, sequence, offset = arrays
        order = np.lexsort((rank, length))
        starts = (length[order] << 44) + rank[order]
        for batch in batches:
            got, own = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = order[np.searchsorted(starts, (got << 44) + own, "right") - 1]
            nth = own - rank[i]
            yield table(RESULT, [*batch.columns[:5], sequence[i] + nth // each[i], offset[i] + nth % each[i] * got])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    A document is its ids and END_ID, so null and empty texts are one id. Only documents over `capacity` are cut. Ranks
    are counted within input partitions and shifted by what earlier partitions hold of a length: no group of a length is
    ever collected. The histogram, `capacity` rows at most, is all that the driver sees. An empty table packs to no row.
    """
    rows = id_and_text(docs, id_col, text_col).mapInArrow(_pieces(path or vocabulary(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")
    rows = cut(rows)
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("shift"))
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = rows.join(shift, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return placed.mapInArrow(_slots(plan(histogram, capacity)), schema) if histogram else placed.selectExpr(*[f"{c} AS {c}" for c in ("doc_id", "piece", "start", "length", "ids_crc32")], "rank AS sequence_id", "rank AS offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
