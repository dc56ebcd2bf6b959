"""Line dedup: hashes are range-partitioned with a secondary sort by document and position, a stream finds the copies to
drop, and documents get compressed keep bitmaps instead of text.

The range covers (hash, document, position), so the rows of a very common line spread over many partitions. What such
a line needs to know beyond one partition (its largest document, its number of documents) comes from one small record
for each partition. Within a partition a task holds one batch, and of the hash that is still open its state and those
rows that can't be decided yet: the lines of fewer than `min_docs` documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.llm.common import ASCII_LOWER, ASCII_SPACE, cut, id_and_text, partitions, slices, table

LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])
DROPS = pa.schema([("doc_id", pa.int64()), ("text_crc", pa.int64()), ("line", pa.int32())])
EDGES = pa.schema([("part", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_docs", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])
BITMAPS = pa.schema([("doc_id", pa.int64()), ("text_crc", pa.int64()), ("n_dropped", pa.int64()), ("keep_bitmap", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("keep_bits", pa.string())])


def line_rows(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, docs, ats = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is None or text is None:
                    continue
                raw = text.encode()
                high = zlib.crc32(raw) << 31
                for i, line in enumerate(raw.translate(ASCII_LOWER).split(b"\n")):
                    key = line.strip(ASCII_SPACE)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        ats.append(high | i)
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield table(LINES, [np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]), docs, ats])

    return run


class Open(NamedTuple):
    """The hash whose rows go on in the next batch: its largest and its last document so far, and how many documents."""

    h1: int
    h2: int
    first_doc: int
    last_doc: int
    n_docs: int


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Batch by batch: its columns, where each hash's rows begin, documents of each hash so far, its largest document, and
    whether its rows go on from the batch before."""
    held: Open | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, at = (batch.column(i).to_numpy() for i in range(4))
        new_hash = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_hash | np.r_[True, doc[1:] != doc[:-1]]
        starts = np.flatnonzero(new_hash)
        n_docs, first = np.add.reduceat(new_doc.astype(np.int64), starts), doc[starts].copy()
        goes_on = held is not None and (held.h1, held.h2) == (h1[0], h2[0])
        if goes_on:
            n_docs[0] += held.n_docs - (held.last_doc == doc[0])
            first[0] = held.first_doc
        held = Open(h1[-1], h2[-1], first[-1], doc[-1], n_docs[-1])
        yield h1, h2, doc, at, starts, n_docs, first, goes_on


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's first hash and its last one."""
    from pyspark import TaskContext

    opens: list | None = None
    last, many = None, False
    for h1, h2, doc, _, starts, n_docs, first, goes_on in _runs(batches):
        ends = np.r_[starts[1:], len(doc)] - 1
        rows = [[int(x[k]) for x in (h1[starts], h2[starts], n_docs, first, doc[ends])] for k in (0, -1)]
        if opens is None or (goes_on and not many):
            opens = rows[0]
        many |= len(starts) > 1 or (last is not None and not goes_on)
        last = rows[1]
    if opens is not None:
        found = [opens, last] if many else [opens]
        yield table(EDGES, [[TaskContext.get().partitionId()] * len(found), *map(list, zip(*found, strict=True))])


def merge_edges(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(documents, largest document) of each hash that opens or ends a partition. At most two rows a partition."""
    out: dict[tuple[int, int], list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.part, r.h1, r.h2)):
        key = (r.h1, r.h2)
        if key not in out:
            out[key] = [r.n_docs, r.first_doc, r.last_doc]
        else:
            held = out[key]
            held[0] += r.n_docs - (held[2] == r.first_doc)
            held[2] = r.last_doc
    return {k: (n, first) for k, (n, first, _) in out.items()}


def _drops(known: dict[tuple[int, int], tuple[int, int]], min_docs: int):
    """Rows of a hash that is in enough documents go, but those of its largest. What is known of the hashes that open or
    end a partition holds for all partitions; other hashes are decided as their rows come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the open hash, not yet in enough documents
        for h1, h2, doc, at, starts, n_docs, first, goes_on in _runs(batches):
            for k in {0, len(starts) - 1}:
                if (edge := known.get((int(h1[starts[k]]), int(h2[starts[k]])))) is not None:
                    n_docs[k], first[k] = edge
            size = np.diff(np.r_[starts, len(doc)])
            gone = np.repeat(n_docs >= min_docs, size) & (doc != np.repeat(first, size))
            docs, ats = [doc[gone]], [at[gone]]
            if goes_on and n_docs[0] >= min_docs:
                docs += [d[d != first[0]] for d, _ in waiting]
                ats += [a[d != first[0]] for d, a in waiting]
            if not (goes_on and len(starts) == 1 and n_docs[0] < min_docs):
                waiting = []
            if n_docs[-1] < min_docs:
                waiting.append((doc[starts[-1] :], at[starts[-1] :]))
            where = np.concatenate(ats)
            yield table(DROPS, [np.concatenate(docs), where >> 31, (where & 0x7FFFFFFF).astype(np.int32)])

    return run


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, n = [], []
        for lines in batch.column(2):
            at = lines.values.to_numpy()
            bits = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)  # whole bytes, so that padding keeps
            bits[at] = 0
            n.append(len(bits) - int(bits.sum()))
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield table(BITMAPS, [batch.column(0), batch.column(1), n, maps])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row (doc_id, text_crc, n_dropped, keep_bitmap) for each document that loses a line.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of `min_chars` code points in
    `min_docs` documents lose all lines but those of the largest id. The bitmap (zlib over packed bits, 1 = keep)
    reaches to the last dropped line; lines after it stay. Rows with a null id or text lose nothing and count for
    nothing. Rows with one id count as one document; where their texts differ, each text has its own bitmap. Repeated rows
    share one. An empty table gives no row.
    """
    n = partitions(docs.sparkSession)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("at")]
    rows = id_and_text(docs, id_col, text_col).mapInArrow(line_rows(min_chars), "h1 long, h2 long, doc_id long, at long")
    # hashes are cut before the exchange as well: its sampling would else read and hash the texts once more
    rows = cut(cut(rows).repartitionByRange(n, *order).sortWithinPartitions(*order))
    known = merge_edges(rows.mapInArrow(_edges, "part long, h1 long, h2 long, n_docs long, first_doc long, last_doc long").collect())
    drops = rows.mapInArrow(_drops(known, min_docs), "doc_id long, text_crc long, line int")
    return drops.groupBy("doc_id", "text_crc").agg(F.collect_list("line").alias("lines")).mapInArrow(_bitmaps, "doc_id long, text_crc long, n_dropped long, keep_bitmap binary")


def keep_bits(bitmap: bytes | None, n: int) -> str:
    """A 1 or 0 for each of n lines."""
    if bitmap is None:
        return "1" * n
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
    return (bits + ord("0")).tobytes().decode().ljust(n, "1")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, len(lines)
    return [x for x, b in zip(lines, keep_bits(bitmap, len(lines)), strict=True) if b == "1"], len(lines)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "keep_bitmap", **kw) -> DataFrame:
    """docs with the column `into`, null where nothing goes; a column of docs that is named like it isn't taken over. Every
    row of docs stays; only compressed bitmaps are built into hash tables. Null ids meet no bitmap, they go by their texts'
    checksums, so that they spread."""
    key, known = ["__id", "__crc", "__known"], F.col(id_col).isNotNull()
    maps = keep_bitmaps(docs, id_col, text_col, **kw).select(F.col("doc_id").alias("__id"), F.col("text_crc").alias("__crc"), F.lit(True).alias("__known"), F.col("keep_bitmap").alias(into))
    left = docs.drop(into).withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "__crc": F.crc32(F.col(text_col).cast("binary")), "__known": known})
    return left.join(maps.hint("shuffle_hash"), key, "left").drop(*key)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, n = kept_lines(text, bitmap)
            rows.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), keep_bits(bitmap, n)))
        yield table(RESULT, [batch.column(0), *map(list, zip(*rows, strict=True))])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_bits: the bitmap read back, a 1 or 0 for each line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_bitmaps(id_and_text(docs, "doc_id", "text"))
    return found.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bits string")


#: The same by hash aggregation, over all lines.
OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), dup AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.i, k.line, d.key IS NOT NULL AND k.doc_id <> d.last AS gone FROM keyed k LEFT JOIN dup d ON k.key = d.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256,
  string_agg(CASE WHEN gone THEN '0' ELSE '1' END, '' ORDER BY i) AS keep_bits
FROM marked GROUP BY doc_id
"""
