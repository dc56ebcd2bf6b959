"""Token-id files: each document is a zstandard frame of its own under a dictionary trained on serialized id arrays.

A shard is one binary value in a Parquet table that Spark writes, so it lands in any store that Spark reaches:

    magic "EID1" | 16 bytes hash of the dictionary | documents: uint32 | tokens before the shard in its part: uint64
    | index: doc_id int64 (null: flag byte), ids uint32, frame length uint32 | frames

A frame is a byte for the width of an id (2 or 4), then the compressed little-endian ids. The table `meta` holds the
dictionary. Parts are ranges of ids in ascending order, shards within a part are numbered, and the index gives a short
document without decompressing its neighbours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.llm.common import id_and_text, partitions, shared_folder, slices, small_batches, table
from eligo.llm.tokens import WordEncoder, vocabulary

END_ID = 1
MAGIC = b"EID1"
HEAD = "<4s16sIQ"
HEAD_SIZE = struct.calcsize(HEAD)
ENTRY = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("ids", "<u4"), ("size", "<u4")])
#: Bytes of frames after which a shard is closed.
SHARD_BYTES = 4_000_000
SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])
SHARDS_SQL = "part int, shard int, first_id long, last_id long, n_docs long, n_tokens long, blob binary"


def dictionary_hash(dictionary: bytes) -> bytes:
    return xxhash.xxh3_128_digest(dictionary)


def _pack_ids(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4").tobytes()


class Frames:
    def __init__(self, dictionary: bytes):
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.hash = dictionary_hash(dictionary)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=False).compress
        self.decompress = zstandard.ZstdDecompressor(dict_data=own).decompress

    def frame(self, ids: np.ndarray) -> bytes:
        raw = _pack_ids(ids)
        return bytes([2 if len(raw) == 2 * len(ids) else 4]) + self.compress(raw)

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompress(frame[1:]), f"<u{frame[0]}").astype("<u4")


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = 2_000, sample_ids: int = 4_096, size: int = 65_536) -> bytes:
    """From the documents with the smallest hashes of their ids, `sample_docs` at most, the first `sample_ids` ids of each.
    The sample only sets the dictionary; every text is written whole. Empty where there is too little to train on."""
    chosen = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    encoder = WordEncoder.of(path)
    samples = [_pack_ids(encoder.encode(r.text)[:sample_ids]) for r in docs.where(F.col("doc_id").isin(chosen)).select(F.substring("text", 1, 8 * sample_ids).alias("text")).limit(2 * sample_docs).toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _write(path: str, dictionary: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, frames, part = WordEncoder.of(path), Frames(dictionary), TaskContext.get().partitionId()
        shard = before = 0
        index, bodies, held = [], [], 0

        def close():
            nonlocal shard, before, index, bodies, held
            entries = np.array(index, ENTRY)
            n = int(entries["ids"].astype(np.int64).sum())
            blob = struct.pack(HEAD, MAGIC, frames.hash, len(index), before) + entries.tobytes() + b"".join(bodies)
            known = [int(x) for x in entries["doc_id"][entries["null"] == 0][[0, -1]]] if not entries["null"].all() else [None, None]
            out = table(SHARDS, [[part], [shard], [known[0]], [known[1]], [len(index)], [n], [blob]])
            shard, before, index, bodies, held = shard + 1, before + n, [], [], 0
            return out

        for batch in slices(batches, limit=2_000_000):
            ids, ends = encoder.encode_column(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                body = frames.frame(np.append(ids[ends[i] : ends[i + 1]], np.uint32(END_ID)))
                index.append((doc is None, doc or 0, ends[i + 1] - ends[i] + 1, len(body)))
                bodies.append(body)
                held += len(body)
                if held >= SHARD_BYTES:
                    yield close()
        if index:
            yield close()

    return run


def write_token_files(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> None:
    """Write the ids of all texts, END_ID after each, in ascending order of ids (null ids first, equal ids by their texts'
    hashes, so that rows of one id spread over parts).

    Null texts are empty, repeated rows are documents of their own, and an empty table gives files without a shard.
    """
    path = path or vocabulary()
    rows = id_and_text(docs, id_col, text_col)
    dictionary = train_dictionary(rows, path)
    order = ["doc_id", "text_hash"]
    ordered = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    with small_batches(docs.sparkSession):
        ordered.select("doc_id", "text").mapInArrow(_write(path, dictionary), SHARDS_SQL).write.parquet(f"{to}/shards")
    docs.sparkSession.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{to}/meta")


def entries_of(blob: bytes, frames: Frames) -> tuple[np.ndarray, np.ndarray, int]:
    """The index, where each frame begins, and the ids before the shard in its part."""
    magic, own, n, before = struct.unpack_from(HEAD, blob)
    if magic != MAGIC or own != frames.hash:
        raise ValueError("not a shard of this dictionary")
    index = np.frombuffer(blob, ENTRY, n, HEAD_SIZE)
    sizes = index["size"].astype(np.int64)
    return index, HEAD_SIZE + n * ENTRY.itemsize + np.cumsum(sizes) - sizes, before


def _read(dictionary: bytes, base: dict[int, int], wanted: frozenset | None):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(dictionary)
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index, places, before = entries_of(blob, frames)
                counts = index["ids"].astype(np.int64)
                starts = base[part] + before + np.cumsum(counts) - counts
                rows = [(None if e["null"] else int(e["doc_id"]), int(s), frames.ids(blob[p : p + int(e["size"])]).tobytes()) for e, p, s in zip(index, places.tolist(), starts, strict=True) if wanted is None or (not e["null"] and int(e["doc_id"]) in wanted)]
                if rows:
                    yield table(schema, [*map(list, zip(*rows, strict=True))])

    return run


def _shards(spark: SparkSession, at: str, doc_ids: list[int] | None = None):
    """The shards to read, and what makes batches of (doc_id, start, ids) of them in a task."""
    shards = spark.read.parquet(f"{at}/shards")
    dictionary = bytes(spark.read.parquet(f"{at}/meta").first()[0])
    base, before = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r.part], before = before, before + r.n
    if doc_ids is not None:
        shards = shards.where((F.col("last_id") >= min(doc_ids)) & (F.col("first_id") <= max(doc_ids))) if doc_ids else shards.limit(0)
    return shards.select("part", "blob"), _read(dictionary, base, None if doc_ids is None else frozenset(doc_ids))


def read_token_files(spark: SparkSession, at: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) from files: ids are little-endian unsigned 32-bit. With doc_ids, shards outside their range are
    skipped at the scan and no other document's frame is decompressed. One number for each part goes through the driver."""
    shards, read = _shards(spark, at, doc_ids)
    return shards.mapInArrow(read, "doc_id long, start long, ids binary")


def token_digests(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all that the files hold. Ids are digested in the worker that has read them: a
    second step in Python would take a second worker for each task."""
    shards, read = _shards(spark, at)
    return shards.mapInArrow(lambda batches: _crcs(read(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _crcs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        raws = batch.column(2).to_pylist()
        yield table(schema, [batch.column(0), batch.column(1), [len(x) // 4 for x in raws], [zlib.crc32(x) for x in raws]])


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), at)
    return token_digests(spark, at)
