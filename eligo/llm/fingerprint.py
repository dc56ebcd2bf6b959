"""Document fingerprints: a canonical exact digest. Texts are normalised (NFC), case-folded and stripped to single spaces,
then hashed by 128-bit XXH3; equal digests count as equal only where the canonical bytes are equal too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.llm.common import cut, id_and_text, partitions, slices, table


def canonical(text: str | None) -> bytes:
    """NFC, case folding (which may need NFC again), then runs of Unicode white space as one space, none at the ends."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = normalize("NFC", text).casefold()
    return " ".join((folded if is_normalized("NFC", folded) else normalize("NFC", folded)).split()).encode()


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def second_digest(canon: bytes) -> bytes:
    """By this one too a row finds its class, where different bytes share a fingerprint."""
    return hashlib.sha256(canon).digest()


def _digest_rows(bits: np.ndarray | None):
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("second", pa.binary()), ("canon", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            canons = [canonical(t) for t in batch.column(1).to_pylist()]
            rows = [(i, d, second_digest(c), c) for i, d, c in zip(batch.column(0).to_pylist(), map(digest, canons), canons, strict=True) if bits is None or bits[(k := int(d[:6], 16)) >> 6] >> np.uint64(k & 63) & np.uint64(1)]
            if rows:
                yield table(schema, [*map(list, zip(*rows, strict=True))])

    return run


def _bits(fingerprints: DataFrame) -> np.ndarray:
    """2^24 bits, those set that the first six digits of the fingerprints name."""
    k = F.conv(F.substring("fingerprint", 1, 6), 16, 10).cast("long")
    found = fingerprints.groupBy(F.shiftright(k, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(conv(substring(fingerprint, 1, 6), 16, 10) AS int) & 63)")).alias("bits")).toArrow()
    bits = np.zeros(1 << 18, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


def _classes(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray | None = None) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col).mapInArrow(_digest_rows(bits), "doc_id long, fingerprint string, second binary, canon binary")
    return rows.groupBy("fingerprint", "second", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs")).drop("canon")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fingerprint, group_id, n_docs): one row for each class of equal canonical texts, group_id its smallest id.

    Grouping is on the digest and the canonical bytes, so bytes are compared within equal digests, and copies merge
    before the shuffle. Null texts are empty and one class; a class of null ids only has a null group_id.
    """
    return _classes(docs, id_col, text_col).drop("second")


def likeness(left: bytes, right: bytes) -> float:
    """Of two canonical texts: 1 where digests and bytes are equal, else 0."""
    return float(digest(left) == digest(right) and left == right)


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, second binary"
#: A row is a result, or the text that opens (kind 1) or ends (kind 2) a partition.
ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("second", pa.binary()), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])


def compare(doc: int | None, text: str, canon: bytes, after: str, after_canon: bytes) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    edited_canon = canonical(edited)
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(canon), digest(edited_canon), likeness(canon, edited_canon), likeness(canon, after_canon), second_digest(canon)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is compared with the one after it, the last one leaves its text."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None
    for batch in slices(batches):
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            canon = canonical(text)
            if last is None:
                out.append((doc, *[None] * 7, 1, part, text))
            else:
                out.append((*compare(*last, text, canon), 0, part, None))
            last = doc, text, canon
        yield table(ROWS, [*map(list, zip(*out, strict=True))])
    if last is not None:
        yield table(ROWS, [[x] for x in (last[0], *[None] * 7, 2, part, last[1])])


def _join_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield table(pa.schema([*ROWS][:8]), [[x] for x in compare(doc, text, canonical(text), after, canonical(after))])


def _against_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    order = ["doc_id", "text_hash"]
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("text_hash")
    walked = cut(rows.mapInArrow(_walk, FIELDS + ", kind int, part int, text string"))
    parts = sorted(r.part for r in walked.where("kind = 1").select("part").collect())  # one number for each range
    if not parts:
        return walked.select(*[f.split()[0] for f in FIELDS.split(", ")])
    nexts = docs.sparkSession.createDataFrame([*zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next int")
    heads = walked.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    ends = walked.where("kind = 2").select("part", "doc_id", "text").join(nexts, "part").join(heads, "next")
    joined = ends.select("doc_id", "text", "after").mapInArrow(_join_ends, FIELDS)
    return walked.where("kind = 0").drop("kind", "part", "text").unionByName(joined)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness, for each row of docs.

    The next document is the next row by id, then by the text's hash; null ids come first and null texts are empty. After the last
    row comes the first, which for a single row is the row itself. Ranges of ids are walked one by one; only the texts
    at the ends of the ranges, two for each range, meet in a join.
    """
    return _against_next(docs, id_col, text_col).drop("second")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """against_next's columns, and the class of each row over the whole table: group_id and n_docs as in exact_groups.

    A fingerprint that one row has is a class of its own. Only texts whose fingerprint may be repeated, by a bitmap of those
    that are, go to the grouping, where their bytes are compared.
    """
    rows = _against_next(docs, id_col, text_col)
    repeated = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    classes = _classes(docs, id_col, text_col, _bits(repeated)).where("n_docs > 1")
    alone = F.col("n_docs").isNull()
    return rows.join(classes, ["fingerprint", "second"], "left").select(*[f.split()[0] for f in FIELDS.split(", ")[:-1]], F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("n_docs", F.lit(1)).alias("n_docs"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
