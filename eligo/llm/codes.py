"""Vector code compression: a vector's parts are replaced by the numbers of their nearest codebook entries.

The nearest entry is screened by a float32 matrix product with an interval that is sure to hold the exact value; entries whose
interval overlaps that of the best are computed again in int64, ties going to the lower index.

Codebooks are as large as the vectors are long, whatever the number of vectors; rounds read the table and move sums only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.llm.centroids import finite, scaled
from eligo.llm.common import attach, cut, table

#: Half the distance between 1 and the next float32: the relative error of one rounding.
UNIT = 2.0**-24
SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, exact, ties to the lower index.

    |c|^2 - 2 x.c in float32 is off by no more than (d + 4) roundings of its terms' sizes, which Cauchy-Schwarz bounds by
    |c|^2 + 2 |x| |c|; four more roundings are added for the arithmetic of the bound itself.
    """
    x2, c2 = (x * x).sum(1), (entries * entries).sum(1)
    score = (c2.astype(np.float32)[None, :] - np.float32(2) * (x.astype(np.float32) @ entries.astype(np.float32).T)).astype(np.float64)
    error = (x.shape[1] + 8) * UNIT * (c2[None, :] + 2 * np.sqrt(x2.astype(np.float64))[:, None] * np.sqrt(c2.astype(np.float64))[None, :])
    low, high = score - error, (score + error).min(1)
    near = low <= high[:, None]
    index = near.argmax(1)
    open_rows = np.flatnonzero(near.sum(1) > 1)
    if len(open_rows):
        row, entry = np.nonzero(near[open_rows])
        exact = np.full((len(open_rows), len(entries)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[open_rows[row]] - entries[entry]) ** 2).sum(1)
        index[open_rows] = exact.argmin(1)
    return index, ((x - entries[index]) ** 2).sum(1)


def _parts(vectors: pa.Array, factor: int, parts: int) -> np.ndarray:
    """parts x rows x width."""
    q = scaled(vectors, factor)
    return np.ascontiguousarray(q.reshape(len(q), parts, -1).swapaxes(0, 1))


def _sums(books: np.ndarray, factor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if batch.num_rows:
                for j, x in enumerate(_parts(batch.column(0), factor, parts)):
                    index = nearest(x, books[j])[0]
                    np.add.at(sums[j], index, x)
                    counts[j] += np.bincount(index, minlength=k)
        part, entry = np.nonzero(counts)
        yield table(SUMS, [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], sums[part, entry].tolist()])

    return run


def _encode(books: np.ndarray, factor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, dimensions = len(books), books.shape[0] * books.shape[2]
        for batch in batches:
            vectors = batch.column(0)
            fits = np.flatnonzero(vectors.value_lengths().to_numpy() == dimensions)
            codes, errors = [None] * len(vectors), [None] * len(vectors)
            if len(fits):
                found = [nearest(x, book) for x, book in zip(_parts(vectors.take(pa.array(fits)), factor, parts), books, strict=True)]
                for at, code, error in zip(fits.tolist(), np.stack([f[0] for f in found], 1).tolist(), sum(f[1] for f in found).tolist(), strict=True):
                    codes[at], errors[at] = bytes(code).hex(), error
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row whose vector is neither null nor holds a null or
    non-finite component; components become floor(factor * x).

    The vectors' length is that of the smallest id's whose length is a positive multiple of `parts`. A kept row of another
    length can't be cut into such parts: it stays, with a null code and error. The codebooks start as the parts of the
    `entries` (256 at most) rows of smallest id, of equal ids those of smallest components; rows without an id come last.
    With fewer rows there are so many entries. Null labels are one label. An empty table gives no row.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    kept = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"))
    kept = kept.where(F.col("v").isNotNull() & finite("v"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    sized = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).limit(1).select(F.size("v").alias("n")).collect()
    dimensions = sized[0].n if sized else parts
    whole = kept.where(F.size("v") == dimensions)
    first = whole.orderBy(*order).limit(entries).toArrow()
    books = _parts(first.column("v").combine_chunks(), factor, parts) if first.num_rows else np.zeros((parts, 1, dimensions // parts), np.int64)
    for _ in range(rounds):
        found = whole.select("v").mapInArrow(_sums(books, factor), "part int, entry int, n long, sums array<long>")
        means = found.select("part", "entry", "n", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
        books = books.copy()
        for r in means.collect():  # as many numbers as the codebooks hold
            books[r.part, r.entry, r.pos] = r.s // r.n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    label = kept.schema["label"].dataType.simpleString()
    coded = cut(kept.mapInArrow(_encode(books, factor), f"vec_id long, label {label}, code string, error long"))
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    return attach(coded, sums, ["label"], "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, len(embedding) AS n, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"""x AS MATERIALIZED (SELECT r, v, i % (n // {parts}) AS pos, i // (n // {parts}) AS part FROM (SELECT r, n, unnest(q) AS v, unnest(range(n)) AS i FROM kept))""",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS e, pos, v AS m FROM x WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, part, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, part, e, CAST(sum((v - m) * (v - m)) AS BIGINT) AS d FROM x JOIN b{i} USING (part, pos) GROUP BY r, part, e) GROUP BY r, part)""")
        if i < rounds:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT part, e, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r, part) GROUP BY part, e, pos),
b{i + 1} AS MATERIALIZED (SELECT part, e, pos, CASE WHEN n IS NULL THEN m ELSE CAST((s - ((s % n) + n) % n) / n AS BIGINT) END AS m FROM b{i} LEFT JOIN s{i} USING (part, e, pos))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY part, e, pos)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r) USING (r)"""


OP13_SQL = _sql()
