"""Centroid clustering by sort-means: each round every centroid has the others ordered by their distance from it, and a
vector looks through that order from the centroid it had before, up to twice its distance from that one.

All arithmetic is on integers. A round reads the vectors with their last cluster, and writes them with the new one beside each
task's sums (cluster by cluster); the sums alone are added up, so that the driver sees centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.llm.common import remove, shared_folder, table

#: With components up to this size no squared distance leaves 64 bits at up to 2^6 of them.
LARGEST = 1 << 27
ROWS_SQL = "vec_id long, q binary, cluster int, distance long, sums array<long>, n long, spread decimal(38,0)"
ROWS = pa.schema([("vec_id", pa.int64()), ("q", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64())), ("n", pa.int64()), ("spread", pa.decimal128(38, 0))])


def finite(vector: str | Column) -> Column:
    """No component is null, infinite or not a number; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vectors: pa.Array, factor: int) -> np.ndarray:
    """floor(factor * x) of equally long lists of doubles; ValueError beyond LARGEST."""
    flat = np.floor(factor * vectors.flatten().to_numpy())
    if len(flat) and not np.abs(flat).max() <= LARGEST:
        raise ValueError(f"a component beyond {LARGEST} / {factor}: squared distances would leave 64 bits")
    return flat.astype(np.int64).reshape(len(vectors), -1)


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number.

    d(p, c) > 2 d(x, p) means that c is farther from x than p is. Rows of one p are in falling order of their distance from
    it, so that those which still look at the next centroid of the order are the first ones.
    """
    cluster, distance = np.array(before, np.int64), ((x - centroids[before]) ** 2).sum(1)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    for p in np.unique(before).tolist():
        rows = np.flatnonzero(before == p)
        rows = rows[np.argsort(-distance[rows], kind="stable")]
        own, limit = x[rows], -4 * distance[rows]
        best, at = distance[rows], np.full(len(rows), p)
        for c in np.argsort(apart[p], kind="stable").tolist():
            if c == p:
                continue
            n = int(np.searchsorted(limit, -apart[p, c], side="right"))
            if not n:
                break
            d = ((own[:n] - centroids[c]) ** 2).sum(1)
            better = (d < best[:n]) | (d == best[:n]) & (c < at[:n])
            best[:n][better], at[:n][better] = d[better], c
        cluster[rows], distance[rows] = at, best
    return cluster, distance


def _assign(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        sums, counts, spread = np.zeros((k, width), np.int64), np.zeros(k, np.int64), [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
            cluster, distance = nearest(x, centroids, batch.column(2).to_numpy())
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                spread[c] += sum(distance[cluster == c].tolist())
            blank = [pa.nulls(len(x), f.type) for f in [*ROWS][4:]]
            yield table(ROWS, [batch.column(0), batch.column(1), cluster.astype(np.int32), distance, *blank])
        held = np.flatnonzero(counts).tolist()
        blank = [pa.nulls(len(held), f.type) for f in (ROWS.field(0), ROWS.field(1))]
        yield table(ROWS, [*blank, np.array(held, np.int32), pa.nulls(len(held), pa.int64()), [sums[c].tolist() for c in held], counts[held], pa.array([spread[c] for c in held], pa.decimal128(38, 0))])

    return run


def _quantised(factor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in scaled(batch.column(1), factor).astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(np.zeros(len(rows), np.int32))], names=["vec_id", "q", "cluster"])

    return run


def _totals(rows: DataFrame) -> tuple[dict[int, int], dict[int, np.ndarray], dict[int, int]]:
    """(count, component sums, summed distance) by cluster, from what each task has added up."""
    parts = rows.where("n is not null")
    sums = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("v"))
    by: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # clusters x components
        by.setdefault(r.cluster, {})[r.pos] = r.v
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("spread").alias("spread")).collect()
    return {r.cluster: r.n for r in whole}, {c: np.array([v[i] for i in range(len(v))], object) for c, v in by.items()}, {r.cluster: int(r.spread) for r in whole}


def cluster(vectors: DataFrame, k: int, rounds: int, dimensions: int = 64, factor: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row.

    Kept are vectors of exactly `dimensions` components, none null or non-finite. They become floor(factor * x). The first
    centroids are the k rows of smallest sha256(seed + id), then of smallest components; rows without an id come last.
    With fewer rows than k there are so many centroids. Equal centroids: all rows go to the smaller number, the other one
    stays as it is. Repeated ids and rows are rows of their own; an empty table gives no row. Other columns aren't read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.where((F.size("v") == dimensions) & finite("v"))
    first = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).toArrow()
    centroids = scaled(first.column("v").combine_chunks(), factor) if first.num_rows else np.zeros((1, dimensions), np.int64)
    rows, folder = kept.mapInArrow(_quantised(factor), "vec_id long, q binary, cluster int"), None
    for step in range(rounds + 1):
        at = shared_folder(spark, "clusters")
        rows.mapInArrow(_assign(centroids), ROWS_SQL).write.parquet(at)
        if folder:
            remove(spark, folder)
        folder = at
        written = spark.read.schema(ROWS_SQL).parquet(at)
        rows = written.where("n is null").select("vec_id", "q", "cluster")
        counts, sums, spread = _totals(written)
        if step < rounds:
            centroids = centroids.copy()
            for c, n in counts.items():
                centroids[c] = [int(s) // n for s in sums[c]]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    inertia = of([F.lit(spread.get(c, 0)).cast("long") for c in range(len(centroids))])
    return written.where("n is null").select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(spread.values())).cast("long").alias("inertia"), of([F.lit(d) for d in digests]).alias("centroid_sha256"))


K, ROUNDS = 40, 5


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), K, ROUNDS)


def _sql() -> str:
    """Every round compares all vectors with all centroids, component by component."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
x AS MATERIALIZED (SELECT r, unnest(q) AS v, unnest(range(64)) AS pos FROM kept)""",
        f"""m0 AS MATERIALIZED (SELECT c, unnest(q) AS m, unnest(range(64)) AS pos
  FROM (SELECT q, row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS c FROM kept) WHERE c < {K})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, CAST(sum((v - m) * (v - m)) AS BIGINT) AS d FROM x JOIN m{i} USING (pos) GROUP BY r, c) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT c, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, pos),
m{i + 1} AS MATERIALIZED (SELECT c, CASE WHEN n IS NULL THEN m ELSE CAST((s - ((s % n) + n) % n) / n AS BIGINT) END AS m, pos FROM m{i} LEFT JOIN s{i} USING (c, pos))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY pos)) AS sha FROM m{ROUNDS} GROUP BY c) USING (c)"""


OP12_SQL = _sql()
