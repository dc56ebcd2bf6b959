"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters and the ASCII capitals.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A Python task turns to its next slice once it holds so much text.
SLICE_CHARS = 4_000_000
#: A table that rows are looked up in is broadcast up to so many rows; beyond, a key with over one row in HOT is dealt out
#: over SALT parts.
LOOKUP_ROWS, HOT, SALT = 200_000, 200, 64


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local master, where driver and executors are one, gets an own one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="eligo-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: later readers neither recompute nor depend on a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """write(df) puts df into the shared folder and reads it back, for rounds of joins: a checkpoint keeps what the optimizer has
    inferred of its rows, which doubles from round to round until planning takes minutes; a table's reader starts anew.
    Tables are removed at the end, but for the one that was written last."""
    held: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        at = shared_folder(spark, "table")
        df.write.parquet(at)
        held.append(at)
        return spark.read.schema(df.schema).parquet(at)

    try:
        yield write
    finally:
        for at in held[:-1]:
            remove(spark, at)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is run within sends whole texts to Python in batches of `rows`, unless the session already has a smaller size:
    Spark's own size, 10,000 rows, holds tens of MB of text on both sides of the pipe at once. The session's size comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) > rows or int(before) <= 0:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def attach(rows: DataFrame, by: DataFrame, on: list[str], n_rows: str) -> DataFrame:
    """rows with the columns of `by`, nulls where it has no such key; null keys are equal. by has one row for each key, and in
    its column `n_rows`, which doesn't come along, how many of rows have that key.

    A small table is broadcast. Of a large one the hot keys' rows are met by copies, so that no task gets all rows of a key.
    """
    other = [F.col(c).alias(f"__by_{c}") for c in on]
    same = lambda: [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in on]
    values = [c for c in by.columns if c not in (*on, n_rows)]
    if by.count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(by.select(*other, *values)), same(), "left").select(*rows.columns, *values)
    most = rows.count() / HOT
    hot = by.where(F.col(n_rows) > most)  # HOT keys at most
    dealt = rows.join(F.broadcast(hot.select(*other, F.lit(True).alias("__hot"))), same(), "left").select(*rows.columns, "__hot")
    dealt = dealt.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int")).otherwise(0))
    salts = F.when(F.col(n_rows) > most, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    met = by.select(*other, *values, F.explode(salts).alias("__by_salt"))
    return dealt.join(met, [*same(), F.col("__salt") == F.col("__by_salt")], "left").select(*rows.columns, *values)


def row_key(columns: list[str]) -> Column:
    """128 bits that tell rows apart by these columns."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *reversed(columns)).alias("b"))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < len(sizes):
            yield batch.slice(start)


def collected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; Python looks for cycles between them only, where work on one makes very many small objects and none."""
    on = gc.isenabled()
    try:
        for batch in batches:
            gc.disable()
            yield batch
            if on:
                gc.enable()
    finally:
        if on:
            gc.enable()


def table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")
