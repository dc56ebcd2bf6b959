"""Tables that several later steps read: written once, so that none of them works them out again."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of distinct values up to which what was told of them goes to every task.
FEW = 16_000_000


def held(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names; only a local master gets one of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="eligo-held-"))
    return df.checkpoint()


def sent(once: DataFrame, key: str) -> DataFrame:
    """A held table that goes to every task of a join where the letters of its key are few."""
    letters = once.agg(F.sum(F.length(F.to_json(F.struct(key))) + 100)).first()[0] or 0
    return F.broadcast(once) if letters <= FEW else once


def told_once(rows: DataFrame, names: list[str], told: dict[str, Column]) -> DataFrame:
    """The rows with further columns that read the columns `names` alone: worked out once for equal values of them, nulls equal."""
    key = F.struct(*names)
    # a task for each few values, so that the dear expressions are dealt out; a struct joins as a whole, its nulls too
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.select(key.alias("__key")).distinct().repartition(tasks, "__key").select("__key", "__key.*")
    once = held(once.select("__key", *[c.alias(x) for x, c in told.items()]))
    return rows.withColumn("__key", key).join(sent(once, "__key"), "__key", "left").drop("__key")
