"""State between collection runs, in batch: failure counters, baselines, rate limits, first writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a table's head.
HEADER_WORDS = ("공지", "공지사항", "목록", "검색", "제목", "번호", "더보기", "전체", "리스트")


def by_source():
    return Window.partitionBy("source").orderBy("run_at", "run_id")


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Each run with the failures in a row up to it: a success resets."""
    streak = runs.withColumn("successes", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(by_source().rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("source", "successes").orderBy("run_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    return streak.withColumn("in_a_row", F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(w)).drop("successes")


def alerts(runs: DataFrame, threshold: int = 3) -> DataFrame:
    """Runs that send an alert: it goes out at the threshold and sets the counter back."""
    return failure_streaks(runs).where(F.col("failed") & (F.col("in_a_row") % threshold == 0)).select("source", "run_id", "in_a_row")


def sudden_drops(runs: DataFrame, hours: int = 26) -> DataFrame:
    """Reads with less than half the rows of the last complete read, where that had ten or more and is fresh enough."""
    reads = runs.where(~F.col("failed"))
    last = F.last(F.when(F.col("complete"), F.struct("n_rows", "run_at")), ignorenulls=True).over(by_source().rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("run_at") < F.col("base.run_at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return reads.withColumn("base", last).where(fresh & (F.col("base.n_rows") >= 10) & (2 * F.col("n_rows") < F.col("base.n_rows"))).select("source", "run_id", "n_rows", F.col("base.n_rows").alias("base_rows"))


def latest(runs: DataFrame) -> DataFrame:
    """The newest record of each source wins."""
    return runs.groupBy("source").agg(F.max_by(F.struct("run_id", "n_rows", "failed"), F.struct("run_at", "run_id")).alias("x")).select("source", "x.run_id", "x.n_rows", "x.failed")


def first_writers(runs: DataFrame) -> DataFrame:
    """Of several starts by a source on a day the first stays."""
    return runs.groupBy("source", F.to_date("run_at").alias("day")).agg(F.min_by("run_id", F.struct("run_at", "run_id")).alias("run_id"))


def stop_pages(pages: DataFrame, empty_streak: int = 2) -> DataFrame:
    """pages (source, page, key): the pages a scan keeps, up to the first run of `empty_streak` pages without a new key. A key
    counts once, on the first page that has it."""
    first = pages.groupBy("source", "key").agg(F.min("page").alias("page"))
    n_first = first.groupBy("source", "page").agg(F.count("*").alias("n_new"))
    new = pages.select("source", "page").distinct().join(n_first, ["source", "page"], "left").na.fill(0, ["n_new"])
    w = Window.partitionBy("source").orderBy("page")
    empties = F.sum(F.when(F.col("n_new") == 0, 1).otherwise(0)).over(w.rowsBetween(1 - empty_streak, 0))
    stop = F.min(F.when(F.col("empties") == empty_streak, F.col("page"))).over(Window.partitionBy("source"))
    kept = F.col("stop").isNull() | (F.col("page") <= F.col("stop"))
    held = new.withColumn("empties", empties).withColumn("stop", stop).groupBy("source")
    return held.agg(
        F.max(F.when(kept, F.col("page"))).alias("last_page"),
        F.max(F.col("stop").isNotNull()).alias("stopped"),
        F.sum(F.when(kept, F.col("n_new"))).alias("n_keys"),
    )


def row_gate(rows: DataFrame, previous: DataFrame, least: int = 0) -> DataFrame:
    """rows (source, title, url, dated): the first rule that a source's rows fail, or ok. previous (source, prev_count). A
    table's header words are no titles."""
    title = F.trim("title")
    facts = rows.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if((F.length(title) >= 4) & ~title.isin(*HEADER_WORDS)).alias("titled"),
        F.count_if(F.col("url").rlike("^https?://.+")).alias("linked"),
        F.count_distinct(F.nullif(F.trim("url"), F.lit(""))).alias("urls"),
        F.count_if("dated").alias("dated"),
    )
    return facts.join(previous, "source", "left").select(
        "source",
        "n",
        F.when(F.col("n") < least, "few")
        .when((F.col("prev_count") >= 10) & (2 * F.col("n") < F.col("prev_count")), "drop")
        .when(10 * F.col("titled") < 6 * F.col("n"), "titles")
        .when(10 * F.col("linked") < 6 * F.col("n"), "links")
        .when(2 * F.col("urls") < F.col("n"), "urls")
        .when(10 * F.col("dated") < 3 * F.col("n"), "dates")
        .otherwise("ok")
        .alias("reason"),
    )
