"""Facts from documents: merging by field, head-counts, changes of a profile, names taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligo.functions.korean import squeezed


def merge_fields(facts: DataFrame) -> DataFrame:
    """facts (company_id, field, value, year, rank, ord): equal values of a field are one option; the latest year comes first, then
    the best rank of a document, then the first seen. (company_id, field, value, n_options, n_documents)."""
    own = facts.where(squeezed(F.col("value")) != "").withColumn("key", squeezed(F.col("value")))
    options = own.groupBy("company_id", "field", "key").agg(F.max("year").alias("year"), F.min("rank").alias("rank"), F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value"), F.count("*").alias("n_documents"))
    w = Window.partitionBy("company_id", "field").orderBy(F.col("year").desc_nulls_last(), "rank", "ord")
    picked = options.withColumn("k", F.row_number().over(w)).withColumn("n_options", F.count("*").over(Window.partitionBy("company_id", "field")))
    return picked.where("k = 1").select("company_id", "field", "value", "n_options", "n_documents")


def head_count(rows: DataFrame, employed: str = "고용") -> DataFrame:
    """rows (company_id, name, number, status): distinct persons employed. A company with a row without a name or with a number
    that isn't thirteen digits gets no answer."""
    digits = F.regexp_replace(F.coalesce("number", F.lit("")), "[^0-9]", "")
    broken = (F.trim(F.coalesce("name", F.lit(""))) == "") | (F.length(digits) != 13)
    person = F.when(F.col("status") == employed, F.struct("name", digits))
    return rows.groupBy("company_id").agg(F.when(F.count_if(broken) == 0, F.count_distinct(person)).alias("employees"))


def profile_changes(facts: DataFrame, profile: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields whose last fact (company_id, field, value, ord) differs from the profile's column as text."""
    last = facts.where(F.col("field").isin(*fields)).groupBy("company_id", "field").agg(F.max_by("value", "ord").alias("value"))
    stored = profile.select("company_id", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", "stored"))
    return last.join(stored, ["company_id", "field"]).where(~F.col("value").eqNullSafe(F.col("stored")))


def redacted(text: Column, names: Column, mask: str = "○○○") -> Column:
    """The text with each of the names masked, longer ones first."""
    ordered = F.array_sort(F.filter(names, lambda n: F.length(F.trim(n)) >= 2), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, text, lambda t, n: F.replace(t, n, F.lit(mask)))


def cut_to_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """blocks (doc_id, ord, marker, body): markers always stay, bodies are cut from the end so that a document's blocks hold
    `budget` letters at most (or just the markers, where these are more)."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    markers = F.sum(F.length("marker")).over(Window.partitionBy("doc_id"))
    left = F.greatest(F.lit(budget) - markers - F.coalesce(F.sum(F.length("body")).over(w), F.lit(0)), F.lit(0))
    return blocks.select("doc_id", "ord", F.concat("marker", F.left("body", left.cast("int"))).alias("text"))


def step_ids(steps: DataFrame) -> DataFrame:
    """steps (track_id, g, i, group_name, label, id): a given id stays, else it is made of its place and the first six hex digits
    of its names' digest; ids that repeat within a track get -2, -3 and so on in order."""
    made = F.concat_ws("-", F.lit("s"), F.col("g").cast("string"), F.col("i").cast("string"), F.left(F.sha2(F.concat("group_name", "label"), 256), F.lit(6)))
    own = steps.withColumn("own", F.coalesce(F.nullif("id", F.lit("")), made))
    nth = F.row_number().over(Window.partitionBy("track_id", "own").orderBy("g", "i"))
    return own.withColumn("n", nth).select("track_id", "g", "i", F.when(F.col("n") == 1, F.col("own")).otherwise(F.concat_ws("-", "own", F.col("n").cast("string"))).alias("step_id"))
