"""Groups of announcements: representatives, browse groups, twins of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed(rows: DataFrame, trim: bool = True) -> DataFrame:
    """A blank key groups nothing: such a row is its own group. Without trim only an empty key is blank."""
    key = F.trim("dedup_key") if trim else F.col("dedup_key")
    return rows.withColumn("grp", F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("id:"), F.col("id").cast("string"))))


#: Verdicts in the order in which a group's representative is taken: an excluded copy excludes the group.
PICKED = {"excluded": 0, "fit": 1, "unverified": 2}
PLACES = 1 << 40


def placed(rows: DataFrame) -> DataFrame:
    """Rows (with their number of checks) and their place in their group, as far as no company changes it: the most checks, the
    earliest end (none last), the smallest id."""
    order = [F.col("checks").desc(), F.col("apply_end").asc_nulls_last(), F.col("id").asc()]
    return keyed(rows).withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long"))


def representatives(graded: DataFrame, places: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each group, and each value of `by`: excluded copies first where there is one, else fit before unverified; then
    by place. Verdict and place make one number, so that pairs meet as numbers only; the row's id comes from `places`. A group
    counts its rows and its distinct sources."""
    by = by or []
    rank = F.coalesce(*[F.when(F.col("fit") == v, F.lit(i)) for v, i in PICKED.items()]).cast("long")
    picked = graded.groupBy("grp", *by).agg(F.min(rank * PLACES + F.col("place")).alias("k"), F.count("*").alias("group_count"))
    fit = F.coalesce(*[F.when(F.floor(F.col("k") / PLACES) == i, F.lit(v)) for v, i in PICKED.items()])
    named = picked.select("grp", *by, fit.alias("fit"), (F.col("k") % PLACES).alias("place"), "group_count")
    sources = places.groupBy("grp").agg(F.count_distinct("source").alias("n_sources"))
    ids = places.select("grp", "place", F.col("id").alias("rep_id")).join(sources, "grp")
    return named.join(ids, ["grp", "place"]).select(*by, "grp", "rep_id", "fit", "group_count", "n_sources")


def browse(rows: DataFrame, status: str, top_ids: int = 50) -> DataFrame:
    """Groups of one status: representative, count and first ids. Open ones by earliest end, none last, then newest start;
    those of another status by newest start. A group's ids are ranked before they meet, so that no group is gathered whole."""
    own = keyed(rows.where(F.col("status") == status), trim=False)
    newest = [F.col("apply_start").desc(), F.col("id").asc()]
    order = [F.col("apply_end").asc_nulls_last(), *newest] if status == "open" else newest
    place = F.row_number().over(Window.partitionBy("grp").orderBy(*order))
    counts = own.groupBy("grp").agg(F.count("*").alias("n"))
    first = own.select("grp", "id", "apply_end", place.alias("k")).where(F.col("k") <= top_ids)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"].cast("string"))
    held = first.groupBy("grp").agg(F.min_by(F.struct("id", "apply_end"), "k").alias("r"), F.array_join(ids, ",").alias("ids"))
    return held.join(counts, "grp").select("grp", F.col("r.id").alias("rep_id"), F.col("r.apply_end").alias("apply_end"), "n", "ids")


def page(groups: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of browse groups; the sort ends at the page's last row."""
    return groups.orderBy(F.col("apply_end").asc_nulls_last(), "rep_id").offset((number - 1) * size).limit(size)


def top_per_verdict(rows: DataFrame, n: int = 80, by: list[str] | None = None) -> DataFrame:
    """The first n of each funding group and verdict, and each value of `by`, by score, end and id."""
    w = Window.partitionBy(*(by or []), "funding_group", "fit").orderBy(F.desc("score"), F.col("apply_end").asc_nulls_last(), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def fold_twins(announcements: DataFrame, products: DataFrame) -> DataFrame:
    """Each announcement with the product of its key: the first product of a key goes to the key's first announcement."""
    firsts = keyed(announcements).groupBy("grp").agg(F.min("id").alias("id"))
    own = products.groupBy(F.col("twin_key").alias("grp")).agg(F.min("product_id").alias("related_product_id"))
    return firsts.join(own, "grp").select("id", "related_product_id")


def unfolded_products(announcements: DataFrame, products: DataFrame) -> DataFrame:
    folded = fold_twins(announcements, products).select(F.col("related_product_id").alias("product_id"))
    return products.join(folded, "product_id", "left_anti")


def escaped(text: str) -> str:
    """A text for LIKE, its own wildcards taken as letters."""
    for mark in ("\\", "%", "_"):
        text = text.replace(mark, "\\" + mark)
    return text


def browse_rows(rows: DataFrame, status: str | None = None, category: str | None = None, region: str | None = None, text: str | None = None, fields: tuple[str, ...] = ("title", "agency", "summary", "target_text")) -> DataFrame:
    """Rows of a status, whose category and region hold these texts, and one of whose fields holds the search in any case. All of it
    are predicates that reach the scan or the join below."""
    if status is not None:
        rows = rows.where(F.col("status") == status)
    for name, value in (("category", category), ("sido", region)):
        if value:
            rows = rows.where(F.col(name).like(f"%{escaped(value)}%"))
    if text:
        found = F.lit(False)
        for name in fields:
            found = found | F.col(name).ilike(f"%{escaped(text)}%")
        rows = rows.where(found)
    return rows
