"""Deadline views over buckets, matches and companies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_left(today: Column) -> Column:
    return F.datediff(F.col("apply_end_date"), today)


def lines(matches: DataFrame, buckets: DataFrame, companies: DataFrame, today: Column) -> DataFrame:
    """Matches of known buckets and companies that end today or later."""
    known = buckets.withColumn("d_day", days_left(today)).where("d_day >= 0")
    return matches.join(known, "bucket_id").join(companies.select("company_id"), "company_id", "left_semi")


def summary(all_lines: DataFrame) -> DataFrame:
    """All tiles in one scan of the lines."""
    within = lambda n: F.count_distinct(F.when(F.col("d_day") <= n, F.col("bucket_id")))
    return all_lines.agg(F.count_distinct(F.when(F.col("d_day") <= 7, F.col("company_id"))).alias("companies_7"), within(7).alias("buckets_7"), within(14).alias("buckets_14"), within(30).alias("buckets_30"), F.count_distinct("bucket_id").alias("buckets_all"), F.count_if(F.col("verdict") == "fit").alias("n_fit"))


def bucket_list(buckets: DataFrame, matches: DataFrame, today: Column) -> DataFrame:
    """Buckets with their numbers of fit and unverified companies, 0 where there is none."""
    n = matches.groupBy("bucket_id").agg(F.count_if(F.col("verdict") == "fit").alias("fit"), F.count_if(F.col("verdict") == "unverified").alias("unverified"))
    return buckets.join(n, "bucket_id", "left").select("bucket_id", "category", days_left(today).alias("d_day"), F.coalesce("fit", F.lit(0)).alias("fit"), F.coalesce("unverified", F.lit(0)).alias("unverified"))


def contacts(all_lines: DataFrame, days: int = 14) -> DataFrame:
    """A row for each company: nearest end, and its kinds with counts, nearest first."""
    kinds = all_lines.where(F.col("d_day") <= days).groupBy("company_id", "category").agg(F.count("*").alias("n"), F.min("d_day").alias("nearest"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("nearest", "category", "n"))), lambda x: F.concat_ws(":", x["category"], x["n"].cast("string"), x["nearest"].cast("string")))
    return kinds.groupBy("company_id").agg(F.min("nearest").alias("nearest"), F.sum("n").alias("n_lines"), F.array_join(parts, ",").alias("kinds"))


#: Kinds that come first, and rows of an export at most.
KINDS_FIRST = ("정책자금", "무상지원금")
EXPORT_ROWS = 50_000


def in_days(days: Column, most: int | None) -> Column:
    """0 <= days, and no more than `most` (None: all); a bucket without an end never is."""
    test = days >= 0 if most is None else days.between(0, most)
    return F.coalesce(test, F.lit(False))


def unstructured(verdict: Column, to_check: Column, generic: tuple[str, ...]) -> Column:
    """A judgement that says nothing of its own: unverified, and left to check is the generic advice at most."""
    return (verdict == "unverified") & (F.size(F.array_except(to_check, F.array(*[F.lit(g) for g in generic]))) == 0)


def first_starts(progress: DataFrame) -> DataFrame:
    """Of several starts of a pair the first stays."""
    return progress.groupBy("company_id", "bucket_id").agg(F.min_by(F.struct("track_id", "created_at"), F.struct("created_at", "track_id")).alias("p")).select("company_id", "bucket_id", "p.*")


def in_scope(companies: DataFrame, reader: str | None = None, keys: list[int] | None = None) -> DataFrame:
    """Companies that a reader may see, or those of a list of keys; an empty list is no company, None no restriction."""
    found = companies
    if reader is not None:
        found = found.where(F.array_contains("readers", reader))
    if keys is not None:
        found = found.where(F.col("company_id").isin(keys)) if keys else found.limit(0)
    return found


def full_lines(matches: DataFrame, buckets: DataFrame, companies: DataFrame, progress: DataFrame, today: Column) -> DataFrame:
    """Matches of known buckets and companies, with days left and whether work has begun."""
    known = buckets.withColumn("d_day", days_left(today))
    begun = first_starts(progress).select("company_id", "bucket_id", F.lit(True).alias("begun"))
    rows = matches.join(known, "bucket_id").join(companies, "company_id").join(begun, ["company_id", "bucket_id"], "left")
    return rows.withColumn("begun", F.coalesce("begun", F.lit(False)))


def contact_lines(lines: DataFrame, generic: tuple[str, ...], days: int | None = 14, with_unstructured: bool = False, with_begun: bool = False) -> DataFrame:
    kept = in_days(F.col("d_day"), days)
    if not with_unstructured:
        kept = kept & ~unstructured(F.col("verdict"), F.col("to_check"), generic)
    if not with_begun:
        kept = kept & ~F.col("begun")
    return lines.where(kept)


def kind_rank(category: Column) -> Column:
    named = F.coalesce(*[F.when(category == k, F.lit(i)) for i, k in enumerate(KINDS_FIRST)])
    return F.coalesce(named, F.when(category == "", len(KINDS_FIRST) + 1).otherwise(len(KINDS_FIRST)))


def contact_rows(lines: DataFrame) -> DataFrame:
    """A row for each company: its nearest end, kinds in their rank with counts and nearest days, lines and begun ones."""
    kinds = lines.groupBy("company_id", "company_name", "category").agg(F.count("*").alias("n"), F.min("d_day").alias("nearest"), F.count_if("begun").alias("n_begun"))
    ranked = F.sort_array(F.collect_list(F.struct(kind_rank(F.col("category")).alias("rank"), "category", "n", "nearest")))
    parts = F.transform(ranked, lambda x: F.concat_ws(":", x["category"], x["n"].cast("string"), x["nearest"].cast("string")))
    return kinds.groupBy("company_id", "company_name").agg(F.min("nearest").alias("nearest"), F.sum("n").alias("n_lines"), F.sum("n_begun").alias("n_begun"), F.array_join(parts, ",").alias("kinds"))


def kind_counts(lines: DataFrame) -> DataFrame:
    """Companies with a line of the first kind, of the second, and of another one."""
    fund, grant = KINDS_FIRST
    own = lines.groupBy("company_id").agg(F.max(F.col("category") == fund).alias("a"), F.max(F.col("category") == grant).alias("b"), F.max(~F.col("category").isin(fund, grant)).alias("c"))
    return own.agg(F.count_if("a").alias("policy_fund"), F.count_if("b").alias("free_grant"), F.count_if("c").alias("other"))


def in_order(buckets: DataFrame, today: Column, days: int | None = None) -> DataFrame:
    """Buckets of the list with their place: dated ones within the days by end and key, then those without an end by key."""
    rows = buckets.withColumn("d_day", days_left(today)).where(in_days(days_left(today), days) | F.col("apply_end_date").isNull())
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("apply_end_date").asc_nulls_last(), "bucket_id")))


def export(lines: DataFrame, days: int | None = None, most: int = EXPORT_ROWS) -> DataFrame:
    """Rows of the spreadsheet: buckets in the list's order, fit before unverified, companies by name and key; `most` rows. Only
    the rows that go out are numbered."""
    order = [F.col("apply_end_date").asc_nulls_last(), F.col("bucket_id").asc(), F.when(F.col("verdict") == "fit", 0).otherwise(1).asc(), F.col("company_name").asc(), F.col("company_id").asc()]
    out = lines.where(in_days(F.col("d_day"), days) | F.col("apply_end_date").isNull()).orderBy(*order).limit(most)
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))


#: Views, their day filters (None: all) and defaults, and a company's key.
VIEWS = ("list", "bucket", "contacts", "company", "summary", "export")
DAYS = {"7": 7, "14": 14, "30": 30, "all": None}
LIST_DAYS, CONTACT_DAYS = 30, 14
CUSTOMER_KEY = r"[bp]:[0-9]{1,64}"


def parse_query(q: dict[str, str]) -> dict:
    """A view's parameters, checked; ValueError names the one that is wrong."""

    def one_of(name: str, known: dict, default):
        raw = q.get(name) or ""
        if raw and raw not in known:
            raise ValueError(name)
        return known[raw] if raw else default

    flags, contacts = {"0": False, "1": True}, ("contacts", "company")
    view = one_of("view", {v: v for v in VIEWS}, "list")
    found = {"view": view}
    if view != "company":
        found["scope"] = one_of("scope", {"mine": "mine", "all": "all"}, None)
    if view in ("list", "export", *contacts):
        found["days"] = one_of("days", DAYS, CONTACT_DAYS if view in contacts else LIST_DAYS)
    for name, default, views in (("hideEmpty", True, ("list",)), ("fitOnly", False, ("export",)), ("includeUnstructured", False, contacts), ("includeProgress", False, contacts)):
        if view in views:
            found[name] = one_of(name, flags, default)
    if view == "bucket":
        key = (q.get("bucket") or "").strip()
        if not key or len(key) > 300:
            raise ValueError("bucket")
        found["bucket"] = key
    if view == "company":
        if not re.fullmatch(CUSTOMER_KEY, q.get("customerKey") or ""):
            raise ValueError("customerKey")
        found["customerKey"] = q["customerKey"]
    if view == "export" and "category" in q:
        if len(q["category"]) > 100:
            raise ValueError("category")
        found["category"] = q["category"]
    return found


def shown(buckets: DataFrame, category: str | None = None, fit_only: bool = False, hide_empty: bool = True) -> DataFrame:
    """Buckets of the list with counts that its filters leave."""
    rows = buckets if not category else buckets.where(F.col("category") == category)
    if fit_only:
        rows = rows.where("fit > 0")
    return rows.where("fit + unverified > 0") if hide_empty else rows


def kind_shown(category: Column, kind: str) -> Column:
    """A contact's line of a kind: all ("") , one of the first two, or the others ("__other")."""
    if kind == "":
        return F.lit(True)
    return ~category.isin(*KINDS_FIRST) if kind == "__other" else category == kind
