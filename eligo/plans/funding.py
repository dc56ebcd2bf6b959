"""The funding map over items: orders, tabs, top lists, twins, products, groups' members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligo.functions import korean

#: Items of a verdict in a block, and members that a group names.
TOP, MEMBERS = 80, 20
VERDICTS = {"fit": 0, "unverified": 1, "excluded": 2}
#: Weights of what is left to check.
GENERIC_WEIGHT, RAW_WEIGHT, OBSTACLE_WEIGHT = 6, 2, 3


def verdict_rank(fit: Column) -> Column:
    return F.coalesce(*[F.when(fit == v, F.lit(i)) for v, i in VERDICTS.items()])


def step_rank(step: Column, fit: Column) -> Column:
    return F.coalesce(step, F.when(fit == "fit", 3).otherwise(5))


def review_weight(generic: Column, raw: Column, own: Column, obstacles: Column) -> Column:
    """Of the numbers of checks: generic ones, ones by their raw text, other ones; and of obstacles."""
    return generic * GENERIC_WEIGHT + raw * RAW_WEIGHT + own + obstacles * OBSTACLE_WEIGHT


def order_of(sort: str) -> list[Column]:
    """Sort keys of items (deadline, fit, step, weight, score, rate_min, amount_won, ord); equal ones stay in their order `ord`."""
    dead = korean.dead_rank(F.col("deadline"))
    keys = {
        "rec": [verdict_rank(F.col("fit")).asc(), korean.is_due_today(F.col("deadline")).asc(), step_rank(F.col("step"), F.col("fit")).asc(), F.col("weight").asc(), dead.asc(), F.col("score").desc()],
        "dead": [dead.asc()],
        "rate": [F.col("rate_min").asc_nulls_last()],
        "amt": [F.coalesce("amount_won", F.lit(-1)).desc()],
    }
    return [*keys[sort], F.col("ord").asc()]


def top_items(items: DataFrame, sort: str, n: int = TOP) -> DataFrame:
    """The first n of each funding group and verdict, with their place among them."""
    place = F.row_number().over(Window.partitionBy("funding_group", "fit").orderBy(*order_of(sort)))
    return items.withColumn("place", place).where(F.col("place") <= n)


def bucket_of(start: Column, end: Column, now: Column) -> Column:
    return F.when(start > now, "upcoming").when(end > now, "open").otherwise("always")


def recommended(rows: DataFrame, now: Column) -> list[Column]:
    """Order of a recommendation: open, always, upcoming; then score, then end."""
    bucket = bucket_of(F.col("apply_start"), F.col("apply_end"), now)
    return [F.when(bucket == "open", 0).when(bucket == "always", 1).otherwise(2).asc(), F.col("score").desc(), F.col("apply_end").asc_nulls_last(), F.col("id").asc()]


def tab_match(tab: str, deadline: Column, group: Column) -> Column:
    """Items of a tab: all, now (open), soon (open, a week at most) or a kind of money."""
    soon = F.coalesce(korean.is_open(deadline) & deadline["d_day"].between(0, 7), F.lit(False))
    return {"all": F.lit(True), "now": korean.is_open(deadline), "soon": soon}.get(tab, F.coalesce(group == tab, F.lit(False)))


def search(text: str) -> list[str]:
    """Terms of a search; ValueError over 100 letters or with a control character. Fixed value: the length."""
    if len(text) > 100 or any(ord(x) < 32 or ord(x) == 127 for x in text):
        raise ValueError("a search of up to 100 letters without control characters")
    return text.lower().split()


def matches_search(terms: list[str], fields: list[Column]) -> Column:
    """All terms are found in the fields."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    found = F.lit(True)
    for term in terms:
        found = found & hay.contains(term)
    return found


def twin_downgrade(items: DataFrame, products: DataFrame) -> DataFrame:
    """Fit announcements whose last twin product (by ord) isn't fit become unverified. A product that only its place excludes
    says nothing."""
    last = products.groupBy("twin_key").agg(F.max_by(F.struct("verdict", "place_only"), "ord").alias("twin"))
    harsh = (F.col("twin.verdict") != "fit") & ~((F.col("twin.verdict") == "excluded") & F.col("twin.place_only"))
    rows = items.join(last, items.grp == last.twin_key, "left")
    return rows.withColumn("fit", F.when((F.col("fit") == "fit") & F.coalesce(harsh, F.lit(False)), "unverified").otherwise(F.col("fit"))).drop("twin", "twin_key")


def with_manual(products: DataFrame, manual: DataFrame, key: str = "product_key") -> DataFrame:
    """Products and those manual ones that aren't among them."""
    return products.unionByName(manual.join(products.select(key), key, "left_anti"), allowMissingColumns=True)


def group_members(rows: DataFrame, most: int = MEMBERS) -> DataFrame:
    """Of groups with more than one row: its number of rows, its first ids and its distinct sources that aren't blank."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy("id"))
    ids = rows.select("grp", "id", place.alias("k")).where(F.col("k") <= most).groupBy("grp").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    facts = rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.trim("source"), F.lit(""))).alias("n_sources")).where("n > 1")
    return facts.join(ids, "grp").select("grp", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "n_sources")


def sibling_downgrade(rows: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """Representatives (rep) that are fit while another row of the group has a check of its own become unverified and take those
    checks, in the order of the rows."""
    own = F.array_except("to_check", F.array(*[F.lit(g) for g in generic]))
    others = rows.where(~F.col("rep") & (F.size(own) > 0)).select("grp", F.struct("id", own.alias("own")).alias("x"))
    told = others.groupBy("grp").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["own"]))).alias("more"))
    found = rows.where("rep").join(told, "grp", "left")
    hit = (F.col("fit") == "fit") & F.col("more").isNotNull()
    return found.select("grp", "id", F.when(hit, "unverified").otherwise(F.col("fit")).alias("fit"), F.when(hit, F.array_union("to_check", "more")).otherwise(F.col("to_check")).alias("to_check"))


def product_conditions(rules: DataFrame) -> DataFrame:
    """rules: a product's machine rules in typed columns, null where there is none. (product_id, ord, key, op, values, number,
    flag, machine_readable), in the rules' fixed order; an age is for humans."""
    none = F.lit(None)

    def one(key, op, test, values=none, number=none, flag=none, machine=True):
        return F.when(test, F.struct(F.lit(key).alias("key"), F.lit(op).alias("op"), values.cast("array<string>").alias("values"), number.cast("double").alias("number"), flag.cast("boolean").alias("flag"), F.lit(machine).alias("machine_readable")))

    c = F.col
    some = lambda name: c(name).isNotNull() & (F.size(name) > 0)
    found = F.array_compact(F.array(
        one("region", "in", some("regions"), values=c("regions")),
        one("industry", "in", some("industries"), values=c("industries")),
        one("companyScale", "in", some("scales"), values=c("scales")),
        one("businessAgeMinYears", "gte", c("age_min").isNotNull(), number=c("age_min")),
        one("businessAgeMaxYears", "lte", c("age_max").isNotNull(), number=c("age_max")),
        one("creditScoreMin", "gte", c("credit_min").isNotNull(), number=c("credit_min")),
        one("creditScoreMax", "lte", c("credit_max").isNotNull(), number=c("credit_max")),
        one("revenueMaxKrw", "lte", c("revenue_max").isNotNull(), number=c("revenue_max")),
        one("employeeMax", "lte", c("employees_max").isNotNull(), number=c("employees_max")),
        one("isCorporation", "eq", c("corporation").isNotNull(), flag=c("corporation")),
        one("hasExistingLoan", "eq", c("existing_loan").isNotNull(), flag=c("existing_loan")),
        one("other", "lte", c("owner_age").isNotNull(), number=c("owner_age"), machine=False),
    ))
    return rules.select("product_id", F.posexplode(found).alias("ord", "c")).select("product_id", "ord", "c.*")


#: Labels of facts that a company hasn't told, in their order, and the conditions that ask for them.
GAPS = {
    "credit": ("신용점수", ("creditScoreMin", "creditScoreMax")),
    "has_loan": ("기존 대출 유무", ("hasExistingLoan",)),
    "region": ("소재지", ("region",)),
    "industry": ("업종", ("industry", "targetSector")),
    "founded": ("설립일", ("businessAgeMaxYears", "businessAgeMinYears")),
    "revenue": ("연매출", ("revenueMaxKrw", "revenueMinKrw")),
    "employees": ("직원 수", ("employeeMax", "employeeMin")),
    "scale": ("기업 규모", ("companyScale",)),
    "tax_delinquent": ("체납 여부", ("noTaxDelinquency",)),
    "has_cert": ("인증 보유", ("certRequired",)),
    "has_patent": ("특허 보유", ("patentRequired",)),
    "bizno": ("사업자번호", ("isCorporation",)),
}


def profile_gaps(companies: DataFrame) -> DataFrame:
    """(company_id, gaps): labels of what a company hasn't told, in their order."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) == ""
    return companies.select("company_id", F.array_compact(F.array(*[F.when(blank(name), F.lit(label)) for name, (label, _) in GAPS.items()])).alias("gaps"))


def visible_gaps(companies: DataFrame, conditions: DataFrame) -> DataFrame:
    """The gaps that some condition for machines asks for."""
    label = F.coalesce(*[F.when(F.col("key").isin(*keys), F.lit(label)) for label, keys in GAPS.values()])
    asked = conditions.where("machine_readable").select(label.alias("label")).where("label IS NOT NULL").agg(F.collect_set("label").alias("asked"))
    return profile_gaps(companies).crossJoin(asked).select("company_id", F.array_intersect("gaps", "asked").alias("gaps"))


def page_of(items: DataFrame, number: int, size: int = 10, order: list[Column] | None = None) -> DataFrame:
    """A page of sorted items; a number outside of the pages is moved to the nearest one."""
    last = max(1, -(-items.count() // size))
    own = min(max(1, number), last)
    return items.orderBy(*(order or order_of("rec"))).offset((own - 1) * size).limit(size)


def open_announcements(rows: DataFrame, now: Column) -> DataFrame:
    """Open ones that haven't ended; the filter reaches the scan."""
    return rows.where((F.col("status") == "open") & (F.col("apply_end").isNull() | (F.col("apply_end") > now)))
