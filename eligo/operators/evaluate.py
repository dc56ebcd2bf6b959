"""Three-valued evaluation of conditions for any number of companies.

Conditions repeat, so only the distinct ones meet the companies: each company gets one array with its verdict on each, and
each announcement one short array with the numbers of its conditions. Where the two cross, a pair's counts are a sum over
the short array, in the projection that grades it; no pair is shuffled. Unknown never passes, and only a known mismatch
fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.functions import regions, sectors
from eligo.sources.held import held

#: Condition keys and how each compares. Any other key is never machine readable.
EXPECTED_OP = {
    "region": "in",
    "industry": "in",
    "targetSector": "in",
    "targetOrg": "in",
    "companyScale": "in",
    "businessAgeMaxYears": "lte",
    "businessAgeMinYears": "gte",
    "revenueMaxKrw": "lte",
    "revenueMinKrw": "gte",
    "employeeMax": "lte",
    "employeeMin": "gte",
    "noTaxDelinquency": "eq",
    "certRequired": "eq",
    "patentRequired": "eq",
    "creditScoreMin": "gte",
    "creditScoreMax": "lte",
    "hasExistingLoan": "eq",
    "isCorporation": "eq",
    "guaranteeInUse": "in",
}
#: Agencies that lend; another name is a regional foundation's.
LOAN_AGENCIES = ("지역신용보증재단", "신용보증기금", "기술보증기금", "소상공인시장진흥공단", "중소벤처기업진흥공단", "은행", "그 밖")
REGIONAL = "지역신용보증재단"
CONDITION = ["key", "op", "values", "number", "flag", "machine_readable"]
#: Distinct conditions up to which a company holds its verdicts in one array; beyond, conditions meet companies pair by pair.
MOST_DISTINCT = 200_000
#: Bytes of companies' verdicts in one broadcast; more companies are dealt out in blocks of that size.
BROADCAST_BYTES = 64_000_000
FIELD = 1 << 21
PASS, FAIL, OPEN = 1, 2, 3
#: The facts of a company that decide on a condition, and the keys that ask about them. Any other key asks about none.
FACTS = {
    ("region", "district"): ("region",),
    ("industry",): ("industry", "targetSector"),
    ("org_types",): ("targetOrg",),
    ("scale",): ("companyScale",),
    ("founded",): ("businessAgeMaxYears", "businessAgeMinYears"),
    ("revenue",): ("revenueMaxKrw", "revenueMinKrw"),
    ("employees",): ("employeeMax", "employeeMin"),
    ("tax_delinquent",): ("noTaxDelinquency",),
    ("has_cert",): ("certRequired",),
    ("has_patent",): ("patentRequired",),
    ("credit",): ("creditScoreMin", "creditScoreMax"),
    ("bizno", "is_corporation"): ("isCorporation",),
    ("has_loan", "loan_uses", "loan_uses_complete"): ("hasExistingLoan", "guaranteeInUse"),
}


def loan_agency(name: Column) -> Column:
    return name.isin(*LOAN_AGENCIES)


def prepared_conditions(conditions: DataFrame, districts=None) -> DataFrame:
    """Conditions with what of their places doesn't depend on a company: `targets`."""
    targets = F.transform("values", lambda v: F.struct(v.alias("text"), regions.district_of(v, districts).alias("district"), regions.provinces_in(v).alias("provinces")))
    every = sectors.neighbour_table()
    near = F.array_distinct(F.flatten(F.transform("values", lambda v: F.coalesce(F.try_element_at(every, v), F.array().cast("array<string>")))))
    place = F.when(F.col("key") == "region", targets)
    return conditions.withColumns({"targets": place, "near": F.when(F.col("key") == "targetSector", near)})


def prepared_companies(companies: DataFrame, now: Column, districts=None) -> DataFrame:
    """Companies with what of them doesn't depend on a condition."""
    return companies.withColumns({
        "mine": regions.canonical_region(F.col("region")),
        "provinces": regions.provinces_in(F.col("region")),
        "words": regions.place_words(F.col("region")),
        "trusted": regions.trusted_district(F.col("region"), F.col("district"), districts),
        "own_district": regions.district_of(F.col("district"), districts)["name"],
        "sectors": sectors.sectors_of_industry(F.col("industry")),
        "org_names": sectors.org_types_of(F.col("org_types")),
        "age": sectors.age_years(F.col("founded"), now),
        "corporation": sectors.corporation_of(F.col("bizno"), F.col("is_corporation")),
    })


def _told(t: Column) -> Column:
    """What a target of a region condition says: pass, other (a known mismatch), same (province, another district), unread or
    nothing."""
    d, region = t["district"], F.col("region")
    fits = F.array_contains("provinces", d["sido"]) | F.coalesce(F.array_contains("provinces", d["former"]), F.lit(False))
    by_district = (
        F.when(regions.names_district(F.col("words"), d["name"]) | F.coalesce(F.col("trusted") == d["name"], F.lit(False)), "pass")
        .when(F.size("provinces") == 0, "unread")
        .when(fits | F.coalesce(F.col("own_district") == d["name"], F.lit(False)), "same")
        .otherwise("other")
    )
    named = (F.size(t["provinces"]) > 0) & F.col("mine").isNotNull()
    plain = F.when(region.contains(t["text"]) | t["text"].contains(region), "pass").otherwise("nothing")
    return F.when(d.isNotNull(), by_district).when(named, F.when(F.array_contains(t["provinces"], F.col("mine")), "pass").otherwise("other")).otherwise(plain)


def _region(values: Column) -> Column:
    has = lambda x: F.array_contains("says", x)
    return (
        F.when(F.coalesce("region", F.lit("")) == "", "unknown")
        .when(F.exists(values, lambda v: v.contains(regions.NATIONWIDE)), "pass")
        .when(regions.compact(F.col("region")).startswith(regions.NATIONWIDE), "unknown")
        .when(has("pass"), "pass")
        .when(has("same") | has("unread"), "unknown")
        .when(has("other"), "fail")
        .otherwise("unknown")
    )


def _guarantee(c: Column) -> Column:
    """Records of loans: a struct of agency, name, sido and status (in-use, unknown or ended) each."""
    uses = F.coalesce("loan_uses", F.array().cast("array<struct<agency:string,name:string,sido:string,status:string>>"))
    kind = lambda w, u: F.when(loan_agency(w), u["agency"] == w).otherwise(u["agency"] == REGIONAL)
    place = lambda u: F.coalesce(u["sido"], regions.foundation_province(u["name"]))
    fits = lambda w, u: kind(w, u) & (loan_agency(w) | F.coalesce(place(u) == regions.foundation_province(w), F.lit(False)))
    wanted = lambda u, test: F.exists(c["values"], lambda w: test(w, u))
    elsewhere = F.exists(c["values"], lambda w: ~loan_agency(w)) & F.exists(uses, lambda u: (u["status"] == "in-use") & (u["agency"] == REGIONAL))
    return (
        F.when(F.exists(uses, lambda u: (u["status"] == "in-use") & wanted(u, fits)), "pass")
        .when(~F.col("has_loan"), "fail")
        .when(elsewhere | F.exists(uses, lambda u: (u["status"] == "unknown") & wanted(u, kind)), "unknown")
        .when(F.coalesce("loan_uses_complete", F.lit(False)) & (F.size(uses) > 0), "fail")
        .otherwise("unknown")
    )


def _verdict(c: Column) -> Column:
    yes = lambda test: F.when(test.isNull(), "unknown").when(test, "pass").otherwise("fail")
    n, values = c["number"], c["values"]
    overlap = lambda names: F.arrays_overlap(names, values)
    all_in = lambda known: (F.size(values) > 0) & F.forall(values, lambda v: v.isin(*known))
    age, industry, scale = F.when(F.col("age") >= 0, F.col("age")), F.coalesce("industry", F.lit("")), F.coalesce("scale", F.lit(""))
    tests = {
        "region": _region(values),
        "industry": F.when((industry != "") & F.exists(values, industry.contains), "pass").otherwise("unknown"),
        "targetSector": F.when(~all_in(sectors.SECTORS) | (F.size("sectors") == 0), "unknown").when(overlap(F.col("sectors")), "pass").when(F.arrays_overlap("sectors", c["near"]), "unknown").otherwise("fail"),
        "targetOrg": F.when(~all_in(sectors.ORG_TYPES) | (F.size("org_names") == 0), "unknown").when(overlap(F.col("org_names")), "pass").otherwise("fail"),
        "companyScale": F.when(scale == "", "unknown").when(F.exists(values, lambda v: scale.contains(v) | v.contains(scale)), "pass").otherwise("fail"),
        "businessAgeMaxYears": yes(age <= n),
        "businessAgeMinYears": yes(age >= n),
        "revenueMaxKrw": yes(F.col("revenue") <= n),
        "revenueMinKrw": yes(F.col("revenue") >= n),
        "employeeMax": yes(F.col("employees") <= n),
        "employeeMin": yes(F.col("employees") >= n),
        "noTaxDelinquency": yes(~F.col("tax_delinquent")),
        "certRequired": F.when(~F.col("has_cert"), "fail").otherwise("unknown"),
        "patentRequired": F.when(~F.col("has_patent"), "fail").otherwise("unknown"),
        "creditScoreMin": yes(F.col("credit") >= n),
        "creditScoreMax": yes(F.col("credit") <= n),
        "hasExistingLoan": yes(F.col("has_loan") == c["flag"]),
        "isCorporation": yes(F.col("corporation") == c["flag"]),
        "guaranteeInUse": _guarantee(c),
    }
    found = F.coalesce(*[F.when(c["key"] == key, test) for key, test in tests.items()], F.lit("unknown"))
    return F.when(open_to_machines(c), found).otherwise("unknown")


def checked(pairs: DataFrame) -> DataFrame:
    """pairs: a prepared condition `c` and a prepared company's columns. Adds the verdict; bars, an unknown that rules out a fit
    (all its places are known districts other than the company's); and weak, a pass that can't make a fit alone."""
    c, region = F.col("c"), F.coalesce("region", F.lit(""))
    of_region = c["key"] == "region"
    judged = ~c["machine_readable"] | ((region != "") & ~regions.compact(region).startswith(regions.NATIONWIDE))
    foreign = lambda t: t["district"].isNotNull() & (t["district"]["name"] != F.col("trusted")) & ~regions.names_district(F.col("words"), t["district"]["name"])
    bars = F.when(of_region & fitting_op(c) & judged & (F.col("verdict") == "unknown") & F.col("trusted").isNotNull() & (F.size(c["targets"]) > 0), F.forall(c["targets"], foreign))
    weak = (F.col("verdict") == "pass") & (c["key"].isin("isCorporation", "companyScale") | (of_region & regions.is_nationwide(c["values"])))
    said = pairs.withColumn("says", F.when(of_region & open_to_machines(c), F.transform(c["targets"], _told)))
    found = said.withColumn("verdict", _verdict(c))
    return found.withColumns({"bars": F.coalesce(bars, F.lit(False)), "weak": F.coalesce(weak, F.lit(False))})


def fitting_op(c: Column) -> Column:
    return F.coalesce(*[F.when(c["key"] == k, c["op"] == op) for k, op in EXPECTED_OP.items()], F.lit(True))


def open_to_machines(c: Column) -> Column:
    """Only these conditions can have another verdict than unknown."""
    return c["machine_readable"] & c["key"].isin(*EXPECTED_OP) & fitting_op(c)


def kind_of(key: Column) -> Column:
    """The place in FACTS of the facts that a key asks about."""
    return F.coalesce(*[F.when(key.isin(*keys), i) for i, keys in enumerate(FACTS.values())], F.lit(len(FACTS)))


def _by_facts(rows: DataFrame, companies: DataFrame, now: Column, districts) -> tuple[DataFrame, DataFrame]:
    """Verdicts by the few facts of a company that a condition asks about, so that companies of equal facts meet it once:
    (facts, c, verdict, bars, weak), and (company_id, facts) with a row for each kind of facts. rows: prepared conditions c."""
    kinds = [*FACTS]
    kept = {x: companies.schema[x].dataType for names in kinds for x in names}

    def of_kind(i: int) -> Column:
        own = kinds[i] if i < len(kinds) else ()
        return F.struct(F.lit(i).alias("kind"), *[(F.col(x) if x in own else F.lit(None).cast(t)).alias(x) for x, t in kept.items()])

    told = companies.select("company_id", F.explode(F.array(*[of_kind(i) for i in range(len(FACTS) + 1)])).alias("facts"))
    classes = told.select("facts").distinct()
    kind = kind_of(F.col("c.key"))
    prepared = prepared_companies(classes.select("facts", "facts.*"), now, districts)
    asked = rows.withColumn("of", kind)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = prepared.repartition(tasks, F.xxhash64("facts")).join(F.broadcast(asked), F.col("kind") == F.col("of"))
    return checked(pairs).select("facts", *rows.columns, "verdict", "bars", "weak"), told


def checks(conditions: DataFrame, companies: DataFrame, now: Column, districts=None) -> DataFrame:
    """(company_id, the distinct conditions' columns, verdict, bars, weak): each distinct condition for each company."""
    names = [F.col("c")[x].alias(x) for x in CONDITION]
    found, told = by_facts(conditions, companies, now, districts)
    return told.join(found, "facts").select("company_id", *names, "verdict", "bars", "weak")


def by_facts(conditions: DataFrame, companies: DataFrame, now: Column, districts=None) -> tuple[DataFrame, DataFrame]:
    """`_by_facts` of the distinct conditions, as c."""
    rows = prepared_conditions(conditions.select(*CONDITION).distinct(), districts)
    return _by_facts(rows.select(F.struct(*rows.columns).alias("c")), companies, now, districts)


def numbered(conditions: DataFrame) -> DataFrame:
    """(n, c): the distinct conditions that a machine can read; a condition's number is its place among them."""
    c = F.struct(*CONDITION)
    every = conditions.where(open_to_machines(c)).select(c.alias("c")).distinct().agg(F.sort_array(F.collect_list("c")).alias("all"))
    return every.select(F.posexplode("all").alias("n", "c"))


def _codes(place: DataFrame, companies: DataFrame, now: Column, districts) -> tuple[DataFrame, DataFrame]:
    """(facts, k: an array of n, code, strong for each numbered condition that asks about them), and (company_id, facts)."""
    rows = prepared_conditions(place.select("n", "c.*"), districts)
    found, told = _by_facts(rows.select("n", F.struct(*[x for x in rows.columns if x != "n"]).alias("c")), companies, now, districts)
    v = F.col("verdict")
    code = F.when(v == "pass", PASS).when(v == "fail", FAIL).otherwise(OPEN).cast("byte")
    return found.select("facts", F.struct("n", code.alias("code"), ((v == "pass") & ~F.col("weak")).alias("strong")).alias("x")).groupBy("facts").agg(F.collect_list("x").alias("k")), told


def codes(place: DataFrame, companies: DataFrame, now: Column, districts=None) -> DataFrame:
    """(company_id, codes, strong): a company's verdict on each numbered condition, PASS, FAIL or OPEN, and whether it is a pass
    that isn't weak."""
    k, told = _codes(place, companies, now, districts)
    own = told.join(k, "facts").groupBy("company_id").agg(F.sort_array(F.flatten(F.collect_list("k"))).alias("k"))
    return companies.select("company_id").join(own, "company_id", "left").select("company_id", F.col("k.code").alias("codes"), F.col("k.strong").alias("strong"))


def classes(place: DataFrame, companies: DataFrame, now: Column, districts=None) -> tuple[DataFrame, DataFrame]:
    """Facts with equal verdicts on all numbered conditions that ask about them are one class: (class, kind, n and word: the
    conditions' numbers, and a letter for the code of each and whether it is strong), and (company_id, c0, c1, ...: its class by
    each kind of facts, null where no condition asks about them)."""
    k, told = _codes(place, companies, now, districts)
    letter = lambda x: (F.col("k.code")[x] * 2 + F.col("k.strong")[x].cast("byte")).cast("string")
    word = F.array_join(F.transform(F.sequence(F.lit(0), F.size("k") - 1), letter), "")
    named = held(k.withColumn("k", F.sort_array("k")).select("facts", F.col("facts.kind").alias("kind"), F.col("k.n").alias("n"), word.alias("word")))
    every = held(named.groupBy("kind", "word").agg(F.first("n").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    own = told.join(named.join(every.drop("n"), ["kind", "word"]).select("facts", "class"), "facts")
    by_kind = own.groupBy("company_id").agg(*[F.max(F.when(F.col("facts.kind") == i, F.col("class"))).alias(f"c{i}") for i in range(len(FACTS) + 1)])
    return every, companies.select("company_id").join(by_kind, "company_id", "left")


def _profiles(place: DataFrame, companies: DataFrame, now: Column, districts) -> DataFrame:
    """`codes`, each counting one pass, fail or unknown in its own field of a number."""
    code = lambda x: F.when(x == PASS, 1).when(x == FAIL, FIELD).otherwise(FIELD * FIELD).cast("long")
    return codes(place, companies, now, districts).withColumn("codes", F.transform("codes", code))


def _is_hot(rows: DataFrame, column: str) -> bool:
    """Whether one value has over twice the rows of an even task."""
    n = rows.groupBy(column).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bool(n.most) and n.most * tasks > 2 * n["all"]


def _cross(rows: DataFrame, profiles: DataFrame, n_companies: int, row_bytes: int) -> DataFrame:
    """Each row with each company: companies go to all tasks where they are few, else rows meet blocks of them."""
    blocks = -(-n_companies * row_bytes // BROADCAST_BYTES)
    if blocks <= 1:
        return rows.crossJoin(F.broadcast(profiles))
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    left = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = profiles.withColumn("__block", F.pmod(F.xxhash64("company_id"), F.lit(blocks)).cast("int")).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right.hint("shuffle_hash"), ["__block", "__salt"]).drop("__block", "__salt")


def _graded(pairs: DataFrame, keep: list[str], p: Column, f: Column, u: Column, strong: Column) -> DataFrame:
    """No condition is uncertain and scores 40; any fail is impossible; all pass is possible. 50 + 15 a pass - 40 a fail.
    Fit: nothing fails or stays unknown, and a pass that isn't weak."""
    counted = pairs.select(*keep, p.alias("n_pass"), f.alias("n_fail"), u.alias("n_unknown"), strong.alias("__strong"))
    n = F.col("n_pass") + F.col("n_fail") + F.col("n_unknown")
    grade = F.when(F.col("n_fail") > 0, "impossible").when((n > 0) & (F.col("n_unknown") == 0), "possible").otherwise("uncertain")
    score = F.when(n == 0, 40).otherwise(50 + 15 * F.col("n_pass") - 40 * F.col("n_fail")).cast("long")
    fit = F.when(F.col("n_fail") > 0, "excluded").when((F.col("n_unknown") == 0) & F.col("__strong"), "fit").otherwise("unverified")
    return counted.select(*keep, "n_pass", "n_fail", "n_unknown", grade.alias("grade"), score.alias("score"), fit.alias("fit"))


def with_conditions(announcements: DataFrame, conditions: DataFrame, place: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the distinct conditions that a machine can read, as n and c; announcements with `own`, an array of the numbers n and
    counts k of their conditions, by number, and `fixed`, how many of theirs are unknown to all companies)."""
    c = F.struct(*CONDITION)
    place = numbered(conditions) if place is None else place
    told = conditions.select("id", F.when(open_to_machines(c), c).alias("c"))
    counted = told.join(F.broadcast(place), "c", "left").groupBy("id", "n").agg(F.count("*").alias("k"))
    known = F.sort_array(F.filter(F.collect_list(F.struct("n", "k")), lambda x: x["n"].isNotNull()))
    arrays = counted.groupBy("id").agg(known.alias("own"), F.sum(F.when(F.col("n").isNull(), F.col("k")).otherwise(0)).alias("fixed"), F.sum("k").alias("all"))
    none = F.array().cast("array<struct<n:int,k:long>>")
    rows = announcements.join(arrays, "id", "left").withColumns({"own": F.coalesce("own", none), "fixed": F.when(F.col("all") >= FIELD, F.raise_error(F.lit(f"an announcement has over {FIELD} conditions"))).otherwise(F.coalesce("fixed", F.lit(0)))})
    return place, rows.drop("all")


def grades(announcements: DataFrame, conditions: DataFrame, companies: DataFrame, now: Column, districts=None, most_distinct: int = MOST_DISTINCT, cluster: str | None = None) -> DataFrame:
    """(the announcements' columns, company_id, n_pass, n_fail, n_unknown, grade, score, fit) for each announcement (id) and
    company. Conditions of an id that isn't announced count for nothing. cluster: announcements come together by this column
    before they meet the companies, so that pairs that are grouped by it need no shuffle; only where no value of it is hot."""
    spark: SparkSession = announcements.sparkSession
    own = [*announcements.columns, "company_id"]
    c = F.struct(*CONDITION)
    n_distinct = conditions.where(open_to_machines(c)).select(*CONDITION).distinct().count()
    if n_distinct > most_distinct:
        k = checks(conditions, companies, now, districts)
        same = F.lit(True)
        for x in CONDITION:
            same = same & conditions[x].eqNullSafe(k[x])
        v = F.col("verdict")
        counts = conditions.join(k, same).groupBy("id", "company_id").agg(F.count_if(v == "pass").alias("p"), F.count_if(v == "fail").alias("f"), F.count_if(v == "unknown").alias("u"), F.max((v == "pass") & ~F.col("weak")).alias("s"))
        pairs = announcements.crossJoin(companies.select("company_id")).join(counts, ["id", "company_id"], "left")
        zero = lambda x: F.coalesce(x, F.lit(0))
        return _graded(pairs, own, zero("p"), zero("f"), zero("u"), F.coalesce("s", F.lit(False)))
    place, rows = with_conditions(announcements, conditions)
    if cluster and not _is_hot(announcements, cluster):
        rows = rows.repartition(cluster)
    crossed = _cross(rows, _profiles(place, companies, now, districts), companies.count(), 10 * n_distinct + 100)
    total = F.aggregate(F.coalesce("own", F.array().cast("array<struct<n:int,k:long>>")), F.lit(0).cast("long"), lambda a, x: a + x["k"] * F.get("codes", x["n"]))
    summed = crossed.withColumn("t", total)
    p, f, u = F.pmod("t", F.lit(FIELD)), F.pmod(F.shiftright("t", 21), F.lit(FIELD)), F.shiftright("t", 42) + F.col("fixed")
    strong = F.when((F.col("t") > 0) & (F.col("t") < FIELD) & (F.col("fixed") == 0), F.exists("own", lambda x: F.get("strong", x["n"]))).otherwise(False)
    return _graded(summed, own, p, f, u, strong)
