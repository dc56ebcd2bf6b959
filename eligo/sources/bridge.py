"""Domain tables derived from the supplied star schema, by arithmetic that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.functions.regions import PROVINCES
from eligo.operators.evaluate import EXPECTED_OP

SIDO = tuple(PROVINCES)
#: The kinds of money, in their order.
FUNDING_GROUPS = ("grant", "policy", "guarantee", "bank", "urgent", "invest")
NOW = "1998-06-01 03:00:00"


def now(at: str = NOW):
    """The reference time, UTC, always a parameter."""
    return F.lit(at).cast("timestamp_ntz")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    man = F.floor(F.col("o_totalprice") / 10).cast("long")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return rows.select(
        k.alias("id"),
        F.col("o_orderpriority").alias("source"),
        _pick(SIDO, F.col("c_nationkey") % 17).alias("sido"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"),
        F.col("o_orderdate").alias("apply_start"),
        F.when(k % 7 != 0, F.col("o_orderdate") + F.make_dt_interval((k % 60).cast("int"), F.lit(14), F.lit(59), F.lit(59))).alias("apply_end"),
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" ~ "), F.date_format(F.date_add(F.to_date("o_orderdate"), (k % 60).cast("int")), "yyyy-MM-dd")).alias("period_text"),
        F.when(k % 7 == 0, _pick(("", "예산 소진 시까지", "상시 모집", "추후 공지", "연중"), F.floor(k / 7) % 5)).otherwise("기간 내").alias("deadline_text"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("|"), F.date_format("o_orderdate", "yyyy-MM"))).alias("dedup_key"),
        _pick(FUNDING_GROUPS, k % 6).alias("funding_group"),
        (man * 10_000).alias("amount_won"),
        F.concat(F.lit("최대 "), F.when(man >= 10_000, F.concat(F.floor(man / 10_000).cast("string"), F.lit("억 "))).otherwise(""), F.format_number((man % 10_000).cast("double"), 0), F.lit("만원")).alias("amount_text"),
        F.concat(F.lit("["), _pick(SIDO, F.col("c_nationkey") % 17), F.lit("] "), F.when(k % 2 == 0, "(정책) 자금·융자 ").otherwise("Growth 지원-사업 "), (k % 97).cast("string"), F.lit("호")).alias("title"),
        F.concat(F.lit("Agency "), (F.col("o_custkey") % 29).cast("string")).alias("agency"),
    )


#: Facts of companies and values of conditions, each with the verdicts (p, f, u) that they make, worked out by hand: a row
#: for each value, a letter for each fact.
PLACES = (("서울특별시 강남구", "강남구"), ("충북 청주시", None), ("강원영월군", None), ("전국", None), (None, None), ("경상북도 군위군", "군위군"), ("경기도 화성시", "화성시"), ("경기", None), ("경북", "구미시"), ("부산", "구미시"))
REGION_CASES = (
    (("서울특별시",), "pffuufffff"),
    (("충청북도", "세종"), "fpfuufffff"),
    (("전국",), "ppppuppppp"),
    (("수도권",), "uuuuuuuuuu"),
    (("대구경북",), "fffuupffpf"),
    (("영월군",), "ffpuufffff"),
    (("구미",), "fffuuuffpu"),
    (("화성시", "구미시"), "fffuuupupu"),
    (("군위군",), "fffuupffuf"),
    (("경기도", "경북", "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종"), "pffuuppppp"),
)
INDUSTRIES = ("소프트웨어 개발업", "식품 제조업", None, "FITNESS 서비스업", "인쇄회로기판 제조업")
INDUSTRY_CASES = ((("소프트웨어", "정보통신"), "puuuu"), (("제조",), "upuup"), (("농업",), "uuuuu"))
SECTOR_CASES = ((("정보통신",), "pfuuu"), (("식품",), "fpuuf"), (("제약",), "uuuuu"), (("광고인쇄",), "ffuuf"))
ORGS = (None, ("예비사회적기업 인증",), ("주식회사",), ("협동조합", "마을기업"), ())
ORG_CASES = ((("사회적기업",), "upufu"), (("마을기업", "자활기업"), "ufupu"), (("대학",), "uuuuu"))
SCALES = (None, "소상공인", "중소기업", "중견")
SCALE_CASES = ((("소상공인",), "upff"), (("중소기업", "소상공인"), "uppf"), (("중견기업",), "uffp"))
#: Records of loans (agency, name, status) and whether they are all; a company without any loan fails what doesn't pass.
LOANS = (
    ((), None),
    ((("신용보증기금", "신보", "in-use"),), True),
    ((("지역신용보증재단", "경기신용보증재단", "in-use"),), True),
    ((("기술보증기금", "기보", "unknown"),), True),
    ((("은행", "은행", "in-use"),), False),
    ((("은행", "은행", "in-use"),), True),
)
LOAN_CASES = ((("신용보증기금",), "upffuf"), (("지역신용보증재단",), "ufpfuf"), (("서울신용보증재단",), "ufufuf"))
BIZNOS = (None, "123-81-00001", "1234500002", "123-90-00003", "12-3")


def _strings(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _pick_any(columns, index):
    return F.element_at(F.array(*columns), index.cast("int") + 1)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    known = lambda m, v: F.when(k % m != 0, v)
    use = lambda agency, name, status: F.struct(F.lit(agency).alias("agency"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("sido"), F.lit(status).alias("status"))
    uses = "array<struct<agency:string,name:string,sido:string,status:string>>"
    return _read(spark, sf_dir, "supplier").select(
        k.alias("company_id"),
        _pick(tuple(p for p, _ in PLACES), k % 10).alias("region"),
        _pick(tuple(d for _, d in PLACES), k % 10).alias("district"),
        _pick(INDUSTRIES, F.floor(k / 2) % 5).alias("industry"),
        _pick_any([F.lit(None).cast("array<string>") if o is None else _strings(o) for o in ORGS], F.floor(k / 3) % 5).alias("org_types"),
        F.when(k % 19 == 0, F.to_date(F.lit("1999-01-01"))).when(k % 17 != 0, F.date_sub(F.to_date(now()), (k * 97 % 6000).cast("int"))).alias("founded"),
        known(7, F.floor(F.col("s_acctbal")).cast("long")).alias("revenue"),
        known(5, k % 120).alias("employees"),
        _pick(SCALES, k % 4).alias("scale"),
        known(11, k % 4 == 0).alias("tax_delinquent"),
        known(3, k % 3 == 1).alias("has_cert"),
        known(4, k % 4 == 1).alias("has_patent"),
        known(3, 300 + k * 7 % 700).alias("credit"),
        F.when(k % 4 != 3, k % 4 != 2).alias("has_loan"),
        _pick_any([F.array(*[use(*r) for r in rows]).cast(uses) for rows, _ in LOANS], k % 6).alias("loan_uses"),
        _pick_any([F.lit(all_).cast("boolean") for _, all_ in LOANS], k % 6).alias("loan_uses_complete"),
        _pick(BIZNOS, k % 5).alias("bizno"),
        known(3, k % 3 == 1).alias("is_corporation"),
    )


#: Keys of the derived conditions, by their kind.
KINDS = (*EXPECTED_OP, "other")
VALUES = {"region": REGION_CASES, "industry": INDUSTRY_CASES, "targetSector": SECTOR_CASES, "targetOrg": ORG_CASES, "companyScale": SCALE_CASES, "guaranteeInUse": LOAN_CASES}


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each condition: key, op, and the value in the column of its kind. One in thirteen has an op that doesn't fit
    its key."""
    kind, q, v = (F.col("l_orderkey") + 3 * F.col("l_linenumber")) % 20, F.floor(F.col("l_quantity")).cast("long"), F.col("l_suppkey")
    key = _pick(KINDS, kind)
    own_op = _pick((*EXPECTED_OP.values(), "eq"), kind)
    number = {"businessAgeMaxYears": q % 15 + 1, "businessAgeMinYears": q % 15, "revenueMaxKrw": q * 200, "revenueMinKrw": q * 100, "employeeMax": q * 2, "employeeMin": q, "creditScoreMin": 300 + q * 10, "creditScoreMax": 400 + q * 10}
    flag = {"noTaxDelinquency": F.lit(True), "certRequired": F.lit(True), "patentRequired": F.lit(True), "hasExistingLoan": F.col("l_partkey") % 2 == 0, "isCorporation": F.col("l_partkey") % 2 == 0}
    case = lambda rows: F.coalesce(*[F.when(key == k, value) for k, value in rows.items()])
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("ord"),
        key.alias("key"),
        F.when(F.col("l_partkey") % 13 != 0, own_op).when(own_op == "eq", "in").otherwise("eq").alias("op"),
        case({k: _pick_any([_strings(x) for x, _ in rows], v % len(rows)) for k, rows in VALUES.items()}).alias("values"),
        case(number).cast("double").alias("number"),
        case(flag).alias("flag"),
        ((F.col("l_returnflag") != "N") & (kind != 19)).alias("machine_readable"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        k.alias("product_id"),
        F.concat((k % 1500 + 1).cast("string"), F.lit("|"), F.format_string("%d-%02d", F.lit(1995) + (k % 4).cast("int"), (k % 12 + 1).cast("int"))).alias("twin_key"),
        F.when(k % 3 == 0, "fit").when(k % 3 == 1, "unverified").otherwise("excluded").alias("verdict"),
        _pick(FUNDING_GROUPS, k % 6).alias("funding_group"),
        (F.floor("p_retailprice") * 100_000).cast("long").alias("limit_won"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company x bucket judgements: every part is a bucket, one row for each pair of a supplier and a part with a line. What is
    left to check: nothing, the generic advice alone, or a check of its own and the advice."""
    lines = _read(spark, sf_dir, "lineitem")
    n = F.count("*") % 3
    return lines.groupBy(F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("bucket_id")).agg(
        F.when(F.max("l_quantity") >= 25, "fit").otherwise("unverified").alias("verdict"),
        n.cast("int").alias("n_to_check"),
        F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit(GENERIC[0]))).otherwise(F.array(F.lit("업종 확인"), F.lit(GENERIC[0]))).alias("to_check"),
    )


#: Advice that stands under every judgement.
GENERIC = ("원문 확인",)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of work on a bucket for a company, several for a pair at times."""
    lines = _read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return lines.select(F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("bucket_id"), F.col("l_orderkey").alias("track_id"), F.col("l_shipdate").alias("created_at"))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, and the consultants who may read a company: one of all companies of a nation, and one of every third."""
    k = F.col("s_suppkey")
    readers = F.array_compact(F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.when(k % 3 == 0, "third")))
    return _read(spark, sf_dir, "supplier").select(k.alias("company_id"), F.concat(F.lit("Firm "), (k * 7 % 50).cast("string")).alias("company_name"), readers.alias("readers"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        k.alias("bucket_id"),
        _pick(FUNDING_GROUPS, k % 6).alias("category"),
        F.when(k % 9 != 0, F.date_add(F.to_date(now()), (k % 45).cast("int") - 4)).alias("apply_end_date"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection runs: an error event is a failed run of its source, any other a read of so many rows."""
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source"), F.col("ts").alias("run_at"), (F.col("event_type") == "error").alias("failed"), F.get_json_object("props", "$.k").cast("int").alias("n_rows"), (F.col("event_type") != "click").alias("complete"))
