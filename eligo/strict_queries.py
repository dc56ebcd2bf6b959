"""The strict fit over every pair of an order's line: an announcement's title, checks, human checks and scopes are put together
from parts by the line's keys, and the SQL puts the parts' own verdicts together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.operators import strict
from eligo.sources import bridge

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Company classes: place (key modulo 10), line of business (half the key modulo 5), size (key modulo 4).
GYEONGGI, HWASEONG, FOOD, SOFTWARE, BOARDS, SME = "c % 10 IN (6, 7)", "c % 10 = 6", "(c // 2) % 5 = 1", "(c // 2) % 5 = 0", "(c // 2) % 5 = 4", "c % 4 = 2"
#: Checks that passed: key, values, number, text, whether the pass is sure for a company, whether it can make a fit alone.
CHECKS = (
    ("region", ["경기도"], None, "경기도 소재 기업", GYEONGGI, True),
    ("region", ["경기도"], None, "경기도 소재 기업 중 수출기업", "false", True),
    ("employeeMin", None, 5.0, "상시근로자 5인 이상", "true", True),
    ("employeeMin", None, 5.0, "상시근로자 5인 이상인 중소기업", "false", True),
    ("businessAgeMaxYears", None, 7.0, "업력 7년 이내", "true", True),
    ("businessAgeMaxYears", None, 6.0, "업력 7년 미만", "false", True),
    ("industry", ["식품"], None, "식품 기업", FOOD, True),
    ("companyScale", ["중소기업"], None, "중소기업", SME, False),
    ("region", ["전국"], None, "전국 기업", "true", False),
    ("region", ["화성시"], None, "화성 관내 기업", HWASEONG, True),
)
TITLES = (("경영 안정 지원 공고", "true"), ("2026년 선정결과 안내", "false"), ("[경기] 경영 안정 지원", GYEONGGI), ("서울 외 지역 경영 안정 지원", "false"), ("예비창업 패키지", "false"), ("식품제조업 경영 안정 지원", FOOD), ("화성시 경영 안정 지원", HWASEONG), ("클라우드 이용 지원", f"({SOFTWARE} OR {BOARDS})"), ("작업환경 개선 지원", "true"))
HUMAN = (([], "true"), (["휴·폐업 중인 기업 제외"], "true"), (["벤처기업 인증 보유"], "false"), (["허위 신청한 기업 제외", "체납 기업 제외(휴업 제외)"], "true"), (["신용불량 기업 중 상장기업 제외"], "false"))
SCOPES = (("all", "all"), ("restricted", "all"), (None, "all"), ("all", "restricted"), ("all", None))
VERDICTS = ("pass", "pass", "pass", "unknown", "pass", "fail", "pass")


def _pick(values: list[Column], index: Column) -> Column:
    return F.element_at(F.array(*values), index.cast("int") + 1)


def _check(row: tuple, verdict: Column) -> Column:
    key, values, number, raw, *_ = row
    listed = F.lit(None).cast("array<string>") if values is None else F.array(*[F.lit(v) for v in values])
    return F.struct(F.lit(key).alias("key"), listed.alias("values"), F.lit(number).cast("double").alias("number"), F.lit(raw).alias("raw_text"), verdict.alias("verdict"), F.lit(False).alias("bars"), F.lit(False).alias("augmented"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("p"))
    firms = bridge.companies(spark, sf).select("company_id", "region", "district", "industry", "scale")
    p, o = F.col("p"), F.col("id")
    second = _pick([F.lit(v) for v in VERDICTS], (p + o) % len(VERDICTS))
    rows = lines.select(
        "id", "ord", "company_id",
        _pick([F.lit(t) for t, _ in TITLES], o % len(TITLES)).alias("title"),
        F.array(_pick([_check(c, F.lit("pass")) for c in CHECKS], p % len(CHECKS)), _check(("revenueMinKrw", None, 1e8, "매출액 1억원 이상"), second)).alias("checks"),
        _pick([F.array(*[F.lit(h) for h in hs]).cast("array<string>") for hs, _ in HUMAN], F.floor(o / 9) % len(HUMAN)).alias("human"),
        _pick([F.lit(a) for a, _ in SCOPES], F.floor(p / 10) % len(SCOPES)).alias("industry_scope"),
        _pick([F.lit(b) for _, b in SCOPES], F.floor(p / 10) % len(SCOPES)).alias("region_scope"),
        (o % 3 != 0).alias("is_announcement"), (p % 17 == 0).alias("rule_only"),
    )
    return rows.join(firms, "company_id")


def _list(values, quote=repr) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


_flag = lambda values, index: f"list_extract({_list(values, str)}, CAST({index} AS INTEGER) + 1)"
_REGION = [row[0] == "region" for row in CHECKS]
_SCOPE = _flag(
    ["kind <> 6", "false", "false", f"kind IN (0, 1, 9) AND sure", "false"],  # the scopes, in their order; check 6 is one of industry
    "(p // 10) % 5",
)
STRICT = f"""pair AS (SELECT l_orderkey AS id, l_linenumber AS ord, l_suppkey AS company_id, l_suppkey AS c, l_partkey AS p, l_orderkey AS o, l_partkey % {len(CHECKS)} AS kind FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), told AS (SELECT *, {_flag([r[4] for r in CHECKS], 'kind')} AS sure, list_extract({_list(VERDICTS)}, CAST((p + o) % {len(VERDICTS)} AS INTEGER) + 1) AS second,
  {_flag([w for _, w in TITLES], f'o % {len(TITLES)}')} AS title_ok, {_flag([w for _, w in HUMAN], f'(o // 9) % {len(HUMAN)}')} AS human_ok FROM pair
), judged AS (SELECT *, human_ok AND p % 17 <> 0 AND (o % 3 = 0 OR {_SCOPE}) AND title_ok AS open FROM told)"""


def strict_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict of each pair by its checks alone, and with the announcement looked at."""
    told = strict.verdicts(_pairs(spark, sf))
    return told.select("id", "ord", "company_id", "loose", "strict", F.col("blocked").isNull().alias("open"))


QUERIES["strict_fits"] = strict_fits
SQL["strict_fits"] = f"""WITH {STRICT} SELECT id, ord, company_id, open,
  CASE WHEN second = 'fail' THEN 'excluded' WHEN second = 'unknown' THEN 'unverified' ELSE 'fit' END AS loose,
  CASE WHEN second = 'fail' THEN 'excluded' WHEN second = 'unknown' OR NOT open OR NOT sure THEN 'unverified' ELSE 'fit' END AS strict FROM judged"""
