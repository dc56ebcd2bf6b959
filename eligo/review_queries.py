"""The staged review of every order line as a pair of a notice and a company. Titles, checks and sentences are taken by the
line's keys; the SQL says what each of them has to leave for a company of which class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.operators import evaluate, review
from eligo.sources import bridge
from eligo.sources.held import held

QUERIES: dict = {}
SQL: dict[str, str] = {}

TITLES = ("경영 지원", "2026년 선정결과 안내", "[경기] 경영 지원", "예비창업자 지원", "경영 지원")
AGE = ("businessAgeMaxYears", "업력 7년 이내", "pass")
SECOND = (("noTaxDelinquency", "국세 완납", "fail"), ("other", "법인만 신청", "unknown"), ("employeeMin", "상시근로자 5인 이상", "pass"), ("certRequired", "인증", "unknown"))
HUMAN = ((), ("상시근로자 5인 이상",), ("벤처기업 확인", "벤처기업 확인"), ("국세·지방세 체납 기업은 제외",))


def _pick(values: list[Column], index: Column) -> Column:
    return F.element_at(F.array(*values), index.cast("int") + 1)


def _check(key: str, raw: str, verdict: str) -> Column:
    fields = {"key": F.lit(key), "values": F.lit(None).cast("array<string>"), "raw_text": F.lit(raw), "verdict": F.lit(verdict), "bars": F.lit(False), "augmented": F.lit(False), "note": F.lit(""), "negated": F.lit(False)}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    lines = held(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct())
    return lines.select(
        ((o * 8 + F.col("l_linenumber")) * 1_000_000 + p).alias("id"), F.col("l_suppkey").alias("company_id"), _pick([F.lit(t) for t in TITLES], o % 5).alias("title"), F.lit("grant").alias("funding_group"), (p % 2 == 0).alias("own_share"),
        F.lit(True).alias("is_announcement"), (p % 7 == 0).alias("rule_only"), F.lit("all").alias("industry_scope"), F.lit("all").alias("region_scope"),
        F.array(_check(*AGE), _pick([_check(*s) for s in SECOND], p % 4)).alias("checks"),
        _pick([F.array(*[F.lit(h) for h in hs]).cast("array<string>") for hs in HUMAN], F.floor(o / 5) % 4).alias("human"),
    )


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    firms = held(review.customers(evaluate.prepared_companies(bridge.companies(spark, sf), bridge.now())).select(*review.COMPANY))
    pairs, of = review.once(_pairs(spark, sf), firms)
    return pairs, review.findings(pairs, firms), of


#: Classes of companies as `bridge.companies` makes them, then one row for each finding.
FOUND = f"""pair AS (SELECT DISTINCT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS id, l_suppkey AS c, l_orderkey AS o, l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), firm AS (SELECT *, CASE c % 5 WHEN 1 THEN true WHEN 2 THEN false ELSE CASE WHEN c % 3 <> 0 THEN c % 3 = 1 END END AS corporation, CASE WHEN c % 5 <> 0 THEN c % 120 END AS employees,
  CASE WHEN c % 11 <> 0 THEN c % 4 = 0 END AS late, CASE WHEN c % 19 = 0 THEN DATE '1999-01-01' WHEN c % 17 <> 0 THEN DATE '{bridge.NOW[:10]}' - CAST(c * 97 % 6000 AS INTEGER) END AS founded FROM pair
), found AS (
  SELECT id, c, o, p, 1 AS stage, 'exclude' AS kind FROM firm WHERE o % 5 = 1
  UNION ALL SELECT id, c, o, p, 2, 'pass' FROM firm
  UNION ALL SELECT id, c, o, p, 2, CASE p % 4 WHEN 0 THEN 'obstacle' WHEN 2 THEN 'pass' WHEN 3 THEN 'check' ELSE CASE WHEN NOT corporation THEN 'fail' ELSE 'check' END END FROM firm
  UNION ALL SELECT id, c, o, p, 3, CASE WHEN employees IS NULL THEN 'check' WHEN employees >= 5 THEN 'pass' ELSE 'fail' END FROM firm WHERE (o // 5) % 4 = 1 AND p % 4 <> 2
  UNION ALL SELECT id, c, o, p, 3, 'check' FROM firm, range(2) WHERE (o // 5) % 4 = 2
  UNION ALL SELECT id, c, o, p, 3, CASE WHEN late THEN 'obstacle' ELSE 'ignore' END FROM firm WHERE (o // 5) % 4 = 3
  UNION ALL SELECT id, c, o, p, 4, 'exclude' FROM firm WHERE o % 5 = 2 AND c % 10 NOT IN (3, 4, 6, 7)
  UNION ALL SELECT id, c, o, p, 5, CASE WHEN founded < DATE '{bridge.NOW[:10]}' OR (founded = DATE '{bridge.NOW[:10]}' AND TIMESTAMP '{bridge.NOW}' > DATE '{bridge.NOW[:10]}') THEN 'exclude' ELSE 'check' END FROM firm WHERE o % 5 = 3
  UNION ALL SELECT id, c, o, p, 7, 'check' FROM firm WHERE p % 7 = 0
  UNION ALL SELECT id, c, o, p, 7, 'pass' FROM firm)"""


def review_stages(spark: SparkSession, sf: str) -> DataFrame:
    """What each stage of the review has found for each company."""
    _, found, of = _found(spark, sf)
    return review.added(found.withColumn("stage", F.col("stage").cast("int")), of, ["stage", "kind"])


def review_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The review's verdict and step for each company and how often."""
    pairs, found, of = _found(spark, sf)
    return review.added(review.verdicts(pairs, found), of, ["verdict", "step"])


QUERIES |= {"review_stages": review_stages, "review_verdicts": review_verdicts}
SQL["review_stages"] = f"WITH {FOUND} SELECT c AS company_id, stage, kind, count(*) AS n FROM found GROUP BY ALL"
SQL["review_verdicts"] = f"""WITH {FOUND}, told AS (SELECT id, c, p, bool_or(kind IN ('exclude', 'fail')) AS out, bool_or(kind = 'check') AS asked, bool_or(kind = 'obstacle') AS mend FROM found GROUP BY ALL)
SELECT c AS company_id, CASE WHEN out THEN 'excluded' WHEN asked OR mend THEN 'unverified' ELSE 'fit' END AS verdict,
  CAST(CASE WHEN out THEN NULL WHEN asked THEN 5 WHEN mend THEN 4 WHEN p % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS step, count(*) AS n FROM told GROUP BY 1, 2, 3"""
