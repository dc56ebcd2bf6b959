"""Strict fit against verdicts worked out by hand."""

import pytest
from pyspark.sql import functions as F

from eligo.operators import strict

COMPANY = "region string, district string, industry string, scale string"
GYEONGGI = ("경기도 화성시", "화성시", "식품 제조업", "중소기업")
CASES = [
    ("region", ["경기도"], None, "경기도 소재 기업", True),
    ("region", ["경기도"], None, "경기도 소재 기업 중 수출기업", False),
    ("region", ["경기도"], None, "[공고 지역 칸] 경기도", True),
    ("region", ["서울", "경기"], None, "경기도 소재", False),
    ("region", ["화성시"], None, "경기도 화성시 소재 기업", True),
    ("region", ["화성시"], None, "화성 관내 기업", True),
    ("region", ["구미시"], None, "구미시 소재", False),
    ("region", ["전국"], None, "전국 기업", True),
    ("region", ["전국"], None, "서울 소재 전국 기업", False),
    ("region", ["경기"], None, "화성시 제외", False),
    ("employeeMin", None, 5.0, "상시근로자 5인 이상", True),
    ("employeeMin", None, 5.0, "상시근로자 5인 이상인 중소기업", False),
    ("employeeMin", None, 5.0, "교육 인원 5인 이상", False),
    ("employeeMax", None, 5.0, "근로자 5인 이상", False),
    ("businessAgeMaxYears", None, 7.0, "업력 7년 이내", True),
    ("businessAgeMaxYears", None, 6.0, "업력 7년 미만", False),
    ("businessAgeMaxYears", None, 6.0, "업력 6개월 이내", False),
    ("revenueMinKrw", None, 100_000_000.0, "매출액 1억원 이상", True),
    ("revenueMinKrw", None, 100_000_000.0, "매출액 2억원 이상", False),
    ("creditScoreMin", None, 700.0, "신용점수 700 이상", True),
    ("industry", ["식품"], None, "식품 기업", True),
    ("industry", ["용기"], None, "용기 기업", False),
    ("companyScale", ["중소기업"], None, "중소기업", True),
    ("companyScale", ["소기업"], None, "소기업", False),
    ("companyScale", ["중소기업"], None, "업력 3년 이하 중소기업", False),
    ("targetOrg", ["사회적기업"], None, "사회적기업인 협동조합", False),
    ("targetOrg", ["사회적기업"], None, "사회적기업", True),
    ("hasExistingLoan", None, None, "기존 대출 이용 중(대환)", True),
    ("hasExistingLoan", None, None, "", False),
    ("hasExistingLoan", None, None, None, False),
]
TITLES = [
    ("경영 안정 지원 공고", None), ("", None), (None, None), ("2026년 선정결과 안내", "no programme"), ("[경기] 경영 안정 지원", None), ("[부산] 경영 안정 지원", "place"), ("서울 외 지역 경영 안정 지원", "place"), ("화성시 경영 안정 지원", None), ("구미시 경영 안정 지원", "place"),
    ("중구 경영 안정 지원", "place"), ("예비창업 패키지", "founders"), ("식품제조업 경영 안정 지원", None), ("보험업 경영 안정 지원", "line of business"), ("클라우드 이용 지원", "sector"), ("작업환경 개선 지원", None), ("식품 판로 개척 지원", None),
]
HUMAN = [
    (None, 0), ([], 0), ([" "], 0), (["휴·폐업 중인 기업 제외"], 0), (["허위 신청한 기업 제외"], 0), (["벤처기업 인증 보유"], 1), (["회생 기업"], 1), (["지원내용: 자세한"], 0), (["제출서류, 사업자등록증"], 1), (["체납 기업 제외(휴업 제외)"], 0), (["회생 중인 기업 중 개인정보 수집·이용 동의 불가 기업 제외"], 1), (["신용불량 기업 중 상장기업 제외"], 1),
]


def test_passes(spark):
    rows = [(i, *GYEONGGI, (k, v, n, raw, "pass", False, False)) for i, (k, v, n, raw, _) in enumerate(CASES)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, f"i int, {COMPANY}, c {strict.CHECK_TYPE}").select("i", strict.pass_fits(F.col("c")).alias("x")).collect()}
    wrong = [(CASES[i][:4], got[i]) for i in got if got[i] != CASES[i][4]]
    assert not wrong
    other = spark.createDataFrame([(*GYEONGGI, ("region", ["경기"], None, "아무 말", v, False, False)) for v in ("unknown", "fail")], f"{COMPANY}, c {strict.CHECK_TYPE}")
    assert [r.x for r in other.select(strict.pass_fits(F.col("c")).alias("x")).collect()] == [True, True]


def test_titles(spark):
    rows = spark.createDataFrame([(i, t, *GYEONGGI) for i, (t, _) in enumerate(TITLES)], f"i int, t string, {COMPANY}")
    none = F.lit(None)
    found = strict.block(F.col("t"), F.array().cast(f"array<{strict.CHECK_TYPE}>"), none.cast("array<string>"), F.lit(False), none.cast("string"), none.cast("string"), F.lit(False))
    got = {r.i: r.x for r in rows.select("i", found.alias("x")).collect()}
    assert not [(TITLES[i], got[i]) for i in got if got[i] != TITLES[i][1]]


def test_human_checks(spark):
    rows = spark.createDataFrame([(i, h, "지원 공고") for i, (h, _) in enumerate(HUMAN)] + [(99, ["체납 기업 제외"], "재기 지원")], "i int, h array<string>, t string")
    got = {r.i: r.n for r in rows.select("i", F.size(strict.substantive_checks(F.col("h"), F.col("t"))).alias("n")).collect()}
    assert got.pop(99) == 1 and not [(HUMAN[i], got[i]) for i in got if got[i] != HUMAN[i][1]]


@pytest.mark.parametrize(("verdicts", "blocked", "want"), [(["pass"], None, "fit"), (["pass", "unknown"], None, "unverified"), (["pass", "fail"], None, "excluded"), (["pass"], "place", "unverified"), ([], None, "unverified")])
def test_verdict(spark, verdicts, blocked, want):
    checks = [("employeeMin", None, 5.0, "상시근로자 5인 이상", v, False, False) for v in verdicts]
    row = spark.createDataFrame([(*GYEONGGI, checks, blocked)], f"{COMPANY}, c array<{strict.CHECK_TYPE}>, b string")
    assert row.select(strict.fit_verdict(F.col("c"), F.col("b")).alias("x")).first().x == want
    assert row.select(strict.fit_verdict(F.col("c")).alias("x")).first().x == (want if blocked is None else "fit")
