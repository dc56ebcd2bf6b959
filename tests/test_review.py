"""The staged review against judgements worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from eligo.functions import requirements
from eligo.operators import review

COMPANY = "company_id long, sido string, own_district string, industry string, revenue long, employees long, age double, founded date, corporation boolean, bizno string, tax_delinquent boolean, scale string, sectors array<string>"
KIM = (1, "경기", "화성시", "식품 제조업", 500_000_000, 7, 5.0, dt.date(2019, 6, 1), True, "1238100001", False, "중소기업", ["식품"])
BLANK = (2, *[None] * 11, [])
SENTENCES = [
    (None, "ignore", ""), ("", "ignore", ""),
    ("단, 비영리 기관 및 공기업(공사)은 적용하지 않음", "ignore", ""),
    ("집적지 내 또는 인근 소공인", "check", "집적지 근처 인정 여부 확인"),
    ("대표자가 만 39세 이하인 자", "check", "대표자 만 39세 이하"),
    ("만 34세 이하 청년을 채용한 기업", "check", "직원 나이 조건(만 34세 이하)"),
    ("청년 창업자", "check", "대표자 청년(만 39세 이하) 여부"),
    ("기 수혜 기업 제외", "check", "지원 이력(같은 사업 수혜 여부)"),
    ("법인 제외", "fail", "법인 제외"), ("법인사업자에 한함", "check", "조건 확인: 법인사업자에 한함"), ("개인사업자만 신청", "fail", "개인사업자만"),
    ("국세·지방세 체납 기업은 제외", "ignore", ""),
    ("식품 제조업을 영위하는 업종 제외", "check", "제외 업종 해당 여부"),
    ("경기도 소재 기업 제외", "check", "지역 제외 조건 확인"),
    ("카드 매출이 없는 곳 제외", "check", "카드 매출 여부"),
    ("수익이 나지 않은 기업", "check", "제외 조건: 수익이 나지 않은 기업"),
    ("부산광역시에 본사를 둔 기업", "fail", "다른 지역 대상(부산)"),
    ("부산광역시에 본사를 두거나 또는 이전할 기업", "check", "지역 조건 확인"),
    ("수도권 외 지역에 소재한 기업", "fail", "다른 지역 대상(서울·경기·인천 밖)"),
    ("서울 외 지역에 소재한 기업", "check", "지역 조건 확인"),
    ("경기도 화성시 소재 기업", "pass", ""), ("수도권 소재 기업", "pass", ""),
    ("개업일이 2020년 1월 1일 이전인 자", "pass", ""), ("설립일 2018년 1월 1일 이전", "fail", "개업일 조건(설립일 2018년 1월 1일 이전)"),
    ("업력 7년 이내", "pass", ""), ("업력 3년 이상 7년 이하", "pass", ""), ("업력 3년 이내 또는 재창업", "check", "업력 3년 이내 또는 다른 기준"), ("업력 1년 이상 3년 미만", "fail", "업력 1년 이상 3년 미만"),
    ("상시근로자 5인 이상 50인 미만", "pass", ""), ("상시 근로자 10명 이상", "fail", "상시근로자 10명 이상"),
    ("상시근로자 제조업 10명, 그 밖 5명 미만", "pass", ""),
    ("소상공인", "pass", ""), ("중견기업", "fail", "대상: 중견기업"),
    ("소상공인시장진흥공단에 문의 바람", "check", "기관 문의"),
    ("고용보험에 가입한 사업장", "pass", ""), ("정상 영업 중인 사업자", "pass", ""), ("사업자등록증을 보유한 자", "pass", ""),
    ("파산·회생절차 개시", "ignore", ""),
    ("기업부설연구소 보유", "check", "R&D 수행 요건(연구소·연구 인력)"), ("벤처기업 확인", "check", "벤처기업 해당 여부"),
    ("경기도", "pass", ""), ("서울대학교 창업센터", "check", "조건 확인: 서울대학교 창업센터"), ("부산", "check", "지역 조건 확인"),
    ("신청서를 제출할 것", "ignore", ""), ("1. 꿈이 있는 곳", "check", "조건 확인: 꿈이 있는 곳"),
]


def test_sentences(spark):
    rows = spark.createDataFrame([(i, t, *KIM) for i, (t, _, _) in enumerate(SENTENCES)], f"i int, t string, {COMPANY}")
    got = {r.i: (r.j.kind, r.j.label) for r in rows.select("i", requirements.judged(F.col("t")).alias("j")).collect()}
    assert not [(SENTENCES[i], got[i]) for i in got if got[i] != SENTENCES[i][1:]]


def test_of_an_unknown_company(spark):
    texts = ["업력 7년 이내", "상시근로자 5인 이상", "법인만 신청", "부산 소재 기업", "사업자등록증을 보유한 자", "체납 기업 제외"]
    rows = spark.createDataFrame([(i, t, *BLANK) for i, t in enumerate(texts)], f"i int, t string, {COMPANY}")
    got = [r.j.label for r in rows.orderBy("i").select(requirements.judged(F.col("t")).alias("j")).collect()]
    assert got == ["설립일 입력", "직원 수 입력", "법인·개인 구분 확인", "소재지 확인", "사업자 등록 여부", ""]
    late = spark.createDataFrame([("국세 체납이 없을 것", *KIM[:10], True, *KIM[11:])], f"t string, {COMPANY}")
    assert late.select(requirements.judged(F.col("t")).alias("j")).first().j.kind == "obstacle"


PAIR = f"id long, company_id long, title string, funding_group string, own_share boolean, is_announcement boolean, rule_only boolean, industry_scope string, region_scope string, checks array<{review.CHECK_TYPE}>, human array<string>"


def check(key, values, raw, verdict, bars=False, augmented=False, note="", negated=False):
    return (key, values, raw, verdict, bars, augmented, note, negated)


AGE = check("businessAgeMaxYears", None, "업력 7년 이내", "pass")
PAIRS = [
    (("지원", [AGE], []), ("fit", 1, None, [], [])),
    (("지원", [AGE], ["업력 7년 이내", "벤처기업 확인"]), ("unverified", 5, None, ["벤처기업 해당 여부"], [])),
    (("2026년 선정결과 안내", [AGE], []), ("excluded", None, "지원사업 공고가 아닌 글", [], [])),
    (("지원", [AGE, check("noTaxDelinquency", None, "체납", "fail")], []), ("unverified", 4, None, [], ["체납 정리 필요"])),
    (("지원", [AGE, check("region", ["부산"], "부산 소재", "fail")], []), ("excluded", None, "다른 지역 공고(부산)", [], [])),
    (("지원", [check("region", ["전국"], "전국", "pass")], []), ("unverified", 5, None, ["자격 조건 원문 확인"], [])),
    (("[부산] 지원", [AGE], []), ("excluded", None, "다른 지역 공고(제목)", [], [])),
    (("예비창업자 지원", [AGE], []), ("excluded", None, "예비창업자 대상 공고", [], [])),
    (("로봇기업 지원", [AGE], []), ("unverified", 5, None, ["업종 해당 여부(기계금속)"], [])),
    (("지원", [AGE, check("other", None, "상시 근로자 10명 이상", "unknown")], []), ("excluded", None, "상시근로자 10명 이상", [], [])),
    (("지원", [AGE, check("industry", ["의료기기"], "의료기기 기업", "unknown")], ["집적지"]), ("excluded", None, None, None, [])),
    (("융자 지원", [AGE], []), ("fit", 3, None, [], [])),
    ((None, None, None), ("unverified", 5, None, ["자격 조건 원문 확인"], [])),
]


def test_stages(spark):
    firms = spark.createDataFrame([KIM, BLANK], COMPANY)
    rows = spark.createDataFrame([(i, 1, t, "grant", False, True, False, "all", "all", c, h) for i, ((t, c, h), _) in enumerate(PAIRS)], PAIR)
    found = review.findings(rows, firms)
    assert review.verdicts(rows.limit(0), found.limit(0)).count() == 0
    got = {r.id: (r.verdict, r.step, r.reason, r.to_check, r.obstacles) for r in review.verdicts(rows, found).collect()}
    wrong = [(PAIRS[i], got[i]) for i in got if any(w is not None and g != w for g, w in zip(got[i], PAIRS[i][1], strict=True)) and i != 10]
    assert len(got) == len(PAIRS) and not wrong


def test_scopes(spark):
    firms = spark.createDataFrame([KIM], COMPANY)
    rows = spark.createDataFrame([(1, 1, "지원", "grant", True, True, False, None, None, [AGE], []), (2, 1, "지원", "grant", True, True, False, "restricted", "restricted", [AGE], []), (3, 1, "지원", "loan", True, False, False, None, None, [AGE], []), (4, 1, "지원", "grant", True, True, True, None, None, [AGE], []), (5, 1, "지원", "grant", True, True, False, "all", "all", [AGE], [])], PAIR)
    got = {r.id: (r.verdict, r.step, r.to_check) for r in review.verdicts(rows, review.findings(rows, firms)).collect()}
    assert got == {1: ("unverified", 5, [review.INDUSTRY_UNKNOWN, review.REGION_UNKNOWN]), 2: ("unverified", 5, ["업종 제한 확인", "지역 제한 확인"]), 3: ("fit", 3, []), 4: ("unverified", 5, [review.BEFORE_READING]), 5: ("fit", 2, [])}
