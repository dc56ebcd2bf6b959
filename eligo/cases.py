"""Queries of the text rules: every order takes one of a rule's sentences by its key, and the check has the values that were
worked out for the sentences by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.functions import amounts, classify, korean, notices, regions, sectors
from eligo.operators import extract, stored
from eligo.sources.bridge import now

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _literal(value, ddl: str) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(ddl)
    return F.lit(value).cast(ddl)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def by_distinct(rows: DataFrame, key: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what `found` gives for them (by `__told`, all of their columns but the key): equal ones are read once."""
    told = F.struct(*[x for x in rows.columns if x != key])
    own = rows.select(key, told.alias("__told"))
    once = found(own.select("__told").distinct().select("__told", "__told.*"))
    return own.join(once, "__told").select(key, *[x for x in once.columns if x != "__told"])


def cases(name: str, inputs: dict[str, str], outputs: dict[str, tuple[str, Callable[[], Column]]], rows: list[tuple[tuple, tuple]], before: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a query: inputs and outputs by name (type, and for outputs the expression), rows of (inputs, expected outputs)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        place = F.col("id") % len(rows)
        picked = [F.element_at(F.array(*[_literal(r[0][i], ddl) for r in rows]), place.cast("int") + 1).alias(c) for i, (c, ddl) in enumerate(inputs.items())]
        told = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id")).select("id", *picked)
        told = before(told) if before else told
        return by_distinct(told, "id", lambda rows: rows.select("__told", *[f().cast(ddl).alias(c) for c, (ddl, f) in outputs.items()]))

    run.__name__ = name
    types = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    picks = ", ".join(f"CAST(list_extract([{', '.join(_sql(r[1][i]) for r in rows)}], CAST(o_orderkey % {len(rows)} AS INTEGER) + 1) AS {types[ddl]}) AS {c}" for i, (c, (ddl, _)) in enumerate(outputs.items()))
    QUERIES[name], SQL[name] = run, f"SELECT o_orderkey AS id, {picks} FROM orders"


def one(name: str, ddl: str, expression: Callable[[Column], Column], rows: list[tuple], kind: str = "string") -> None:
    """A rule of one text with one value."""
    cases(name, {"x": kind}, {"value": (ddl, lambda: expression(F.col("x")))}, [((a,), (b,)) for a, b in rows])


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


c = F.col

# Places
one("canonical_regions", "string", regions.canonical_region, [("충청북도 청주시", "충북"), ("서울 특별시", "서울"), ("전남광주 통합", "광주"), ("수도권", None), ("", None), (None, None), ("제주특별자치도 서귀포", "제주"), ("경상남도", "경남")])
one("provinces_in_text", "string", lambda x: joined(regions.provinces_in(x)), [("대구경북 소재", "대구,경북"), ("전국", ""), (None, ""), ("경기도와 서울시, 강원특별자치도", "서울,경기,강원"), ("전라 남도", "전남"), ("전남광주", "광주,전남")])
one("foundation_provinces", "string", regions.foundation_province, [("경기신용보증재단", "경기"), ("지역신용보증재단", None), ("신용보증재단중앙회", None), ("서울 신용보증재단", "서울"), (None, None), ("충청남도신용보증재단", "충남")])
one("nationwide_lists", "boolean", regions.is_nationwide, [(["전국"], True), (["서울", "경기"], False), (["경기도 전국"], True), (["서울부산대구인천광주", "대전울산세종경기강원"], True), ([], False), (["서울부산대구인천광주", "대전울산세종경기"], False)], "array<string>")
one("district_lookup", "string", lambda x: F.concat_ws("/", regions.district_of(x)["name"], regions.district_of(x)["sido"], regions.district_of(x)["former"]), [("구미", "구미시/경북"), ("군위군", "군위군/대구/경북"), ("제주", ""), ("제주시", "제주시/제주"), ("서 귀포시", "서귀포시/제주"), ("없는시", ""), (None, "")])
cases("trusted_districts", {"region": "string", "district": "string"}, {"value": ("string", lambda: regions.trusted_district(c("region"), c("district")))}, [(("서울", "강남구"), ("강남구",)), (("부산", "강남구"), (None,)), ((None, "구미"), ("구미시",)), (("경북 군위군", "군위군"), ("군위군",)), (("대구", "군위군"), ("군위군",)), (("서울", None), (None,)), (("서울", "중구"), (None,))])
cases("named_districts", {"region": "string", "name": "string"}, {"value": ("boolean", lambda: regions.names_district(regions.place_words(c("region")), c("name")))}, [(("경북 구미시", "구미시"), (True,)), (("성남시 분당구 구미동", "구미시"), (False,)), (("강원영월군", "영월군"), (True,)), (("경북 구미", "구미시"), (True,)), (("제주 서귀포시", "제주시"), (False,)), (("남양주시", "양주시"), (False,)), ((None, "구미시"), (False,))])
one("regions_of_fields", "string", lambda x: joined(classify.regions_of_field(x)), [("서울, 경기도", "서울,경기"), ("전남광주", "전남,광주"), ("서울 및 부산광역시", "서울,부산"), ("청주시", ""), ("대구경북", ""), (None, ""), ("경기·서울·경기", "경기,서울")])
one("regions_of_orgs", "string", lambda x: joined(classify.regions_of_orgs(x)), [("강원신용보증재단, 전북신용보증재단", "강원,전북"), ("BNK경남은행", ""), ("지역신용보증재단", ""), ("경기 테크노파크", "경기"), ("충청북도기업진흥원", "충북"), ("", "")])
cases(
    "raw_prefilter",
    {"region": "string", "title": "string", "end": "timestamp_ntz", "mine": "string"},
    {"value": ("string", lambda: classify.prefilter(classify.bound_regions(c("region"), c("title")), c("end"), classify.own_region(c("mine")), now()))},
    [
        (("서울", "공고", None, "경기도"), ("drop-region",)),
        (("서울", "[경기] 공고", None, "경기도"), ("keep",)),
        (("전국", "공고", None, "경기도"), ("keep",)),
        (("", "[부산] 공고", None, "경기도 화성시"), ("drop-region",)),
        (("서울 부산 대구 인천", "공고", None, "경기도"), ("keep",)),
        (("서울", "공고", "1998-05-31 00:00:00", "서울"), ("drop-closed",)),
        (("서울", "공고", "1998-06-01 03:00:00", "서울"), ("keep",)),
        (("서울", "공고", None, None), ("keep",)),
        (("서울", "공고", None, "전국"), ("keep",)),
        (("대구경북", "공고", None, "경기"), ("keep",)),
    ],
)

# Sectors, organisations, sizes
one("sectors_of_industries", "string", lambda x: joined(sectors.sectors_of_industry(x)), [("소프트웨어 개발업", "정보통신"), ("인쇄회로기판 제조업", "반도체전자"), ("FITNESS 서비스업", ""), ("IT 서비스업", "정보통신"), ("비금속 광물", ""), ("서양식 음식점업", "식품"), ("제조업", ""), (None, ""), ("게임 소매업", "정보통신,콘텐츠,유통")])
one("sectors_of_titles", "string", lambda x: joined(sectors.sectors_in_title(x)), [("바이오기업 모집", "제약바이오"), ("식품외식 업체 지원", "식품"), ("산림분야 오픈이노베이션 참여기업", ""), ("그린바이오 기업지원사업", ""), ("AI 스타트업 육성", "정보통신"), ("MAI 기업", ""), (None, ""), ("섬유산업 기업 대상", "섬유패션")])
one("compound_sectors", "string", lambda x: F.array_join(F.transform(sectors.compounds_in(x), lambda r: F.concat(r["word"], F.lit(":"), F.array_join(r["sectors"], "+"))), ","), [("귀금속 제조업 전용", "귀금속:섬유패션"), ("인쇄회로기판", "인쇄회로:반도체전자"), ("비금속", "비금속:"), ("식품", ""), (None, "")])
one("org_types", "string", lambda x: joined(sectors.org_types_of(x)), [(["예비사회적기업 인증"], "사회적기업"), (["주식회사"], ""), (["마을기업", "협동조합"], "협동조합,마을기업"), ([], ""), (None, "")], "array<string>")
cases("corporations", {"bizno": "string", "flag": "boolean"}, {"value": ("boolean", lambda: sectors.corporation_of(c("bizno"), c("flag")))}, [(("123-81-00001", False), (True,)), (("1234500002", True), (False,)), (("123-90-00003", True), (True,)), (("123-90-00003", None), (None,)), ((None, False), (False,)), (("123-80-1", None), (None,)), (("123-88-00001", None), (True,)), (("123-79-00001", None), (False,))])
cases(
    "company_sizes",
    {"names": "array<string>", "revenue": "long", "employees": "long", "industry": "string", "age": "double", "corporation": "boolean"},
    {"value": ("string", lambda: sectors.size_verdict(c("names")))},
    [
        ((["소상공인"], 500_000_000, 3, "소매업", 2.0, False), ("pass",)),
        ((["소상공인"], 500_000_000, 7, "소매업", 2.0, False), ("fail",)),
        ((["소상공인"], 500_000_000, 7, "제조업", 2.0, False), ("pass",)),
        ((["소상공인"], None, 3, "소매업", 2.0, False), ("unknown",)),
        ((["소상공인"], 500_000_000, 7, None, 2.0, False), ("unknown",)),
        ((["소공인"], None, 9, "봉제업", None, None), ("pass",)),
        ((["소공인"], None, 9, "소매업", None, None), ("fail",)),
        ((["중소기업"], 40_000_000_001, 90, "제조업", 9.0, True), ("unknown",)),
        ((["중소기업", "중견기업"], 1, None, None, None, None), ("pass",)),
        ((["중견기업", "대기업"], 1, None, None, None, None), ("fail",)),
        ((["중기업"], 13_000_000_000, None, None, None, None), ("pass",)),
        ((["우선지원대상기업"], None, 100, None, None, None), ("pass",)),
        ((["창업기업"], None, None, None, 7.0, None), ("pass",)),
        ((["창업기업"], None, None, None, -1.0, None), ("unknown",)),
        ((["예비창업자"], None, None, None, 0.5, None), ("fail",)),
        ((["개인사업자"], None, None, None, None, True), ("fail",)),
        ((["소기업(소상공인)"], 900_000_000, None, None, None, None), ("pass",)),
        ((["모르는 이름"], 1, 1, "제조업", 1.0, True), ("unknown",)),
        (([], 1, 1, "제조업", 1.0, True), ("unknown",)),
    ],
)

# Money and rates
one("won_of_texts", "long", korean.won_of, [("최대 1억 2,000만원", 120_000_000), ("3천만 원", 30_000_000), ("1.5억원", 150_000_000), ("금액 없음", None), (None, None), ("5 백만", 5_000_000), ("1억5천", 100_005_000), ("0.00005만", 1)])
one("won_words", "string", korean.format_won, [(None, "—"), (0, "—"), (-5, "—"), (9_999, "9,999원"), (14_999, "1만원"), (15_000, "2만원"), (100_000_000, "1억원"), (123_450_000, "1억 2,345만원"), (199_999_999, "1억 9,999만원"), (1_200_000_000_000, "12,000억원")], "long")
cases(
    "rates_of_texts",
    {"x": "string"},
    {"text": ("string", lambda: korean.rate_of(c("x"))["text"]), "lowest": ("double", lambda: korean.rate_of(c("x"))["lowest"])},
    [
        (("운전자금 연 4.5%, 시설자금 연 2.0%",), ("연 2.0%", 2.0)),
        (("연 3.5%~5.5% 이내",), ("연 3.5%~5.5%", 3.5)),
        (("이자 2.5%p 지원",), ("이자 2.5%p 지원", None)),
        (("보증료 연 0.6%",), ("보증료 연 0.6%", None)),
        (("보증료 연 0.6%, 대출금리 연 3.5% 이내",), ("연 3.5%", 3.5)),
        (("금리 1.5%p 우대",), ("", None)),
        (("지원 없음",), ("", None)),
    ],
)
cases("lowest_rates", {"stored": "double", "texts": "array<string>"}, {"value": ("double", lambda: korean.lowest_rate(c("stored"), c("texts")))}, [((2.5, ["무이자"]), (2.5,)), ((0.0, ["연 0.00%~17.90%"]), (None,)), ((None, ["무이자", "제목"]), (0.0,)), ((0.0, ["무이자 지원 제외 대상"]), (None,)), ((0.0, ["무이자 지원 제외 대상", "이자 없음"]), (0.0,)), ((170.0, ["연리"]), (None,)), ((100.0, []), (100.0,))])
one("document_amounts", "long", korean.document_won, [("1억 2천", 120_000_000), ("1억 2천원", 100_002_000), ("5,000만원", 50_000_000), ("3천5백만", 35_000_000), ("899", None), ("0", 0), ("1,000,000", 1_000_000), ("999,999", None), ("약 12.5억", 1_250_000_000), ("만원", None), ("5백원", 500), ("모름", None), ("", None), ("1억2천300만원", 123_000_000)])
one("document_dates", "string", korean.document_date, [("2024년 3월 5일", "2024-03-05"), ("2024.03.05", "2024-03-05"), ("2024/3/5 10:00", "2024-03-05"), ("20240305", "2024-03-05"), ("20240230", None), ("45356", "2024-03-05"), ("899", None), ("9999", None), ("1899-01-01", None), ("어제", None), (None, None)])
one("date_texts", "string", korean.date_text, [("2026년 8월 1일", "2026-08-01"), ("2026.8.1 ~ 2026.12.31", "2026-08-01 ~ 2026-12-31"), ("2026/11/9", "2026-11-09"), ("2026-01-02", "2026-01-02"), ("12026.1.1", "12026.1.1"), ("상시", "상시")])
cases("period_days", {"x": "string"}, {"period_start": ("timestamp_ntz", lambda: korean.period_bounds(c("x"))[0]), "period_end": ("timestamp_ntz", lambda: korean.period_bounds(c("x"))[1])}, [(("20260801 ~ 2026-09-30",), ("2026-07-31 15:00:00", "2026-09-30 14:59:59")), (("상시",), (None, None)), (("20260231~20260301",), (None, "2026-03-01 14:59:59")), ((None,), (None, None)), (("접수 2026-01-02~2026-01-03까지",), ("2026-01-01 15:00:00", "2026-01-03 14:59:59")), (("~20260301",), (None, None))])
one("dedup_key_texts", "string", lambda x: korean.dedup_key_of(x, F.lit("A. B")), [("(Seoul) 자금·융자 – 1", "seoul자금융자1|ab"), ("「가」『나』〔다〕", "가나다|ab"), ("", "|ab"), ("A,B—C", "abc|ab")])

# Deadlines
NOWS = "1998-06-01 03:00:00"
cases(
    "announcement_deadlines",
    {"start": "timestamp_ntz", "end": "timestamp_ntz", "text": "string"},
    {"kind": ("string", lambda: c("d")["kind"]), "days": ("int", lambda: c("d")["d_day"]), "rank": ("int", lambda: korean.dead_rank(c("d"))), "is_open": ("boolean", lambda: korean.is_open(c("d"))), "due_today": ("boolean", lambda: korean.is_due_today(c("d")))},
    [
        (("1998-06-02 03:00:00", "1998-06-05 14:59:59", ""), ("upcoming", 1, 4, False, False)),
        (("1998-06-02 03:00:01", None, "상시"), ("upcoming", 2, 89_999, False, False)),
        (("1998-06-02 00:00:00", "1998-05-30 14:59:59", ""), ("upcoming", 1, 99_999, False, False)),
        (("1998-06-01 04:00:00", "1998-06-01 14:59:59", ""), ("upcoming", 1, 0, False, True)),
        ((None, "1998-06-01 14:59:59", ""), ("date", 0, 0, True, True)),
        (("1998-05-01 00:00:00", "1998-05-31 14:59:59", "상시"), ("date", -1, 99_999, False, False)),
        (("1998-05-01 00:00:00", "1998-06-30 14:59:59", "상시"), ("date", 29, 29, True, False)),
        ((None, None, None), ("unknown", None, 90_003, True, False)),
        ((None, None, "예산 소진 시까지"), ("budget", None, 90_001, True, False)),
        ((None, None, "연중 상시"), ("always", None, 90_000, True, False)),
        ((None, None, "추후 공지"), ("text", None, 90_002, True, False)),
        ((None, None, "예산이  소진되면 상시"), ("budget", None, 90_001, True, False)),
    ],
    before=lambda df: df.withColumn("d", korean.announcement_deadline(c("start"), c("end"), c("text"), now())),
)
cases(
    "product_deadlines",
    {"text": "string"},
    {"kind": ("string", lambda: c("d")["kind"]), "days": ("int", lambda: c("d")["d_day"])},
    [(("",), ("always", None)), ((None,), ("always", None)), (("자금 소진시",), ("budget", None)), (("기한 없음",), ("always", None)), (("1998.6.5까지",), ("date", 4)), (("1998-02-30 마감",), ("closed", None)), (("접수 종료",), ("closed", None)), (("문의",), ("text", None))],
    before=lambda df: df.withColumn("d", korean.product_deadline(c("text"), now())),
)

# Classification
cases("categories", {"title": "string", "summary": "string"}, {"value": ("string", lambda: classify.category_of(c("title"), c("summary"))), "place": ("int", lambda: classify.category_rank(classify.category_of(c("title"), c("summary"))))}, [(("기술개발자금 융자", ""), ("정책자금", 1)), (("청년 해외취업 연수", ""), ("고용·인력", 2)), (("벤처기업 확인", ""), ("인증제도", 5)), (("AI 실증", "테스트베드"), ("R&D·기술", 3)), (("해외 전시회", None), ("수출", 4)), (("보증금 환급", ""), ("무상지원금", 0)), (("공지", "요금"), ("기타", 6)), (("r&d 과제", ""), ("R&D·기술", 3))])
cases(
    "funding_groups",
    {"title": "string", "summary": "string", "agency": "string", "institution": "string", "category": "string", "rate": "string"},
    {"value": ("string", lambda: classify.funding_group_of(*map(c, ("title", "summary", "agency", "institution", "category", "rate"))))},
    [
        (("사업자 대출", "", "", "internet-bank", None, None), ("bank",)),
        (("투자유치 IR", "", "", None, None, None), ("invest",)),
        (("tips 운영사", "", "", None, None, None), ("invest",)),
        (("재도전 융자", "", "", None, None, None), ("urgent",)),
        (("특례보증 대출", "", "", None, None, None), ("guarantee",)),
        (("육성기금 안내", "", "", None, None, None), ("policy",)),
        (("시제품 지원사업", "", "", None, None, None), ("grant",)),
        (("시제품 지원사업", "", "", None, None, " 연 2.5%"), ("policy",)),
        (("공지", "", "", None, "수출", None), ("grant",)),
        (("공지", "", "", None, "기타", None), (None,)),
        (("안내", "", "신용보증기금", None, None, None), (None,)),
    ],
)
cases("category_domains", {"x": "string"}, {"domain": ("string", lambda: classify.domain_of(c("x"))["domain"]), "section": ("string", lambda: classify.domain_of(c("x"))["section"])}, [(("인력",), ("hr", "labor-subsidy")), (("기술",), ("cert", "cert")), ((" 금융 ",), ("policy-fund", "government-subsidy")), (("지식재산",), ("patent", "patent")), (("세액공제",), ("policy-fund", "tax-amendment")), ((None,), ("policy-fund", "government-subsidy")), (("인력 양성 훈련",), ("hr", "labor-subsidy"))])
cases("search_keywords", {"x": "array<string>"}, {"value": ("string", lambda: joined(classify.search_terms(c("x")))), "least": ("int", lambda: classify.least_score(classify.search_terms(c("x"))))}, [((["지원", " 수출 ", "바우처"],), ("수출,바우처", 2)), ((["기업", "5인 이상"],), ("5인 이상", 1)), ((["", "  "],), ("", 1)), ((["3년", "대상", "업력"],), ("3년,업력", 2))])
one("agency_regions", "string", classify.region_of_agency, [("경상북도 안동시", "경상북도 안동시"), ("고용노동부", ""), ("서울특별시", "서울특별시"), ("", ""), (None, ""), ("서울시 강남구", "서울시 강남구"), ("한국산업기술진흥원", "")])
cases("person_only", {"target": "string", "title": "string"}, {"value": ("boolean", lambda: classify.only_persons(c("target"), c("title")))}, [(("구직자 누구나", "취업지원 서비스"), (True,)), (("실업자를 채용한 사업주", "장려금"), (False,)), (("누구나", "안내"), (False,)), (("훈련생", "훈련비"), (True,))])
cases("estimated_titles", {"a": "string", "b": "string", "d": "string"}, {"value": ("string", lambda: classify.estimated_title(c("a"), c("b"), c("d")))}, [(("2024년도청년일자리지원사업을 안내", "", ""), ("청년일자리지원사업",)), (("지원금", "월 10만원 지급", ""), ("월 10만원 지급…",)), (("", "", ""), ("",)), (("고용유지장려금은 이렇습니다", "", ""), ("고용유지장려금",))])
cases("cut_titles", {"listed": "string", "detail": "string"}, {"cut": ("boolean", lambda: classify.is_cut_title(c("listed"))), "whole": ("string", lambda: classify.whole_title(c("listed"), c("detail")))}, [(("2026년 지원사업 …", "2026년  지원사업 모집 공고"), (True, "2026년 지원사업 모집 공고")), (("지원사업...", "다른 제목"), (True, None)), (("지원사업", "지원사업 공고"), (False, None)), (("...", "무엇"), (False, None)), (("가 나..", "가나"), (True, "가나"))])
cases(
    "document_kinds",
    {"text": "string", "file": "string"},
    {"value": ("string", lambda: classify.document_kind(c("text"), c("file")))},
    [
        (("사 업 자 등 록 증\n업태 종목", "a.pdf"), ("biz-registration",)),
        (("손익계산서 매출액 영업이익", "재무제표.xlsx"), ("financial-statement",)),
        (("부가가치세신고서 과세표준", "x.pdf"), ("vat-return",)),
        (("근로자이름 취득일", "고용.xlsx"), ("employment-insurance",)),
        (("기업상태표 업체명(법인은㈜) 개업년월일 사업장소재지", "x.xlsx"), ("company-status",)),
        (("안녕하세요", "x.txt"), ("unknown",)),
        (("사업자등록증 손익계산서", "x.txt"), ("unknown",)),
        (("", "사업자등록.pdf"), ("unknown",)),
    ],
)
cases("attachment_kinds", {"name": "string", "url": "string"}, {"value": ("string", lambda: classify.attachment_kind(c("name"), c("url")))}, [(("공고문.hwp", "https://x/fileDown.do"), ("hwp",)), (("첨부", "https://x/a/b.PDF?x=1"), ("pdf",)), (("", "https://x/down.do?f=%EA%B3%B5%EA%B3%A0.hwpx&y=2"), ("hwpx",)), (("사진.png", "https://x/y"), ("etc",)), ((None, None), ("etc",)), (("묶음.zip", ""), ("zip",))])

# Conditions from text
cases(
    "extracted_conditions",
    {"x": "string"},
    {"value": ("string", lambda: F.array_join(F.transform(extract.extract_conditions(c("x")), lambda k: F.concat(k["key"], F.lit("="), F.coalesce(F.array_join(k["values"], "+"), k["number"].cast("long").cast("string"), k["flag"].cast("string")), F.when(k["machine_readable"], "").otherwise("?"))), " "))},
    [
        (("업력 7년 이내 기업",), ("businessAgeMaxYears=7",)),
        (("창업 후 3년 미만인 자",), ("businessAgeMaxYears=2",)),
        (("업력 2년 이상",), ("businessAgeMinYears=2",)),
        (("상시 근로자 5인 이상 300명 미만",), ("employeeMin=5 employeeMax=299",)),
        (("매출액 1,000만 원 이하",), ("revenueMaxKrw=10000000",)),
        (("매출 3억원 이상",), ("revenueMinKrw=300000000",)),
        (("국세 체납 기업 제외",), ("noTaxDelinquency=true",)),
        (("예비창업자 모집",), ("companyScale=예비창업자?",)),
        (("중소기업, 소상공인",), ("companyScale=중소기업+소상공인",)),
        (("제조업 제외",), ("industry=제조업?",)),
        (("서울특별시 소재 기업",), ("region=서울",)),
        (("경기도 또는 강원도에 본사 위치",), ("region=경기+강원",)),
        (("",), ("",)),
        ((None,), ("",)),
        (("업력 7년 초과 기업은 제외하고 7년 이내",), ("businessAgeMaxYears=7?",)),
    ],
)

# Notices
one("no_programmes", "string", notices.no_programme, [("2024년 선정결과 공고", "지원사업 공고가 아닌 글"), ("신규 채용 인건비 지원", None), ("정규직 채용 공고", "지원사업 공고가 아닌 글"), ("심사위원 모집", "지원사업 공고가 아닌 글"), ("수행기관 모집", "운영기관·위원·강사 모집 글"), ("창업기업 지원사업 모집", None), ("접수 종료 안내(1차)", "지원사업 공고가 아닌 글"), ("모집 및 종료 안내", None), (None, None)])
cases(
    "loan_programmes",
    {"title": "string", "agency": "string"},
    {"kind": ("string", lambda: notices.loan_programme(c("title"), c("agency"))["kind"]), "guarantor": ("string", lambda: notices.loan_programme(c("title"), c("agency"))["guarantor"])},
    [
        (("전환보증 안내", "경기신용보증재단"), ("conversion", "경기신용보증재단")),
        (("업종전환보증", "신용보증기금"), (None, None)),
        (("보증 전환", "신보"), ("conversion", "신용보증기금")),
        (("보증 통합", "기술보증기금"), ("conversion", "기술보증기금")),
        (("전환 보증", ""), ("conversion", "지역신용보증재단")),
        (("저금리 대환대출", "은행"), ("refinance", None)),
        (("대환영 박람회", ""), (None, None)),
        (("안전망 전환대출", ""), ("refinance", None)),
    ],
)
one("guarantors", "string", lambda x: joined(notices.guarantors_in(x)), [("경기신용보증재단, 서울신보", "경기신용보증재단,서울신용보증재단"), ("재단 또는 신용보증기금", "지역신용보증재단,신용보증기금"), ("기보 이용", "기술보증기금"), ("기술혁신보증", ""), ("", "")])
cases(
    "copays",
    {"texts": "array<string>"},
    {"copay": ("boolean", lambda: notices.copay_of(c("texts"))["copay"]), "label": ("string", lambda: notices.copay_of(c("texts"))["label"])},
    [
        ((["자부담 30%", None],), (True, "자부담 30%")),
        ((["자부담금: 20% , 부가세 별도"],), (True, "자부담 20% · 부가세 고객 부담")),
        ((["총사업비의 70% 이내 지원"],), (True, "총사업비 70% 지원(자부담 30%)")),
        ((["매칭 자금 필요"],), (True, "자부담 있음(비율 원문 확인)")),
        ((["자부담 없음"],), (False, "자부담 없음")),
        ((["", None],), (False, "자부담 원문에 없음")),
        ((["무료 안내"],), (False, "자부담 원문에 없음")),
    ],
)
cases(
    "deadline_word_texts",
    {"start": "timestamp_ntz", "end": "timestamp_ntz", "text": "string"},
    {k: ("string", lambda k=k: notices.deadline_words(c("d"), c("end"), c("text"), now())[k]) for k in ("chip", "long", "tone")},
    [
        ((None, "1998-06-01 14:59:59", ""), ("오늘 마감", "오늘 마감", "red")),
        ((None, "1998-06-02 14:59:59", ""), ("내일(6월 2일) 마감", "내일(6월 2일) 마감", "red")),
        ((None, "1998-06-08 14:59:59", ""), ("7일 남음", "7일 남음 (6월 8일 마감)", "red")),
        ((None, "1998-06-09 14:59:59", ""), ("6월 9일 마감", "6월 9일 마감", "plain")),
        ((None, "1998-05-09 14:59:59", ""), ("마감됨", "마감됨", "plain")),
        (("1998-06-03 03:00:00", "1998-06-20 14:59:59", ""), ("접수 예정 · 마감 D-19", "2일 뒤 접수 시작 · 마감 D-19", "plain")),
        (("1998-06-03 03:00:00", None, ""), ("2일 뒤 접수 시작", "2일 뒤 접수 시작", "plain")),
        ((None, None, "상시"), ("상시 접수", "상시 접수", "green")),
        ((None, None, "예산 소진 시"), ("예산 소진 시 마감", "예산 소진 시 마감", "plain")),
        ((None, None, "추후 별도로 공지할 예정입니다"), ("추후 별도로 공지할 예정입…", "추후 별도로 공지할 예정입니다", "plain")),
        ((None, None, ""), ("기간 미기재", "기간 미기재", "plain")),
    ],
    before=lambda df: df.withColumn("d", korean.announcement_deadline(c("start"), c("end"), c("text"), now())),
)
one("percent_supports", "string", notices.percent_support, [("비용의 70% 이내 지원", "70% 이내 지원"), ("자부담 30% 지원", ""), ("금리 3.5% 이내", ""), ("80%  보조", "80% 보조"), ("없음", "")])
one("region_fields", "string", lambda x: joined(notices.region_from_field(x)), [("서울, 경기", "서울,경기"), ("전국", None), ("전국(서울 제외)", None), ("", None), ("수도권", None), (None, None)])
one("body_digests", "string", notices.body_digest, [("", "0:"), ("  ", "0:"), (None, "0:"), (" abc ", "3:ba7816bf8f01cfea")])
one("prompt_sizes", "boolean", lambda x: notices.fits_prompt(F.repeat(x, F.lit(51_968))), [("가", True), ("가a", False), ("a", True), (None, True)])

# Stored structures and profiles
_stored = '{"conditions": [%s], "humanCheck": ["직접 확인", " "]}'
cases(
    "stored_conditions",
    {"x": "string"},
    {
        "value": ("string", lambda: F.array_join(F.transform(c("s")["conditions"], lambda k: F.concat(k["key"], F.lit("="), F.coalesce(F.array_join(k["values"], "+"), k["number"].cast("long").cast("string"), k["flag"].cast("string"), F.lit("-")), F.when(k["machine_readable"], "").otherwise("?"))), " ")),
        "human": ("string", lambda: joined(c("s")["human"])),
    },
    [
        ((_stored % '{"key": "region", "op": "in", "value": ["서울", "경기"], "rawText": "수도권", "machineReadable": true}',), ("region=서울+경기", "직접 확인")),
        ((_stored % '{"key": "businessAgeMaxYears", "op": "gte", "value": 7, "rawText": "업력 7년", "machineReadable": true}',), ("businessAgeMaxYears=7?", "직접 확인,업력 7년")),
        ((_stored % '{"key": "businessAgeMaxYears", "op": "lte", "value": "7", "rawText": "업력", "machineReadable": true}',), ("", "직접 확인,업력")),
        ((_stored % '{"key": "isCorporation", "op": "eq", "value": true, "rawText": "법인", "machineReadable": true}, {"key": "other", "op": "eq", "value": true, "rawText": "기타", "machineReadable": true}',), ("isCorporation=true other=true?", "직접 확인")),
        ((_stored % '{"key": "region", "op": "in", "value": 3, "rawText": "x", "machineReadable": true}',), ("region=3?", "직접 확인")),
        ((_stored % '{"op": "in", "value": [], "rawText": ""}',), ("", "직접 확인,저장된 조건을 읽지 못함")),
        (("not json",), ("", "저장된 조건을 읽지 못함")),
        (('{"conditions": 3}',), ("", "저장된 조건을 읽지 못함")),
    ],
    before=lambda df: df.withColumn("s", stored.conditions_of(c("x"))),
)
cases("credit_scores", {"nice": "int", "kcb": "int"}, {"value": ("int", lambda: stored.credit_of(c("nice"), c("kcb")))}, [((800, 750), (750,)), ((299, 750), (750,)), ((None, 1001), (None,)), ((300, None), (300,))])
cases("certificates", {"kinds": "array<string>", "before": "boolean", "n": "int"}, {"certified": ("boolean", lambda: stored.has_certificate(c("kinds"), c("before"))), "some": ("boolean", lambda: stored.at_least_one(c("n"), c("before")))}, [((["없음"], True, 0), (False, False)), (([" ", "벤처"], None, 2), (True, True)), (([], True, -1), (True, True)), ((None, None, None), (None, None))])
cases("structure_choices", {"status": "string"}, {"value": ("string", lambda: stored.structure_choice(c("status"), F.lit("model"), F.lit("rules")))}, [(("done",), ("model",)), (("needs_review",), ("model",)), (("failed",), ("rules",)), ((None,), ("rules",))])

# Amounts of one company
one("largest_amounts", "long", amounts.largest_amount, [
    ("기업당 최대 5억원 지원", 500_000_000),
    ("최대 3천만원, 한도 1억 5천만원", 150_000_000),
    ("총 500억원 규모, 업체당 2억원", None),
    ("도내 연매출 3억원 이하 소상공인", None),
    ("매출액 10억원 이상 기업, 한도 1억원", 100_000_000),
    ("최대 300억원", None),
    ("사업자당 지원한도: 300억원", 30_000_000_000),
    ("사업자당 한도 5억: 한도 300억원", 500_000_000),
    ("사업자당 5억; 전체 한도 300억원", 500_000_000),
    ("예산 최대 5억원", None),
    ("5천만원", 50_000_000),
    ("70% 지원 (5천만원)", None),
    ("대출한도 1억원 이하", 100_000_000),
    ("최대 5억원까지 지원", 500_000_000),
    ("안내", None),
    (None, None),
])
one("title_region_conditions", "string", lambda x: F.array_join(F.transform(extract.title_regions(x, F.lit("경상북도")), lambda k: F.concat(F.array_join(k["values"], "+"), F.when(k["machine_readable"], "").otherwise("?"))), " "), [
    ("[경북] 영천시 소상공인 지원", "경북 영천시?"),
    ("[서울] 강남구 지원", "강남구?"),
    ("[경북] 지원사업", ""),
    ("[공고] 구미시 기업 지원", "구미시"),
    ("구미시 기업 지원", "구미시"),
    ("청주시 기업 지원", ""),
    ("전국 구미시 박람회", ""),
    ("구미시·영월군 공동", ""),
    ("구미시장 표창", ""),
    (None, ""),
])

# Conditions of a whole notice
_told = lambda array: F.array_join(F.transform(array, lambda k: F.concat(k["key"], F.lit("="), F.coalesce(F.array_join(k["values"], "+"), k["number"].cast("long").cast("string"), k["flag"].cast("string")), F.when(k["machine_readable"], "").otherwise("?"))), " ")
cases(
    "rule_structures",
    {"target": "string", "title": "string", "agency": "string"},
    {"value": ("string", lambda: _told(extract.rule_conditions(c("target"), F.lit(""), c("title"), c("agency"))))},
    [
        (("업력 7년 이내", "[경북] 지원사업", "경상북도"), ("businessAgeMaxYears=7",)),
        (("서울 소재 기업", "구미시 기업 지원", "경상북도"), ("region=서울",)),
        (("누구나", "구미시 기업 지원", "경상북도"), ("region=구미시",)),
        (("", "[경북] 구미시 로봇기업 모집", "경상북도"), ("region=경북 region=구미시? targetSector=기계금속",)),
        ((None, "", ""), ("",)),
    ],
)
cases(
    "augmented_conditions",
    {"target": "string", "title": "string", "agency": "string", "region": "string"},
    {"value": ("string", lambda: _told(extract.augmented(extract.extract_conditions(c("target")), c("title"), c("agency"), c("region"), True)))},
    [
        (("업력 3년 이내", "바이오기업 모집", "", "서울, 경기"), ("businessAgeMaxYears=3 region=서울+경기 targetSector=제약바이오",)),
        (("서울 소재 기업", "구미시 지원", "경상북도", "부산"), ("region=서울",)),
        (("", "구미시 지원", "경상북도", "부산"), ("region=구미시",)),
        (("", "전환보증 안내", "경기신용보증재단", "전국"), ("guaranteeInUse=경기신용보증재단",)),
        (("", "대환대출", "", ""), ("hasExistingLoan=true",)),
        (("부산 소재 아닌 기업", "지원", "", "서울"), ("region=부산?",)),
    ],
)
one("attachment_formats", "string", lambda x: notices.format_of(F.unhex(x)), [("255044462D312E37", "pdf"), ("D0CF11E0A1B11AE1", "hwp"), ("504B030414", "zip"), ("89504E470D0A1A0A00", "image"), ("524946460000000057454250", "image"), ("52494646000000004156", None), ("3C21444F43545950452068746D6C3E", "html"), ("20203C68746D6C3E", "html"), ("3C3F786D6C3F3E3C48574D4C3E", None), ("3C48575050", None), ("3C4857504D4C3E", "hml"), ("", None), (None, None)])
cases("same_documents", {"name": "string"}, {"key": ("string", lambda: notices.same_document(c("name"))["key"]), "rank": ("int", lambda: notices.same_document(c("name"))["rank"])}, [(("공고문.hwp",), ("공고문", 1)), (("공고문 .PDF",), ("공고문", 2)), (("A  B.hwpx",), ("a b", 0)), (("a.zip",), (None, None)), ((".hwp",), (None, None)), (("이름",), (None, None)), ((None,), (None, None))])
cases("schedule_percents", {"start": "timestamp_ntz", "end": "timestamp_ntz"}, {"value": ("int", lambda: notices.schedule_percent(c("start"), c("end"), now()))}, [(("1998-05-22 15:00:00", "1998-06-10 14:59:59"), (50,)), (("1998-05-31 15:00:00", "1998-06-01 14:59:59"), (100,)), (("1998-06-04 15:00:00", "1998-06-10 14:59:59"), (0,)), (("1998-01-01 15:00:00", "1998-02-01 14:59:59"), (100,)), ((None, "1998-02-01 14:59:59"), (None,)), (("1998-03-01 15:00:00", "1998-02-01 14:59:59"), (None,))])

# Rows, titles and cells
cases("title_deadlines", {"title": "string", "registered": "string"}, {"value": ("string", lambda: notices.title_deadline(c("title"), c("registered")))}, [(("모집(~26.9.30)", "2026-08-01"), ("2026-09-30",)), (("모집(~9.30)", "2026-08-01"), ("2026-09-30",)), (("모집(~1.15)", "2026-11-01"), ("2027-01-15",)), (("9월 30일(수)까지 접수", "2026-08-01"), ("2026-09-30",)), (("매출 ~10.5억", "2026-08-01"), ("",)), (("모집(~8.1)", "2026-08-02"), ("",)), (("모집(~9.30)", ""), ("",)), (("모집", "2026-08-01"), ("",))])
cases("row_periods", {"x": "string"}, {"period_start": ("timestamp_ntz", lambda: korean.row_period(c("x"))["start"]), "period_end": ("timestamp_ntz", lambda: korean.row_period(c("x"))["end"])}, [(("2026.8.1 ~ 2026.9.30",), ("2026-07-31 15:00:00", "2026-09-30 14:59:59")), (("2026.9.30",), (None, "2026-09-30 14:59:59")), (("2026.8.1 ~",), ("2026-07-31 15:00:00", None)), (("2026.8.1, 2026.9.1",), (None, None)), (("상시",), (None, None)), ((None,), (None, None))])
cases("same_conditions", {"a": "string", "b": "string"}, {"value": ("boolean", lambda: notices.same_condition(c("a"), c("b")))}, [(("업력 7년 이내", "업력7년이내."), (True,)), (("업력 7년 이내", "(대상) 업력 7년 이내 기업"), (True,)), (("서울", "서울 소재"), (False,)), (("", ""), (False,)), (("매출 10억", "업력 7년"), (False,))])
cases(
    "merged_condition_rows",
    {"x": "string"},
    {"value": ("string", lambda: F.array_join(F.transform(notices.merged_rows(c("checks"), c("told")), lambda r: F.concat_ws(":", r["text"], r["verdict"])), ","))},
    [
        (("업력7년이내:pass",), ("업력 7년 이내:pass,서울 소재:unknown",)),
        (("서울소재:fail",), ("업력 7년 이내:unknown,서울 소재:fail",)),
        (("매출 10억 이하:pass",), ("업력 7년 이내:unknown,서울 소재:unknown,매출 10억 이하:pass",)),
        (("서울소재:unknown",), ("업력 7년 이내:unknown,서울 소재:unknown",)),
    ],
    before=lambda df: df.select(
        "id",
        F.array(*[F.struct(F.lit(t).alias("text"), F.lit("unknown").alias("verdict")) for t in ("업력 7년 이내", "서울 소재")]).alias("checks"),
        F.array(F.struct(F.substring_index("x", ":", 1).alias("text"), F.substring_index("x", ":", -1).alias("verdict"))).alias("told"),
    ),
)
one("table_rows", "string", lambda x: F.array_join(notices.table_cells(x), "/"), [("a\tb,c", "a/b,c"), ("| a | b |", " a / b "), ('1,"2,3",4', "1/2,3/4"), ('"a ""b""",', 'a "b"/'), ("x", "x"), ("", ""), ("a,,b", "a//b")])
one("ordered_label_lists", "string", lambda x: joined(notices.ordered_labels(x)), [([" b ", "a", "b", ""], "b,a"), ([], ""), (["a"], "a")], "array<string>")
