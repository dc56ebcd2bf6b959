"""Sectors, kinds of organisation and sizes of companies, read from words."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.functions.regions import any_of, compact

#: Sector, words of announcements, words of companies, neighbours (which count in both directions).
SECTORS = {
    "식품": (
        ("식품", "농식품", "푸드테크", "외식", "밀키트", "음료"),
        ("식품", "음식", "외식", "음료", "제과", "제빵", "주류", "식료품"),
        ("농림어업", "유통", "제약바이오"),
    ),
    "농림어업": (
        ("수산", "어업", "농업", "농식품", "산림", "임업", "축산"),
        ("농업", "어업", "수산", "임업", "축산", "양식업", "양식장", "작물 재배", "작물재배", "재배업", "가축", "농가", "영농", "양계", "가금", "양돈", "낙농", "해조", "미세조류", "돼지", "한우", "젖소", "종돈", "양봉", "농민", "농작물", "농산물", "산림", "어선"),
        ("식품", "유통"),
    ),
    "제약바이오": (
        ("제약", "바이오", "의료기기", "의약품", "헬스케어"),
        ("제약", "바이오", "의약품", "의료기기", "헬스케어", "의료", "건강기능식품", "해양생명", "의약"),
        ("식품", "뷰티", "정보통신", "유통", "농림어업"),
    ),
    "정보통신": (
        ("소프트웨어", "SW", "ICT", "정보통신", "블록체인", "인공지능", "AI", "게임", "메타버스", "플랫폼"),
        ("소프트웨어", "정보통신", "정보처리", "컴퓨터", "게임", "플랫폼", "앱", "IT"),
        ("콘텐츠", "제약바이오", "반도체전자", "교육", "유통", "자동차"),
    ),
    "콘텐츠": (
        ("콘텐츠", "영상", "영화", "드라마", "방송", "웹툰", "애니메이션", "음악", "출판", "만화", "게임"),
        ("콘텐츠", "영상", "영화", "방송", "출판", "만화", "음악", "광고", "게임", "애니메이션", "캐릭터", "공연"),
        ("정보통신", "광고인쇄"),
    ),
    "뷰티": (
        ("뷰티", "화장품", "미용"),
        ("화장품", "미용", "뷰티"),
        ("제약바이오", "유통"),
    ),
    "섬유패션": (
        ("섬유", "패션", "의류"),
        ("섬유", "의류", "패션", "봉제", "양말", "니트", "편직", "직물", "방적", "방직", "원단", "귀금속", "장신구", "가죽"),
        ("유통", "광고인쇄", "기계금속"),
    ),
    "자동차": (
        ("자동차", "모빌리티"),
        ("자동차",),
        ("기계금속", "반도체전자", "정보통신"),
    ),
    "조선해양": (
        ("조선", "해양", "선박"),
        ("조선", "선박"),
        ("기계금속",),
    ),
    "반도체전자": (
        ("반도체", "디스플레이", "전자부품"),
        ("반도체", "디스플레이", "전자부품", "전자제품", "전자기기", "인쇄회로", "인쇄 회로", "회로기판"),
        ("정보통신", "기계금속", "자동차"),
    ),
    "기계금속": (
        ("기계", "로봇", "금속", "뿌리"),
        ("기계", "금속", "로봇", "절삭", "철판", "주조", "용접", "금형", "판금"),
        ("자동차", "조선해양", "반도체전자", "에너지환경", "건설"),
    ),
    "건설": (
        ("건설", "건축", "인테리어"),
        ("건설", "건축", "인테리어", "도배", "목공", "실내장식", "설비"),
        ("기계금속", "에너지환경"),
    ),
    "관광": (
        ("관광", "여행"),
        ("관광", "여행", "숙박", "호텔"),
        ("식품", "콘텐츠", "물류운수"),
    ),
    "유통": (
        ("도소매", "유통", "소매"),
        ("도매", "소매", "유통", "판매", "전자상거래"),
        ("식품", "섬유패션", "뷰티", "물류운수", "농림어업"),
    ),
    "광고인쇄": (
        ("광고", "인쇄"),
        ("광고", "인쇄", "디자인", "홍보물", "판촉물", "간판"),
        ("콘텐츠",),
    ),
    "에너지환경": (
        ("에너지", "환경", "신재생"),
        ("에너지", "환경", "태양광", "폐기물", "재활용", "발전업", "도시가스", "가스공급", "액화석유가스", "재생용", "전기판매", "분뇨"),
        ("기계금속", "건설", "유통"),
    ),
    "물류운수": (
        ("물류", "운수", "운송"),
        ("물류", "운수", "운송", "택배", "화물"),
        ("유통",),
    ),
    "교육": (
        ("교육",),
        ("교육", "학원"),
        ("정보통신", "콘텐츠"),
    ),
    "부동산임대": (
        ("부동산", "임대"),
        ("부동산", "임대"),
        ("건설",),
    ),
}
#: Longer words whose parts don't tell a sector.
COMPOUNDS = ("인쇄회로", "인쇄 회로", "비금속", "귀금속", "서양식", "한식양식", "일식양식", "일양식", "중식양식")
#: Kinds of organisation, and the words of a company's own description that tell them.
ORG_TYPES = {
    "사회적기업": ("사회적기업", "예비사회적기업"),
    "사회적경제": ("사회적경제",),
    "협동조합": ("협동조합",),
    "마을기업": ("마을기업",),
    "자활기업": ("자활기업",),
    "소셜벤처": ("소셜벤처",),
    "착한가격업소": ("착한가격업소",),
    "예비창업자": ("예비창업자",),
}
#: Thresholds of company sizes, in won, workers and years.
SMALL_REVENUE, SMALL_REVENUE_TOP = 1_000_000_000, 12_000_000_000
SME_REVENUE, SME_REVENUE_TOP = 40_000_000_000, 150_000_000_000
PRIORITY_WORKERS, STARTUP_YEARS = 100, 7
TEN_WORKERS = ("제조", "가공", "봉제", "광업", "건설", "운수", "운송", "화물")
MAKERS = ("제조", "가공", "봉제")


def neighbours(sector: str) -> set[str]:
    own = set(SECTORS[sector][2]) | {s for s, row in SECTORS.items() if sector in row[2]}
    return own | {sector}


def neighbour_table() -> Column:
    """Each sector's neighbours and itself, as one literal."""
    return F.from_json(F.lit(json.dumps({s: sorted(neighbours(s)) for s in SECTORS}, ensure_ascii=False)), "map<string,array<string>>")


def words_of(words) -> Column:
    """An array of fixed words, as one literal."""
    return F.split(F.lit("\n".join(words)), "\n")


def masked(text: Column) -> Column:
    """The text with compounds blanked out, in their order."""
    return F.aggregate(words_of(COMPOUNDS), text, lambda t, w: F.replace(t, w, F.lit(" ")))


def _any_word(words) -> str:
    """A pattern of words, those of Latin letters as whole words."""
    return "|".join(f"(?<![A-Za-z]){w}(?![A-Za-z])" if w.isascii() else w for w in words)


def sectors_of_industry(industry: Column) -> Column:
    """Sectors that a company's line of business tells, in the order of SECTORS. Compounds are blanked out once, and each
    sector's words are one pattern."""
    def of(raw: Column, bare: Column) -> Column:
        found = []
        for sector, (_, words, _) in SECTORS.items():
            plain, compound = [w for w in words if w not in COMPOUNDS], [w for w in words if w in COMPOUNDS]
            tests = [text.rlike(_any_word(own)) for text, own in ((bare, plain), (raw, compound)) if own]
            found.append(F.when(tests[0] | tests[1] if len(tests) > 1 else tests[0], F.lit(sector)))
        return F.array_compact(F.array(*found))

    raw = F.coalesce(industry, F.lit(""))
    texts = F.array(F.struct(raw.alias("raw"), masked(raw).alias("bare")))
    return F.get(F.transform(texts, lambda t: of(t["raw"], t["bare"])), F.lit(0))


def compounds_in(text: Column) -> Column:
    """Compounds that a text holds, and the sectors that have them as a word of their own."""
    hit = lambda c: [s for s, (a, b, _) in SECTORS.items() if c in a or c in b]
    raw = F.coalesce(text, F.lit(""))
    rows = [F.when(raw.contains(c), F.struct(F.lit(c).alias("word"), F.array(*[F.lit(s) for s in hit(c)]).cast("array<string>").alias("sectors"))) for c in COMPOUNDS]
    return F.array_compact(F.array(*rows))


def sectors_in_title(title: Column) -> Column:
    """Sectors that a title names as its audience: a word, more such words perhaps, then "companies" or the like."""
    every = sorted({w for a, _, _ in SECTORS.values() for w in a}, key=lambda w: (-len(w), w))
    more = "(?:\\s*(?:" + "|".join(every) + "))*"
    audience = "(?:분야|산업|업종)?\\s*(?:기업체|스타트업|제조사|기업|업체|업소)(?![가-힣])"
    word = lambda w: (f"(?<![A-Za-z0-9]){w}" if w[0].isascii() else w)
    raw = F.coalesce(title, F.lit(""))
    return F.array_compact(F.array(*[F.when(raw.rlike(f"(?:{'|'.join(map(word, a))}){more}{audience}"), F.lit(s)) for s, (a, _, _) in SECTORS.items()]))


def org_types_of(forms: Column) -> Column:
    """Kinds of organisation among a company's own descriptions; empty where there is none."""
    own = F.coalesce(forms, F.array().cast("array<string>"))
    tells = lambda words: F.exists(own, lambda v: any_of(v, words))
    return F.array_compact(F.array(*[F.when(tells(words), F.lit(t)) for t, words in ORG_TYPES.items()]))


def corporation_of(bizno: Column, flag: Column) -> Column:
    """The fourth and fifth digit of a business number, 81-88 a corporation, 01-79 a person; else the flag."""
    digits = F.regexp_replace(F.coalesce(bizno, F.lit("")), "[^0-9]", "")
    middle = F.when(F.length(digits) == 10, F.substring(digits, 4, 2).cast("int"))
    return F.coalesce(F.when(middle.between(81, 88), True).when(middle.between(1, 79), False), flag)


def age_years(founded: Column, now: Column) -> Column:
    """Years of 365.25 days from the founding date to now, with fractions; negative for a date to come."""
    return (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(founded.cast("timestamp"))) / (365.25 * 86_400)


def _within(revenue: Column, sure: int, top: int) -> Column:
    return F.when(revenue <= sure, "yes").when(revenue > top, "no").otherwise("unknown")


def _both(a: Column, b: Column) -> Column:
    return F.when((a == "no") | (b == "no"), "no").when((a == "yes") & (b == "yes"), "yes").otherwise("unknown")


def few_workers() -> Column:
    """yes, no or unknown: has the row's company (employees, industry) fewer workers than a small merchant may have?"""
    workers, industry = F.col("employees"), F.trim(F.coalesce("industry", F.lit("")))
    few = F.when(any_of(industry, TEN_WORKERS), 10).otherwise(5)
    return F.when(workers.isNull(), "unknown").when(industry != "", F.when(workers < few, "yes").otherwise("no")).when(workers < 5, "yes").when(workers >= 10, "no").otherwise("unknown")


def _size_fact(name: Column) -> Column:
    """Of one name without brackets: yes, no, unknown, or null for a name that isn't a size."""
    revenue, workers, age, corporation = F.col("revenue"), F.col("employees"), F.col("age"), F.col("corporation")
    industry = F.trim(F.coalesce("industry", F.lit("")))
    by_workers = few_workers()
    small, sme = _within(revenue, SMALL_REVENUE, SMALL_REVENUE_TOP), _within(revenue, SME_REVENUE, SME_REVENUE_TOP)
    maker = F.when((industry == "") | workers.isNull(), "unknown").when(~any_of(industry, MAKERS), "no").when(workers < 10, "yes").otherwise("no")
    return (
        F.when(name.isin("소상공인", "소상공인기업"), _both(by_workers, small))
        .when(name.isin("소공인", "도시형소공인"), maker)
        .when(name == "소기업", small)
        .when(name.isin("중소기업", "중소기업자"), sme)
        .when(name == "중기업", F.when((small == "yes") | (sme == "no"), "no").when((sme == "yes") & (small == "no"), "yes").otherwise("unknown"))
        .when(name == "우선지원대상기업", F.when((sme == "yes") | F.coalesce(workers <= PRIORITY_WORKERS, F.lit(False)), "yes").otherwise("unknown"))
        .when(name.isin("중견기업", "초기중견기업", "대기업"), F.when(sme == "yes", "no").otherwise("unknown"))
        .when(name.isin("창업기업", "스타트업", "초기창업기업"), F.when(age.isNull() | (age < 0), "unknown").when(age <= STARTUP_YEARS, "yes").otherwise("no"))
        .when(name == "예비창업자", F.when(age > 0, "no").otherwise("unknown"))
        .when(name.isin("개인", "개인사업자", "자영업자"), F.when(corporation.isNull(), "unknown").when(corporation, "no").otherwise("yes"))
    )


def size_fact(name: Column) -> Column:
    """yes, no or unknown: is the row's company (revenue, employees, industry, age, corporation) of that size? Null for a name
    that isn't a size. "A(B)" holds where A or B does."""
    own = compact(name)
    two = r"^([^()（）]+)[(（]([^()（）]+)[)）]$"
    parts = F.array_compact(F.array(_size_fact(F.regexp_extract(own, two, 1)), _size_fact(F.regexp_extract(own, two, 2))))
    either = F.when(F.size(parts) == 0, None).when(F.array_contains(parts, "yes"), "yes").when(F.forall(parts, lambda x: x == "no"), "no").otherwise("unknown")
    return F.when(own.rlike(two), either).otherwise(_size_fact(own))


def size_verdict(names: Column) -> Column:
    """pass where one of the sizes holds, fail where all don't, else unknown."""
    facts = F.transform(names, lambda n: F.coalesce(size_fact(n), F.lit("unknown")))
    return F.when(F.array_contains(facts, "yes"), "pass").when((F.size(facts) > 0) & F.forall(facts, lambda x: x == "no"), "fail").otherwise("unknown")
