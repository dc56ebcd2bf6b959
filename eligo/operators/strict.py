"""Strict fit: a pass makes a fit only where nothing is left over of the text that it was read from, and nothing about the
announcement speaks against it. Failing rules never exclude anybody; they turn a fit into "unverified".

What a condition explains of its text is taken out of it as spans: its value, its numbers, the words that belong to its kind.
What stays is the residue, and a residue means that the text asks for something that nobody has checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo.functions import notices, regions, sectors
from eligo.functions.regions import NATIONWIDE, PROVINCES, canonical_region, compact, district_of, provinces_in
from eligo.sources.held import told_once

#: Words that may stay of a region's text, and of any other condition's text; particles; separators.
REGION_FILLER = "소재|소재한|소재지|위치한|관내|내|지역|지역의|기업|업체|주소지|에|의|을|를|이|가|은|는|둔|있는|두고|등|전국|도|시|군|구|특별시|광역시|특별자치시|특별자치도"
FILLER = "수|기준|후|이내|이하|이상|경과|된|한|인|기업|업체|소재|해당|해당하는|대상|가능|등|일|현재|기업으로|기업만"
KEY_FILLER = {
    ("businessAgeMaxYears", "businessAgeMinYears"): "업력|창업|설립|개업",
    ("employeeMax", "employeeMin"): "상시|상시근로자|근로자|종업원|직원",
    ("revenueMaxKrw", "revenueMinKrw"): "매출|매출액|연매출|연간",
    ("creditScoreMin", "creditScoreMax"): "신용|신용점수|신용평점|점수|평점",
    ("guaranteeInUse",): "지역|신용보증재단|보증|보증부|대출|이용|중|전환보증",
    ("hasExistingLoan",): "기존|대출|이용|중|대환",
}
NUMBER_WORD = r"[0-9][0-9.,]*(?:명|인|억|억원|천만원|백만원|만원|원|년|개월|개|%|세|배|시간|일)?(?:이하|이상|미만|초과|이내)?"
PARTICLE = r"(?:으로|에서|에게|까지|부터|이며|이고|은|는|이|가|을|를|의|에|로|와|과|도|만)$"
SEPARATORS, REGION_SEPARATORS = r"(?U)[\s,·ㆍ()（）\[\]/:：\"'「」~\-]+", r"(?U)[\s,·ㆍ()（）\[\]/:：\"'「」]+"
#: A number with its units, and by kind of condition the word and the unit that it needs, and words that it can't have.
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(억|천만|백만|만)?\s*(원|명|인|년|개월|점|%)?"
UNITS = {"억": 1e8, "천만": 1e7, "백만": 1e6, "만": 1e4}
MEASURES = {"businessAge": ("업력|창업|설립|개업", None, ("년",)), "employee": ("근로자|종업원|직원", "신청|참여|교육|채용", ("명", "인")), "revenue": ("매출", None, ("원",)), "creditScore": ("신용", None, ("점", ""))}
UP_TO, AT_LEAST, OPEN_END = "이하|이내|까지", "이상", "미만|초과"
#: What may follow a line of business, names that several districts share, and wordings of provinces.
INDUSTRY_TAIL = "^(?:|업|업체|업종|산업|기업|분야|제조|제조업|가공업|도매업|소매업|도소매업|판매업|유통업|서비스|서비스업|생산업|개발업|공급업|[A-Za-z0-9]*)$"
SHARED_DISTRICTS = ("중구", "동구", "서구", "남구", "북구", "강서구", "광주시", "고성군")
PROVINCE_WORD = r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충청북|충청남|충북|충남|전라북|전라남|전북|전남|경상북|경상남|경북|경남|제주)(?:특별자치도|특별자치시|특별시|광역시|도)?"
AFTER_DISTRICT = "에서|에|의|은|는|이|가|을|를|과|와|으로|로|소재|지역|내|관내"
FIELD_PREFIX = r"^\[공고 지역 칸\]"
#: people's checks that hardly anybody fails, states that may be the audience, and notes that ask for nothing.
MORAL = r"허위|부정한\s*방법|부정\s*수급|이해\s*관계|중복\s*(?:지원|수혜|신청)|불건전|사행|유흥|적정하지\s*않다고|지원\s*결정\s*후|관외\s*이전|환수|보증\s*심사\s*규정|사치|향락|투기|퇴폐|무신고|횡령|결격|사회적\s*물의"
STATE = r"휴\s*[·ㆍ.,]?\s*폐업|폐업|휴업|체납|부도|신용\s*불량|연체|채무\s*불이행|파산|회생|영업\s*정지|행정\s*처분|제재|참여\s*제한"
LISTED, EXCLUDING = r"상장\s*(?:기업|법인|회사)", "제외|불가|배제"
DISTRESS = r"영업\s*정지|행정\s*처분|폐업|휴업|사업\s*정리|재기|재도전|재창업|희망\s*리턴|채무\s*조정|신용\s*회복|회생|파산|연체|부도|체납|원상\s*복구|점포\s*철거"
NOTE = r"지원\s*내용|지원\s*규모|지원\s*금액|지원\s*한도|제출\s*서류|구비\s*서류|신청\s*방법|접수\s*방법|문의|개인정보|수집\s*·?\s*이용\s*동의|신청서|서식"
NARROWING = r"한\s*하여|한\s*함|한정|에\s*한|만\s|만$|전용|대상|이상|이하|초과|미만|[0-9]"
CHECK_FILLER = "현재|기업|업체|기업의|기업이|기업인|기업은|업체는|중인|중|상태|상태의|상태인|인|경우|또는|나|및|등|등이|으로|방법으로|신청한|국세|지방세|제외|지원제외|대표자|자|자인|은|는|이|가|의|불가|배제"
NOTE_FILLER = "자세한|세부|상세|공고문|참조"
#: Titles for founders only, words of means that aren't sectors, and what makes them means.
FOUNDERS_ONLY, FOUNDER = r"예비\s*창업|재\s*창업|재도전", "예비창업자"
MEANS = (
    "작업환경", "작업 환경", "근무환경", "근무 환경", "경영환경", "경영 환경", "근로환경", "창업환경", "창업 환경",
    "임대료", "임차료", "교육훈련", "직무교육", "창업교육", "경영교육", "교육비", "광고비", "온라인 광고", "온라인광고",
    "판로", "판매망", "판매 촉진", "판매촉진", "홍보물", "기계설비", "설비 도입", "설비도입", "시설 설비", "디자인 개발",
    "플랫폼 입점", "전자상거래 입점",
)
MEANS_TAIL = r"(?=\s*(?:개선|지원|비용|비|도입|구축|확충|활용|개척|확대|진출|조성)(?:사업|을|를|이|및)?(?![가-힣]))"
INDUSTRY_WORD = r"[가-힣]+?(?:업종|업체|업)(?=$|[^가-힣]|(?:을|를|이|가|은|는|의|에|과|와|도|으로|로|에서|만)(?:$|[^가-힣]))"
NO_INDUSTRY = r"(?:기업|사업|창업|산업|작업|영업|협업|직업|실업|졸업|분업|수업|개업|폐업|휴업|취업|학업|과업|잔업|스타트업)$|^(?:업|조업|성업)$"
#: Further words of a title's sectors.
TITLE_SECTORS = {
    "제약바이오": "의료|치매|바이오|제약|의약|헬스케어|신약|백신|진단기기|의료기기",
    "정보통신": r"정보\s*통신|정보\s*기술|빅\s*데이터|소프트웨어|(?<![A-Za-z])SW(?![A-Za-z])|(?<![A-Za-z])IT(?![A-Za-z])|ICT|인공지능|(?<![A-Za-z])AI(?![A-Za-z])|블록체인|메타버스|클라우드|사이버\s*보안|정보보호",
    "반도체전자": "반도체|디스플레이|전자부품",
    "기계금속": r"로봇|금속|뿌리\s*산업|소부장|소재\s*·?\s*부품|기계\s*산업",
    "에너지환경": r"에너지|신재생|탄소\s*중립|수소|이차\s*전지|배터리",
    "자동차": "자동차|모빌리티|전기차",
    "조선해양": "조선|선박|해양",
    "콘텐츠": "콘텐츠|영상|영화|웹툰|애니메이션|게임|음악|출판|방송",
    "식품": "식품|푸드|외식|밀키트",
    "농림어업": r"농업|어업|수산|축산|임업|산림|스마트\s*팜",
    "뷰티": "화장품|뷰티",
    "섬유패션": "섬유|패션|의류",
    "관광": "관광|여행",
    "건설": "건설|건축",
    "물류운수": "물류|운송|운수",
}
CHECK_TYPE = "struct<key:string,values:array<string>,number:double,raw_text:string,verdict:string,bars:boolean,augmented:boolean>"


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, separators), lambda w: w != "")


def _blank(text: Column, words: Column) -> Column:
    """The text without the words' spans."""
    return F.aggregate(F.coalesce(words, F.array().cast("array<string>")), text, lambda t, w: F.replace(t, w, F.lit(" ")))


def residue(c: Column) -> Column:
    """The words of a condition's text that its value, numbers and kind don't explain."""
    of_kind = F.coalesce(*[F.when(c["key"].isin(*keys), F.lit(f"|{words}")) for keys, words in KEY_FILLER.items()], F.lit(""))
    known = F.concat(F.lit(f"^(?:{FILLER}|{NUMBER_WORD}"), of_kind, F.lit(")$"))
    longest = F.array_sort(F.coalesce(c["values"], F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    said = lambda w: F.regexp(w, known)
    return F.filter(_words(_blank(c["raw_text"], longest), SEPARATORS), lambda w: ~said(w) & ~let(F.regexp_replace(w, PARTICLE, ""), lambda s: (s != "") & said(s)))


def _explained(c: Column) -> Column:
    """Its text holds its one value, if it has values, and nothing is left over."""
    raw = F.coalesce(c["raw_text"], F.lit(""))
    one = c["values"].isNull() | ((F.size(c["values"]) == 1) & F.coalesce(F.contains(raw, F.get(c["values"], F.lit(0))), F.lit(False)))
    return (F.trim(raw) != "") & one & F.coalesce(F.size(residue(c)) == 0, F.lit(False))


def _number_agrees(c: Column) -> Column:
    """A number of the kind, unit, size and direction that the condition has; other conditions have no number in their text."""
    raw = F.coalesce(c["raw_text"], F.lit(""))
    part = lambda i: F.regexp_extract(raw, NUMBER, i)
    n = F.replace(part(1), F.lit(","), F.lit("")).try_cast("double") * F.coalesce(*[F.when(part(2) == u, F.lit(w)) for u, w in UNITS.items()], F.lit(1.0))
    agreed = F.lit(None).cast("boolean")
    for kind, (word, never, units) in MEASURES.items():
        unit = part(3).isin(*units) | ((part(3) == "") & (part(2) != "") if kind == "revenue" else F.lit(False))
        fine = raw.rlike(word) & unit & (~raw.rlike(never) if never else F.lit(True))
        agreed = F.when(c["key"].startswith(kind), fine).otherwise(agreed)
    up, least = raw.rlike(UP_TO), raw.rlike(AT_LEAST)
    way = F.when(c["key"].contains("Max"), up & ~least).otherwise(least & ~up)
    whole = (F.size(F.regexp_extract_all(raw, F.lit(NUMBER), 0)) == 1) & agreed & F.coalesce(n == c["number"], F.lit(False)) & ~raw.rlike(OPEN_END) & way
    return F.when(agreed.isNull(), ~raw.rlike("[0-9]")).otherwise(F.coalesce(whole, F.lit(False)))


def districts_named(text: Column, districts=None) -> Column:
    """Districts in a text, shared names included: a name with a boundary or a province before it and no other word after it, or
    a stem that is a word of its own."""
    known = regions.DISTRICTS if districts is None else districts
    names = "|".join(sorted({*known, *SHARED_DISTRICTS}, key=lambda n: (-len(n), n)))
    provinces = "|".join(sorted({n for all_ in PROVINCES.values() for n in all_}, key=lambda n: (-len(n), n)))
    whole = F.regexp_extract_all(text, F.lit(f"(?:(?<![가-힣])|(?<={provinces}))({names})(?=$|[^가-힣]|{AFTER_DISTRICT})"), 1)
    bare = F.transform(F.split(text, "[^가-힣]+"), lambda w: F.regexp_replace(w, f"(?:{AFTER_DISTRICT})$", ""))
    stems = F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.rlike("[시군구]$"))
    return F.array_distinct(F.concat(whole, F.array_compact(F.transform(stems, lambda w: district_of(w, districts)["name"]))))


def _provinces_named(text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(PROVINCE_WORD), 0), canonical_region)))


def _own_district(districts=None) -> Column:
    own = compact(F.col("district"))
    return F.coalesce(district_of(F.col("district"), districts)["name"], F.nullif(own, F.lit("")))


def _region_fits(c: Column, mine: Column, own: Column, districts=None) -> Column:
    """The text is places and filler alone, says no more and no less than the values, and names the company's place."""
    raw, values = F.coalesce(c["raw_text"], F.lit("")), c["values"]

    def read(named: Column) -> Column:
        stems = F.filter(F.transform(named, lambda n: F.regexp_replace(n, "[시군구]$", "")), lambda n: F.length(n) >= 2)
        without = _blank(raw, named)
        said = _provinces_named(without)
        of_named = F.array_compact(F.transform(named, lambda n: district_of(n, districts)["sido"]))
        sidos = F.array_distinct(F.concat(said, of_named))
        rest = F.regexp_replace(_blank(_blank(F.regexp_replace(raw, FIELD_PREFIX, " "), named), stems), PROVINCE_WORD, " ")
        plain = F.forall(_words(rest, REGION_SEPARATORS), lambda w: w.rlike(f"^(?:{REGION_FILLER})$"))
        one_gwangju = ~F.exists(F.concat(F.array(raw), values), lambda t: t.rlike(r"(?<!경기|경기도|경기 |경기도 )광주(?!광역시)"))

        def in_text(v: Column) -> Column:
            inner = districts_named(v, districts)
            given = _provinces_named(_blank(v, inner))
            by_district = F.forall(inner, lambda n: F.array_contains(named, n)) & F.forall(given, lambda s: F.array_contains(sidos, s)) & ~(F.exists(inner, lambda n: n.isin(*SHARED_DISTRICTS)) & (F.size(sidos) == 0))
            return F.when(v == NATIONWIDE, raw.contains(NATIONWIDE)).when(F.size(inner) > 0, by_district).otherwise(F.coalesce(F.array_contains(sidos, canonical_region(v)), F.lit(False)))

        def own_place(v: Column) -> Column:
            short = compact(v)
            name = F.regexp_replace(short, "^(?:" + "|".join(n for n, _ in regions._BY_LENGTH) + ")", "")
            exact = F.array_contains(F.array(*[F.lit(n) for n, _ in regions._BY_LENGTH]), short)
            d = district_of(short, districts)
            by_name = (own == d["name"]) & (mine.isNull() | (mine == d["sido"]) | F.coalesce(mine == d["former"], F.lit(False)))
            both = (own == F.coalesce(district_of(name, districts)["name"], F.when(name.isin(*SHARED_DISTRICTS), name))) & (canonical_region(short) == mine)
            return F.when(short == NATIONWIDE, True).when(exact, canonical_region(short) == mine).when(d.isNotNull(), by_name).otherwise(both)

        said_mine = (F.size(said) == 0) | F.coalesce(F.forall(said, lambda s: s == mine), F.lit(False))
        named_mine = (F.size(named) == 0) | ((F.size(named) == 1) & F.coalesce(F.array_contains(named, own), F.lit(False)))
        return plain & one_gwangju & (F.size(values) > 0) & F.forall(values, in_text) & said_mine & named_mine & F.exists(values, lambda v: F.coalesce(own_place(v), F.lit(False)))

    return F.coalesce(let(districts_named(raw, districts), read), F.lit(False))


def _begins_word(text: Column, word: Column) -> Column:
    """Whether a line of business has a word as a whole, at most with what may follow it in its phrase."""
    phrases = F.split(text, r"(?U)[,·ㆍ()/]|\s및\s")

    def tells(p: Column) -> Column:
        at = F.instr(p, word)
        before, tail = F.substring(p, at - 1, F.lit(1)), F.split(F.substring(p, at + F.length(word), F.length(p)), r"(?U)\s+")
        joined = ((at > 1) & before.rlike("[가-힣]")) | ((at > 1) & word.rlike("^[A-Za-z]") & before.rlike("[A-Za-z]")) | (word.rlike("[A-Za-z]$") & F.get(tail, F.lit(0)).rlike("^[A-Za-z]"))
        return (at > 0) & ~joined & F.forall(tail, lambda w: w.rlike(INDUSTRY_TAIL))

    return F.exists(phrases, tells)


def pass_fits(c: Column, districts=None) -> Column:
    """Whether a check (CHECK_TYPE) that passed is sure enough for a fit of the row's company (region, district, industry,
    scale); checks that didn't pass are no matter here."""
    mine, own = canonical_region(F.col("region")), _own_district(districts)
    industry, scale = F.coalesce("industry", F.lit("")), compact(F.col("scale"))
    by_key = (
        F.when(c["key"] == "region", _region_fits(c, mine, own, districts))
        .when(c["key"] == "industry", F.exists(c["values"], lambda v: _begins_word(industry, v)))
        .when(c["key"] == "companyScale", F.exists(c["values"], lambda v: compact(v) == scale))
        .otherwise(True)
    )
    return (c["verdict"] != "pass") | F.coalesce(((c["key"] == "region") | _explained(c)) & _number_agrees(c) & by_key, F.lit(False))


def substantive_checks(texts: Column, title: Column) -> Column:
    """Those of people's checks that decide who may apply. Not so: all parts of the text are common disqualifications, or notes
    on procedure, with nothing beside them but filler. Where the programme is for companies in distress, every check counts."""
    count = lambda t, p: F.size(F.regexp_extract_all(t, F.lit(f"({p})"), 1))

    def idle(part: Column) -> Column:
        body = F.regexp_replace(part, r"지원\s*대상\s*에서\s*(?:제외|배제)", "제외")
        states, listed, moral, note = count(body, STATE), count(body, LISTED), body.rlike(MORAL), body.rlike(NOTE)
        fine = (states + listed == 1) & body.rlike(EXCLUDING) & ~moral & ~note
        rest = F.regexp_replace(body, MORAL, " ")
        rest = F.regexp_replace(F.when(fine, F.regexp_replace(F.regexp_replace(rest, STATE, " "), LISTED, " ")).otherwise(rest), NOTE, " ")
        words = _words(rest, r"(?U)[\s·ㆍ.,:：/※*'\"「」『』~\-]+")
        told = body.rlike(r"지원\s*내용")
        filler = F.forall(words, lambda w: w.rlike(f"^(?:{CHECK_FILLER})$") | (told & w.rlike(f"^(?:{NOTE_FILLER})$")))
        return ((states + listed == 0) | fine) & ~(moral & note) & (moral | fine | note) & ~rest.rlike(NARROWING) & filler

    def counts(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, r"[()（）\[\],，;；\n]+"), lambda p: F.trim(p)), lambda p: p != "")
        mixed = text.rlike(NOTE) & (text.rlike(MORAL) | text.rlike(STATE) | text.rlike(LISTED))
        return (F.trim(text) != "") & (mixed | ~F.forall(parts, idle))

    own = F.coalesce(texts, F.array().cast("array<string>"))
    return F.when(F.coalesce(title, F.lit("")).rlike(DISTRESS), F.filter(own, lambda t: F.trim(t) != "")).otherwise(F.filter(own, counts))


def _scope_block(checks: Column, industry_scope: Column, region_scope: Column, districts=None) -> Column:
    of_region = F.filter(checks, lambda c: c["key"] == "region")
    given = F.filter(of_region, lambda c: ~F.coalesce(c["augmented"], F.lit(False)))
    nationwide = F.exists(given, lambda c: F.exists(c["values"], lambda v: v.contains(NATIONWIDE)))
    sure = F.forall(of_region, lambda c: (c["verdict"] == "pass") & pass_fits(c, districts))
    by_region = F.when(region_scope == "all", None).when(F.coalesce(region_scope != "restricted", F.lit(True)) | (F.size(given) == 0) | nationwide | ~sure, "region scope")
    by_industry = F.when(F.coalesce(industry_scope != "all", F.lit(True)) | F.exists(checks, lambda c: c["key"].isin("industry", "targetSector")), "industry scope")
    return F.coalesce(by_industry, by_region)


def _title_block(title: Column, districts=None) -> Column:
    mine, own = canonical_region(F.col("region")), _own_district(districts)
    industry = F.regexp_replace(F.coalesce("industry", F.lit("")), r"(?U)\s+", "")
    named = districts_named(title, districts)
    sidos = provinces_in(_blank(title, named))
    shared = F.exists(named, lambda n: n.isin(*SHARED_DISTRICTS)) & (F.size(sidos) == 0)
    any_place = F.size(sidos) + F.size(named) > 0
    odd = any_place & (title.rlike("제외|외|아닌|아니|밖") | shared | (F.size(sidos) > 1) | (F.size(named) > 1))
    elsewhere = ((F.size(sidos) == 1) & F.coalesce(F.get(sidos, F.lit(0)) != mine, F.lit(True))) | ((F.size(named) == 1) & F.coalesce(F.get(named, F.lit(0)) != own, F.lit(True)))
    without_means = lambda t: F.regexp_replace(t, f"(?:{'|'.join(MEANS)}){MEANS_TAIL}", " ")
    lines = F.transform(F.regexp_extract_all(without_means(title), F.lit(f"({INDUSTRY_WORD})"), 1), lambda w: F.regexp_replace(w, "(?:업종|업체)$", "업"))
    lines = F.filter(lines, lambda w: ~w.rlike(NO_INDUSTRY))
    other_line = (F.size(lines) > 0) & ((industry == "") | F.exists(lines, lambda w: ~F.contains(industry, w)))
    compounds = sectors.compounds_in(title)

    def other_sector(bare: Column) -> Column:
        told = []
        for sector, (a, b, _) in sectors.SECTORS.items():
            plain = [w for w in (*a, *b) if not (w.isascii() and w.isalpha())]
            patterns = [p for p in (TITLE_SECTORS.get(sector), "|".join(plain)) if p]
            told.append(F.when(bare.rlike("|".join(patterns)), F.lit(sector)))
        found = F.array_distinct(F.concat(F.array_compact(F.array(*told)), F.flatten(F.transform(compounds, lambda x: x["sectors"]))))
        own_sectors = sectors.sectors_of_industry(F.col("industry"))
        return (F.size(found) > 0) & ((F.size(own_sectors) == 0) | F.exists(found, lambda s: ~F.arrays_overlap(own_sectors, F.try_element_at(sectors.neighbour_table(), s))))

    return (
        F.when(title == "", None)
        .when(title.rlike(notices.NON_PROGRAM), "no programme")
        .when(odd | elsewhere, "place")
        .when(title.rlike(FOUNDERS_ONLY) & F.coalesce(F.col("scale") != FOUNDER, F.lit(True)), "founders")
        .when(F.exists(compounds, lambda x: F.size(x["sectors"]) == 0), "sector")
        .when(other_line, "line of business")
        .when(let(without_means(sectors.masked(title)), other_sector), "sector")
    )


def block(title: Column, checks: Column, human_checks: Column, rule_only: Column, industry_scope: Column, region_scope: Column, is_announcement: Column, districts=None) -> Column:
    """Why nothing of an announcement or product makes a fit for the row's company, whatever passes: human checks, rules only,
    industry scope, region scope, no programme, place, founders, line of business or sector; null where nothing is against it."""
    own = F.coalesce(title, F.lit(""))
    asked = F.size(substantive_checks(human_checks, own)) > 0
    return _first_block(asked, rule_only, is_announcement, _scope_block(checks, industry_scope, region_scope, districts), let(own, lambda t: _title_block(t, districts)))


def _first_block(asked: Column, rule_only: Column, is_announcement: Column, by_scope: Column, by_title: Column) -> Column:
    return F.when(asked, "human checks").when(F.coalesce(rule_only, F.lit(False)), "rules only").otherwise(F.coalesce(F.when(is_announcement, by_scope), by_title))


def fit_verdict(checks: Column, blocked: Column | None = None, districts=None) -> Column:
    """excluded where a check fails; fit where all pass, one of them isn't weak, and, with the announcement's block (null: none)
    given, it is null and every pass is sure; else unverified."""
    known = lambda v: F.exists(checks, lambda c: c["verdict"] == v)
    weak = lambda c: c["key"].isin("isCorporation", "companyScale") | ((c["key"] == "region") & F.coalesce(regions.is_nationwide(c["values"]), F.lit(False)))
    strong = F.exists(checks, lambda c: (c["verdict"] == "pass") & ~weak(c))
    open_ = known("unknown") | F.exists(checks, lambda c: F.coalesce(c["bars"], F.lit(False)))
    sure = F.lit(True) if blocked is None else blocked.isNull() & F.forall(checks, lambda c: pass_fits(c, districts))
    return F.when(known("fail"), "excluded").when(~open_ & strong & sure, "fit").otherwise("unverified")


PLACE = ["region", "district", "industry", "scale"]


def verdicts(pairs: DataFrame, districts=None) -> DataFrame:
    """The pairs (title, checks, human, rule_only, industry_scope, region_scope, is_announcement; the company's PLACE) with loose
    and strict (`fit_verdict` without and with the announcement) and blocked (`block`). Titles, checks and companies repeat from
    pair to pair, so each part of the verdict is worked out once for equal values of what it reads."""
    own = F.coalesce("title", F.lit(""))
    asked = F.size(substantive_checks(F.col("human"), own)) > 0
    by_title = let(own, lambda t: _title_block(t, districts))
    by_scope = _scope_block(F.col("checks"), F.col("industry_scope"), F.col("region_scope"), districts)
    found = told_once(pairs, ["title", "human"], {"asked": asked})
    found = told_once(found, ["title", *PLACE], {"by_title": by_title})
    found = told_once(found, ["checks", *PLACE], {"loose": fit_verdict(F.col("checks")), "sure": fit_verdict(F.col("checks"), F.lit(None).cast("string"), districts)})
    found = told_once(found, ["checks", "industry_scope", "region_scope", *PLACE], {"by_scope": by_scope})
    blocked = _first_block(F.col("asked"), F.col("rule_only"), F.col("is_announcement"), F.col("by_scope"), F.col("by_title"))
    # a block turns what would be a fit into unverified and nothing else
    strict = F.when((F.col("sure") == "fit") & F.col("blocked").isNotNull(), "unverified").otherwise(F.col("sure"))
    return found.withColumn("blocked", blocked).select(*pairs.columns, "loose", strict.alias("strict"), "blocked")
