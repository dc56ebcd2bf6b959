"""Requirement sentences judged by what is known of a company: pass, fail, ignore, an obstacle that can be mended, or a short
question for a person. The rules are a table, read from the top: the first whose test holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.functions import sectors
from eligo.functions.regions import DISTRICTS, PROVINCES, canonical_region, compact, district_of

#: Groups of provinces.
REGION_GROUPS = {
    r"비\s*수도권": ("부산", "대구", "광주", "대전", "울산", "세종", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주"),
    "수도권": ("서울", "경기", "인천"),
    "충청권": ("대전", "세종", "충북", "충남"),
    "호남권": ("광주", "전북", "전남"),
    "대경권": ("대구", "경북"),
    "동남권": ("부산", "울산", "경남"),
    "영남권": ("부산", "대구", "울산", "경북", "경남"),
}
#: Words that look like places, how places are asked for, and what widens or turns them.
SCHOOL = r"(서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주|경상|전라|충청)\s*(?:대학교|대학|대(?![가-힣])|과학기술원|과기원)"
PLACE_NOISE = r"환경기|대전환|(?<=[가-힣A-Za-z&])대전(?![광시])|(?:R&D|알앤디)\s+대전|세종\s*(?:과학|문화|대왕|학당|도서)|경기\s*(?:침체|회복|변동|둔화|부양|활성화|불황|악화|장|일정|결과|규칙)"
PLACE_REQUIRED = r"소재|주소|본사|본점|사업장|거주|주민\s*등록|사업\s*중|영위"
OTHER_DISTRICT_TOO = r"[구군시]\s*(?:외(?!국)|등(?![록급]))|제외|인근|인접|근처|주변"
OTHER_PLACE_TOO, BOTH_PLACES = r"타\s*(?:지역|시\s*[·ㆍ]?\s*도)|전국", "포함|모두|및|까지"
OUTSIDE = r"([가-힣]+)\s*(이외|(?<!제)외|밖)(?![국부래식과곽])(\s*(?:의|에)?\s*(?:지역|소재|시\s*[·ㆍ]?\s*도|곳))?"
#: Sentences that exclude, states that hardly anybody is in, sentences on procedure, preferences and alternatives.
EXCLUDING = r"아니어야|아니여야|아닐\s*것|아닌\s*(?:자|기업|업체|사업자|경우|곳)|않은\s*(?:자|기업|업체)|않아야|제외|불가|배제|제한|금지|해당\s*(?:시|하는\s*경우|되는\s*경우)|결격|지원\s*대상이\s*아님"
DISQUALIFIER = r"휴\s*[·ㆍ.,]?\s*폐업|폐업|휴업|체납|부도|신용\s*불량|연체|채무\s*불이행|파산|회생|영업\s*정지|행정\s*처분|제재|참여\s*제한|허위|부정|부적격|이해\s*관계|중복\s*(?:지원|수혜|신청|참여)|불건전|사행|유흥|사치|향락|투기|퇴폐|도박|무신고|무등록|횡령|사회적\s*물의|임금\s*체불|산재\s*다발|적정하지|적합하지|목적에\s*(?:맞지|부합하지)|구상\s*채권|특수\s*채권|관리\s*종결|대위\s*변제|신용\s*관리|금융\s*질서|국세|지방세|4대\s*보험|보험료|대기업|중견기업|상장|계열사|공공기관|공기업|비영리|협회|단체|외국\s*기관|국제\s*기관|다단계|풍속|청소년\s*유해|성매매|훈련\s*기관|금융\s*(?:및|·)?\s*보험업|부동산\s*(?:업|임대)"
DISQUALIFIED = r"휴\s*[·ㆍ.,]?\s*폐업|폐업|휴업|체납|부도|신용\s*불량|연체|채무\s*불이행|파산|회생|영업\s*정지|행정\s*처분|제재|참여\s*제한|허위|부정\s*(?:수급|사용|행위|한|하게|당)|부적격|불건전|사행|유흥|향락|투기|도박|무등록|횡령|사회적\s*물의|임금\s*체불|구상\s*채권|대위\s*변제|금융\s*질서|자본\s*(?:전액\s*)?잠식|부채\s*비율|신용\s*회복|워크\s*아웃|채무\s*조정|법정\s*관리|청산|해산"
PROCEDURE = r"문의처|연락처|담당자|전화|날인|홈페이지|누리집|신청\s*(?:방법|기간|기한|절차|서류|시\s|접수|하기)|접수\s*(?:방법|기간|처)|제출|구비\s*서류|첨부|서식|온라인\s*(?:접수|신청)|이수|수료|선정\s*(?:평가|절차|방법|후|시|된|기업은)|평가|심사|예산|소진|지급|정산|증빙|환수|취소|지원\s*(?:내용|규모|금액|한도|항목|범위|비율|기간|방법|절차|조건\s*:)|최대\s*[0-9,.]+|[0-9,.]+\s*(?:만\s*원|억\s*원|천\s*원|원)\s*(?:이내|한도|까지)|우대|가점|우선\s*(?:선정|지원)|협약|사후\s*관리|의무|보고서|자세한\s*(?:사항|내용)|공고문\s*참조|붙임|별첨|개인\s*정보|동의서"
PREFERENCE, EITHER = r"우대|가점|우선\s*(?:선정|지원|선발)", r"또는|이거나|혹은|중\s*(?:하나|어느|1개)"
NOT_FOR_BUSINESS = r"^[\s※*·ㅇ○●◦□■▶►\-–]*단\s*[,.]?\s*[^.]{0,40}(?:비영리|공기업|공사\)|공공\s*기관|대학|연구\s*기관|출연\s*연)[^.]{0,30}(?:적용하지|적용\s*(?:제외|안\s*함|되지)|해당하지|예외)"
#: What nothing known of a company can settle.
CLUSTER, YOUTH = "집적지", r"청년\s*(?:창업자|대표|사업자|기업)|(?:대표자?|창업자|신청인)\s*(?:가|이)?\s*청년"
AGE = r"(?:만\s*)?([0-9]{2})\s*세\s*(이상|이하|미만|초과)"
HISTORY = r"(?:지원|수혜|선정|참여|참가|이용)\s*(?:을|를)?\s*(?:받은|받았|받고|된|하였|했|한|중인|이력|한\s*적|경험)|기\s*수혜|수혜\s*(?:기업|자|업체|이력)"
ASK_AGENCY = r"(?:상이|다르므로|다름|별도\s*(?:공고|안내)|센터별|기관별|지역별|사업별|세부\s*(?:내용|사항))[^.。]*문의|문의\s*(?:바람|요망|필요|후\s*신청)"
RESEARCH = r"국가\s*연구\s*개발|연구\s*개발\s*기관|주관\s*연구|공동\s*연구|연구\s*책임자|인건비\s*계상|기초\s*연구\s*진흥|연구\s*개발\s*혁신법|기업\s*부설\s*연구|연구\s*전담\s*부서|연구\s*소"
CERTIFICATE = r"벤처\s*기업|이노비즈|메인비즈|인증\s*(?:기업|보유)|여성\s*기업|장애인\s*기업|사회적\s*기업|예비\s*사회적|마을\s*기업|자활\s*기업|협동\s*조합|소셜\s*벤처|백년\s*가게|착한\s*가격|가족\s*친화|강소\s*기업|뿌리\s*기업|수출\s*(?:기업|실적)|R&D|연구\s*소|전담\s*부서|특허|직무\s*발명|기술\s*평가"
#: What is known of a company.
CORPORATION_ONLY, PERSON_ONLY = r"법인\s*(?:사업자)?\s*(?:만|에\s*한)", r"개인\s*사업자\s*(?:만|에\s*한)"
NO_CORPORATION, NO_PERSON = r"법인\s*(?:사업자)?\s*(?:은|는)?\s*(?:제외|불가)", r"개인\s*사업자\s*(?:은|는)?\s*(?:제외|불가)"
FOUNDED = r"(?:개업|설립|창업|사업자\s*등록|사업\s*개시)\s*(?:일|일자|일이|일자가)?[^0-9]{0,8}([0-9]{4})\s*[년.\-/]\s*([0-9]{1,2})\s*(?:[월.\-/]\s*([0-9]{1,2})\s*일?)?\s*(?:\(?[가-힣]\)?)?\s*(이전|이후|부터|까지|전|후)"
YEARS = r"업력\s*([0-9]{1,2})\s*년\s*(이상|이하|미만|이내|초과)"
WORKERS = r"(?:상시\s*)?(?:근로자|종업원|직원|고용\s*인원)[^0-9]{0,20}([0-9]{1,4})\s*(?:명|인)\s*(미만|이하|이상|초과)"
SECOND_BOUND = r"\s*(?:~|∼|-|–)?\s*([0-9]{1,4})\s*(?:명|인|년)?\s*(미만|이하|이상|초과|이내)"
SIZE_WORD = r"우선\s*지원\s*대상\s*기업|중소\s*기업|소상공인|소공인|소기업|중기업|중견\s*기업|창업\s*기업"
SIZE_OFFICE = r"(?:소상공인|소공인|중소\s*(?:벤처\s*)?기업)\s*(?:시장\s*진흥\s*공단|진흥\s*공단|진흥원|특화\s*지원\s*센터|지원\s*센터|센터|벤처\s*기업부|중앙회|기술\s*정보\s*진흥원|유통\s*센터|정책\s*자금|연합회|협회|24|(?:부|청)(?![가-힣]))"
SMALL_REVENUE = r"소기업\s*(?:규모\s*)?기준|매출\s*액?\s*(?:등이)?\s*소기업"
INSURED = r"고용\s*보험\s*(?:에\s*)?(?:가입|피보험|적용|성립)"
OPERATING, REGISTERED = r"정상\s*(?:적으로)?\s*(?:영업|운영)|영업\s*(?:중|하고)\s*(?:인|있는)|사업\s*(?:중|영위\s*중)인", r"사업자\s*등록(?:증)?\s*(?:을|이|상)?\s*(?:보유|있는|소지|필수|된|한)"
BROAD_INDUSTRY = ("제조업", "제조", "가공", "임가공", "가공업", "서비스업", "서비스", "도소매업", "도매업", "소매업", "기타", "업", "및", "사업")
LABEL_LETTERS = 22
_NAMES = "|".join(sorted({n for names in PROVINCES.values() for n in names}, key=lambda n: (-len(n), n)))


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def short(text: Column, most: int = LABEL_LETTERS) -> Column:
    """A label's text: no list marks in front, single spaces, cut after `most` letters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^(?:[\s□■○●◦▶▷※*·-]+|[0-9]{1,2}[.)](?![0-9])\s*|[가-하][.)]\s*|\([0-9]{1,2}\)\s*|[①-⑳]\s*)+", ""), r"(?U)\s+", " "))
    return let(bare, lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t))


def places_in(text: Column, districts=None) -> Column:
    """(sidos, districts as name and sido) of a text: districts first, groups of provinces spread out, then words that begin or
    hold a province's name; schools and look-alikes aren't places."""
    known = DISTRICTS if districts is None else districts
    names = "|".join(sorted(known, key=lambda n: (-len(n), n)))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), SCHOOL, " "), PLACE_NOISE, " ")

    def read(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?:(?<![가-힣0-9A-Za-z])|(?<={_NAMES}))({names})"), 1))
        rest = F.aggregate(found, t, lambda r, n: F.replace(r, n, F.lit(" ")))

        def spread(r: Column) -> Column:
            groups, left = [], r
            for pattern, sidos in REGION_GROUPS.items():
                groups.append(F.when(left.rlike(pattern), F.split(F.lit(",".join(sidos)), ",")).otherwise(F.array().cast("array<string>")))
                left = F.regexp_replace(left, pattern, " ")
            named = F.array_compact(F.transform(F.regexp_extract_all(left, F.lit(f"({_NAMES})"), 1), canonical_region))
            return F.array_distinct(F.concat(*groups, named))

        return F.struct(let(rest, spread).alias("sidos"), F.transform(found, lambda n: district_of(n, districts)).alias("districts"))

    return let(bare, read)


def compared(read: Column, sido: Column, district: Column) -> Column:
    """match, differ, none (no place is read) or unknown (the company's own place isn't known well enough)."""
    same = F.filter(read["districts"], lambda d: d["sido"] == sido)
    return (
        F.when((F.size(read["sidos"]) == 0) & (F.size(read["districts"]) == 0), "none")
        .when(sido.isNull(), "unknown")
        .when(F.size(same) > 0, F.when(district.isNull(), "unknown").when(F.exists(same, lambda d: d["name"] == district), "match").otherwise("differ"))
        .when(F.array_contains(read["sidos"], sido), "match")
        .otherwise("differ")
    )


def place_label(read: Column) -> Column:
    return short(F.array_join(F.concat(F.transform(read["districts"], lambda d: d["name"]), read["sidos"]), "·"), 16)


def outside_of(text: Column, districts=None) -> Column:
    """(places that a text names as left out, whether only what is outside of them counts, the text without them)."""
    part = lambda i: F.regexp_extract_all(text, F.lit(OUTSIDE), i)
    rows = F.zip_with(part(1), part(3), lambda w, tail: F.struct(places_in(w, districts).alias("read"), (tail != "").alias("only")))
    real = F.filter(rows, lambda r: (F.size(r["read"]["sidos"]) > 0) | (F.size(r["read"]["districts"]) > 0))
    return let(real, lambda rs: F.struct(
        (F.size(rs) > 0).alias("any"),
        F.struct(F.array_distinct(F.flatten(F.transform(rs, lambda r: r["read"]["sidos"]))).alias("sidos"), F.array_distinct(F.flatten(F.transform(rs, lambda r: r["read"]["districts"]))).alias("districts")).alias("read"),
        F.exists(rs, lambda r: r["only"]).alias("only"), F.regexp_replace(text, OUTSIDE, " ").alias("rest"),
    ))


def _holds(value: Column, limit: Column, word: Column) -> Column:
    return F.when(word == "미만", value < limit).when(word.isin("이하", "이내"), value <= limit).when(word == "초과", value > limit).otherwise(value >= limit)


def _bounds(text: Column, pattern: str, unit: str, value: Column) -> tuple[Column, Column]:
    """(whether a value lies within one bound or two, their words)."""
    both = f"{pattern}(?:{SECOND_BOUND})?"
    part = lambda i: F.regexp_extract(text, both, i)
    n = lambda i: part(i).try_cast("double")
    second = F.coalesce(n(3).isNotNull(), F.lit(False))
    label = F.concat(part(1), F.lit(unit + " "), part(2), F.when(second, F.concat(F.lit(" "), part(3), F.lit(unit + " "), part(4))).otherwise(""))
    return _holds(value, n(1), part(2)) & (~second | _holds(value, n(3), part(4))), label


def listed_industry(text: Column, industry: Column) -> Column:
    """Whether a list names a company's line of business: one of its own words, or a broad one as an item by itself."""
    words = F.filter(F.split(F.coalesce(industry, F.lit("")), "[^가-힣A-Za-z]+"), lambda w: F.length(w) >= 2)
    own, items = compact(text), F.transform(F.split(text, r"[,，、;·ㆍ\"“”'‘’「」『』()（）\[\]/\n]|\s(?:및|와|과|또는)\s"), lambda x: F.regexp_replace(compact(x), "(?:등|을|를)$", ""))
    broad = lambda w: w.isin(*BROAD_INDUSTRY)
    return F.exists(words, lambda w: (~broad(w) & F.contains(own, w)) | (broad(w) & w.endswith("업") & (F.length(w) >= 3) & F.array_contains(items, w)))


def judged(text: Column, negated: Column | None = None, now: Column | None = None, districts=None) -> Column:
    """(kind, label, rule) of a sentence for the row's company: sido, own_district, industry, revenue, employees, age, founded,
    corporation, bizno, tax_delinquent. kind: pass, fail, ignore, obstacle or check; rule names the row of the table that decided."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    turned = F.lit(False) if negated is None else F.coalesce(negated, F.lit(False))
    # letters that are set apart one by one are joined
    spaced = F.regexp_replace(raw, r"(?<=(?<![가-힣])[가-힣])\s(?=[가-힣](?![가-힣]))", "")
    return let(spaced, lambda t: let(places_in(t, districts), lambda read: let(outside_of(t, districts), lambda out: _decided(t, turned, read, out, districts))))


def _decided(t: Column, turned: Column, read: Column, out: Column, districts) -> Column:
    c = F.col
    told = compared(read, c("sido"), c("own_district"))
    excluding, preferred, either = turned | t.rlike(EXCLUDING), t.rlike(PREFERENCE), t.rlike(EITHER)
    answer = lambda kind, label, rule: F.struct(F.lit(kind).alias("kind"), (F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(rule).alias("rule"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    fail_or = lambda reason, rule: F.when(either, answer("check", said(reason, " 또는 다른 기준"), rule)).otherwise(answer("fail", reason, rule))
    decided = lambda fits, reason, rule: F.when(fits, answer("pass", "", rule)).otherwise(fail_or(reason, rule))
    none = F.lit(False)

    of_worker = t.rlike("근로자|직원|채용|고용|인력|구직|청년\\s*(?:을|를)") & ~t.contains("대표")
    age_n, age_w = F.regexp_extract(t, AGE, 1), F.regexp_extract(t, AGE, 2)
    age_label = F.when(of_worker, said("직원 나이 조건(만 ", age_n, "세 ", age_w, ")")).otherwise(said("대표자 만 ", age_n, "세 ", age_w))
    date = lambda i: F.regexp_extract(t, FOUNDED, i)
    limit = F.try_to_timestamp(F.concat_ws("-", date(1), F.lpad(date(2), 2, "0"), F.lpad(F.coalesce(F.nullif(date(3), F.lit("")), F.lit("1")), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    early = date(4).rlike("이전|까지|전")
    years_ok, years_label = _bounds(t, YEARS, "년", c("age"))
    workers_ok, workers_label = _bounds(t, WORKERS, "명", c("employees"))
    small = sectors.size_fact(F.lit("소기업"))
    sizes = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(t, SIZE_OFFICE, " "), F.lit(f"({SIZE_WORD})"), 1), compact))
    size = sectors.size_verdict(sizes)
    merchant = sectors.few_workers()
    corporation, only = c("corporation"), lambda p: t.rlike(p)
    of_form = only(NO_CORPORATION) | only(NO_PERSON) | only(CORPORATION_ONLY) | only(PERSON_ONLY)
    required = t.rlike(PLACE_REQUIRED) & ~preferred & ~t.rlike(PROCEDURE) & ~excluding
    beyond = out["only"] & ~t.rlike(BOTH_PLACES) & (compared(places_in(out["rest"], districts), c("sido"), c("own_district")) != "match") & (compared(out["read"], c("sido"), c("own_district")) == "match")
    elsewhere = ~out["any"] & (told == "differ") & ~t.rlike(OTHER_DISTRICT_TOO) & ~t.rlike(OTHER_PLACE_TOO)
    place_fail = lambda label: F.when(either, answer("check", "지역 조건 확인", "place")).otherwise(answer("fail", label, "place"))
    table = [
        (t == "", answer("ignore", "", "empty")),
        (t.rlike(NOT_FOR_BUSINESS), answer("ignore", "", "other applicants")),
        (t.rlike(CLUSTER), answer("check", "집적지 근처 인정 여부 확인", "cluster")),
        (t.rlike(AGE) & ~excluding & ~preferred, answer("check", age_label, "age")),
        (t.rlike(YOUTH) & ~excluding & ~preferred, answer("check", "대표자 청년(만 39세 이하) 여부", "youth")),
        (t.rlike(HISTORY) & (excluding | t.contains("수혜")) & ~t.rlike(r"중복\s*(?:지원|수혜|신청|참여)"), answer("check", "지원 이력(같은 사업 수혜 여부)", "history")),
        (of_form & corporation.isNull(), answer("check", "법인·개인 구분 확인", "form")),
        (only(NO_CORPORATION) & corporation, answer("fail", "법인 제외", "form")),
        (only(NO_PERSON) & ~corporation, answer("fail", "개인사업자 제외", "form")),
        (only(CORPORATION_ONLY) & ~corporation, answer("fail", "법인만", "form")),
        (only(PERSON_ONLY) & corporation, answer("fail", "개인사업자만", "form")),
        (t.contains("체납") & c("tax_delinquent"), answer("obstacle", "체납 정리 필요", "taxes")),
        (excluding & t.rlike(r"업종|업\s*\(|영위") & listed_industry(t, c("industry")), answer("check", "제외 업종 해당 여부", "excluded industry")),
        (excluding & (told == "match") & ~t.rlike(PROCEDURE) & t.rlike("소재|주소|본사|사업장"), answer("check", "지역 제외 조건 확인", "excluded place")),
        (excluding & t.rlike(r"카드\s*매출"), answer("check", "카드 매출 여부", "excluded")),
        (excluding & (t.rlike(DISQUALIFIER) | t.rlike(DISQUALIFIED) | turned | t.rlike(PROCEDURE) | t.rlike("직무|과제|품목|항목|비용|경비|사업비|용도|훈련|교육|구매|지출")), answer("ignore", "", "excluded")),
        (excluding, answer("check", said("제외 조건: ", short(t)), "excluded")),
        (required & out["any"] & beyond, place_fail(said("다른 지역 대상(", place_label(out["read"]), " 밖)"))),
        (required & elsewhere, place_fail(said("다른 지역 대상(", place_label(read), ")"))),
        (t.rlike(FOUNDED) & limit.isNotNull() & c("founded").isNull(), answer("check", "설립일 입력", "founded")),
        (t.rlike(FOUNDED) & limit.isNotNull(), decided(F.when(early, c("founded") <= limit).otherwise(c("founded") >= limit), said("개업일 조건(", F.trim(F.regexp_substr(t, F.lit(FOUNDED))), ")"), "founded")),
        (t.rlike(YEARS) & (c("age").isNull() | (c("age") < 0)), answer("check", "설립일 입력", "years")),
        (t.rlike(YEARS), decided(years_ok, said("업력 ", years_label), "years")),
        (t.rlike(r"10\s*명") & t.rlike(r"5\s*명") & t.rlike("근로자|직원|종업원"), F.when(merchant == "yes", answer("pass", "", "merchant")).when(merchant == "no", answer("fail", "상시근로자 기준 초과", "merchant")).otherwise(answer("check", F.when(c("employees").isNull(), "직원 수 입력").otherwise("상시근로자 기준 확인"), "merchant"))),
        (t.rlike(WORKERS) & c("employees").isNull(), answer("check", "직원 수 입력", "workers")),
        (t.rlike(WORKERS), decided(workers_ok, said("상시근로자 ", workers_label), "workers")),
        (t.rlike(SMALL_REVENUE), F.when(small == "yes", answer("pass", "", "revenue")).when(small == "no", fail_or(F.lit("소기업 매출 기준 초과"), "revenue")).otherwise(answer("check", F.when(c("revenue").isNull(), "연매출 입력").otherwise("소기업 매출 기준 확인"), "revenue"))),
        (t.rlike(INSURED) & c("employees").isNull(), answer("check", "직원 수 입력", "insured")),
        (t.rlike(INSURED) & (c("employees") < 1), answer("check", "고용보험 가입 여부", "insured")),
        (t.rlike(INSURED) & (F.size(sizes) == 0), answer("pass", "", "insured")),
        ((F.size(sizes) > 0) & (size == "pass"), answer("pass", "", "size")),
        ((F.size(sizes) > 0) & (size == "fail"), fail_or(said("대상: ", F.array_join(sizes, "·")), "size")),
        (F.size(sizes) > 0, answer("check", said("기업 규모: ", F.array_join(F.filter(sizes, lambda n: F.coalesce(sectors.size_fact(n), F.lit("unknown")) == "unknown"), "·")), "size")),
        (t.rlike(OPERATING), answer("pass", "", "operating")),
        (t.rlike(REGISTERED), F.when(c("bizno").isNotNull(), answer("pass", "", "registered")).otherwise(answer("check", "사업자 등록 여부", "registered"))),
        (t.rlike(DISQUALIFIED), answer("ignore", "", "disqualified")),
        (t.rlike(ASK_AGENCY), answer("check", "기관 문의", "agency")),
        (t.rlike(RESEARCH) & ~t.rlike(PROCEDURE), answer("check", "R&D 수행 요건(연구소·연구 인력)", "research")),
        (t.rlike(CERTIFICATE) & ~t.rlike(PROCEDURE), answer("check", said(compact(F.regexp_substr(t, F.lit(CERTIFICATE))), " 해당 여부"), "certificate")),
        (told == "match", answer("pass", "", "place alone")),
        ((told != "none") & t.rlike(PROCEDURE), answer("ignore", "", "procedure")),
        (told == "unknown", answer("check", "소재지 확인", "place alone")),
        (told == "differ", answer("check", "지역 조건 확인", "place alone")),
        (t.rlike(PROCEDURE) | t.contains("문의"), answer("ignore", "", "procedure")),
    ]
    found = F.when(F.coalesce(table[0][0], none), table[0][1])
    for test, outcome in table[1:]:
        found = found.when(F.coalesce(test, none), outcome)
    return found.otherwise(answer("check", said("조건 확인: ", short(t)), "open"))
