"""Column expressions that classify announcements, titles and documents by their words; the first rule that fits counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.functions.korean import squeezed
from eligo.functions.regions import PROVINCES, canonical_region, compact

#: Categories by their words. Funding words come first, then those of hiring, then the rest in this order.
FUNDING_WORDS = r"융자|대출|이차보전|보증(?!금)|육성자금|정책자금"
HIRING_WORDS = r"취업|채용|일자리|고용|훈련|장려금|인건비|근로환경|직업능력"
CATEGORIES = (
    ("인증제도", r"인증|벤처.{0,6}확인|이노비즈|메인비즈|기업부설연구소|연구소\s*(설립|인정)|지정\s*신청"),
    ("R&D·기술", r"(?i)R&D|연구개발|기술개발|과제\s*(기획|공고|모집)|실증|테스트베드"),
    ("수출", r"수출|해외|무역|글로벌\s*진출|전시회|바이어|국제\s*박람회"),
    ("고용·인력", r"고용|채용|일자리|훈련|장려금|인건비|근로환경|직업능력"),
    ("정책자금", r"융자|대출|보증(?!금)|이차보전|자금\s*(지원|공고|계획)|정책자금|육성자금"),
    ("무상지원금", r"지원\s*사업|지원금|바우처|환급|사업화|마케팅|컨설팅|기술보급|창업패키지|창업보육|입주\s*기업|스마트공장"),
)
#: Categories in the order in which they are shown.
CATEGORY_ORDER = ("무상지원금", "정책자금", "고용·인력", "R&D·기술", "수출", "인증제도", "기타")
#: Institutions that lend themselves, kinds of money by their words, and by category where no word tells.
BANKS = ("bank", "internet-bank", "savings-bank", "capital")
GROUP_WORDS = (
    ("invest", r"(?i)투자유치|투자\s*받|투자\s*연계|펀드|TIPS|팁스|엔젤|액셀러레이|벤처캐피탈"),
    ("urgent", r"미소금융|햇살론|긴급|재해\s*(피해|복구|중소기업|소상공인)|재난\s*피해|폐업|재기|재도전|재창업|신용취약|취약계층|희망리턴|저신용|연체"),
    ("guarantee", r"특례보증|보증서|안심통장|보증드림|협약보증\s*(시행|안내|출시)|보증\s*지원(?!금)|신용보증(?!기금)|보증상품"),
    ("policy", r"정책자금|융자|이차보전|육성자금|육성기금|경영안정자금|운전자금|시설자금|대출|이자\s*(지원|보전)"),
    ("grant", r"보조금|지원사업|지원금|바우처|모집|공모|무료|무상|환급|사업화|컨설팅|기술보급|창업패키지"),
)
GROUP_OF_CATEGORY = {"무상지원금": "grant", "정책자금": "policy", "고용·인력": "grant", "R&D·기술": "grant", "수출": "grant"}
#: Consulting domain and section of a category's own name.
DOMAINS = (
    (r"^인력$", "hr", "labor-subsidy"),
    (r"^기술$", "cert", "cert"),
    (r"인증|벤처확인|이노비즈|메인비즈|기업부설연구소", "cert", "cert"),
    (r"특허|지식재산|상표|디자인권|실용신안", "patent", "patent"),
    (r"고용|채용|인건비|일자리|장려금|근로|직업능력|훈련", "hr", "labor-subsidy"),
    (r"경정청구|환급|세액공제", "policy-fund", "tax-amendment"),
)
#: Words that say nothing in a search, unless they hold a digit.
STOP_TERMS = ("이상", "이하", "미만", "초과", "기업", "지원", "사업", "대상", "경우", "관련", "확인", "이내", "있음", "없음", "해당", "필요", "가능", "신청", "조건")
#: Tails of local governments, words of persons and of companies.
LOCAL_TAIL = r"(?:특별시|광역시|특별자치시|특별자치도|[가-힣]{2,}도|[가-힣]{2,}시|[가-힣]{2,}군|[가-힣]{2,}구)$"
COMPANY_WORDS = r"사업주|기업|사업장|법인|소상공인|자영업|채용|고용(?:한|하면|유지|창출)"
PERSON_WORDS = r"구직자|실업자|실업급여|구직급여|취업준비|취업지원|훈련생|근로자 개인"
SUPPORT_NOUNS = "장려금|지원금|지원사업|바우처|보조금"
PARTICLES = "을|를|이|가|은|는|과|와|도|의|만|으로|로"
ORG_TAILS = "신용보증재단|기업진흥원|경제진흥원|산업진흥원|테크노파크"
ELLIPSIS = r"(?:\.{2,}|…)+\s*$"
#: Words that split a region field, and fields that name two provinces in one.
REGION_SPLIT = r"(?U)[,/#|~\s·ㆍ・･‧∙⋅•]+|및|와|과"
TWO_PROVINCES = {"전남광주": ("전남", "광주")}
MOST_EXCLUSIVE = 3
#: Kinds of documents by title, supporting words and file name; labels of the company form.
DOCUMENT_CLUES = {
    "biz-registration": (r"사업자등록증(?!주업종)", ("사업장소재지", "개업(?:연|년)월일", "법인등록번호", "업태", "종목", "발급사유", "사업의종류"), "사업자등록"),
    "financial-statement": (r"재무제표|손익계산서|재무상태표|대차대조표", ("매출액", "매출원가", "매출총이익", "영업이익", "당기순이익", "자산총계", "부채총계", "자본총계"), "재무제표|손익계산서|재무상태표"),
    "vat-return": (r"부가가치세(?:확정|예정|조기환급)?신고서?|부가세신고서|과세표준증명", ("과세표준", "매출세액", "세금계산서발급분", "과세기간", "납부세액", "신고서"), "부가세|부가가치세|과세표준"),
    "employment-insurance": (r"고용산재|고용보험|산재보험|고용현황|가입자명부|보험관계성립|피보험자", ("근로자이름", "근로자주민번호", "고용상태", "취득일", "상실일", "근로자수", "상시근로자"), "고용|산재|가입자명부|보험관계"),
}
FORM_LABELS = ("기업상태표", "업체명(법인은㈜)", "개업년월일", "사업자등록증주업종", "사업장소재지", "당해년도매출", "전년도(-1년)매출", "4대보험인원수", "특허출원이나등록여부", "연구소/기업인증보유여부", "정책자금기대출", "국세체납여부", "4대보험료체납여부")
FORM_NAME = "기업상태표"


def first_rule(text: Column, rules) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules])


def category_of(title: Column, summary: Column) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))
    return F.when(text.rlike(FUNDING_WORDS), "정책자금").when(text.rlike(HIRING_WORDS), "고용·인력").otherwise(F.coalesce(first_rule(text, CATEGORIES), F.lit("기타")))


def category_rank(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, F.lit(i)) for i, c in enumerate(CATEGORY_ORDER)], F.lit(len(CATEGORY_ORDER)))


def funding_group_of(title: Column, summary: Column, agency: Column, institution: Column, category: Column, rate: Column) -> Column:
    """Kind of money, null where nothing tells. A grant with a yearly loan rate is policy money."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, summary, agency)])
    by_category = F.coalesce(*[F.when(category == c, F.lit(g)) for c, g in GROUP_OF_CATEGORY.items()])
    found = F.when(institution.isin(*BANKS), "bank").otherwise(F.coalesce(first_rule(text, GROUP_WORDS), by_category))
    loan = F.coalesce(F.trim(rate).rlike(r"^연\s*[0-9.]+\s*%"), F.lit(False))
    return F.when((found == "grant") & loan, "policy").otherwise(found)


def domain_of(category: Column) -> Column:
    own = F.trim(F.coalesce(category, F.lit("")))
    row = lambda d, s: F.struct(F.lit(d).alias("domain"), F.lit(s).alias("section"))
    return F.coalesce(*[F.when(own.rlike(p), row(d, s)) for p, d, s in DOMAINS], row("policy-fund", "government-subsidy"))


def search_terms(terms: Column) -> Column:
    own = F.filter(F.transform(terms, lambda k: F.trim(k)), lambda k: k != "")
    return F.filter(own, lambda k: ~k.isin(*STOP_TERMS) | k.rlike("[0-9]"))


def least_score(terms: Column) -> Column:
    return F.when(F.size(terms) >= 2, 2).otherwise(1)


def region_of_agency(agency: Column) -> Column:
    """An agency whose last word is a local government names its region; others are empty."""
    own = F.trim(F.coalesce(agency, F.lit("")))
    return F.when(F.element_at(F.split(own, r"\s+"), -1).rlike(LOCAL_TAIL), own).otherwise("")


def only_persons(target: Column, title: Column) -> Column:
    text = F.concat_ws(" ", title, target)
    return text.rlike(PERSON_WORDS) & ~text.rlike(COMPANY_WORDS)


def estimated_title(overview: Column, support: Column, eligibility: Column) -> Column:
    """The first word that ends in a noun of support, without its particle and a year before it, of 5 to 24 letters; else the
    first 40 letters of the text with an ellipsis."""
    body = F.concat_ws(" ", overview, support, eligibility)
    words = F.regexp_extract_all(body, F.lit("[가-힣A-Za-z0-9·]+"), 0)
    cores = F.transform(F.filter(words, lambda w: w.rlike(f"(?:{SUPPORT_NOUNS})(?:{PARTICLES})?$")), lambda w: F.regexp_replace(F.regexp_replace(w, f"(?<={SUPPORT_NOUNS})(?:{PARTICLES})$", ""), "^(?:19|20)[0-9]{2}년도?", ""))
    named = F.filter(cores, lambda w: F.length(w).between(5, 24) & ~w.rlike(f"^(?:{SUPPORT_NOUNS})$"))
    lead = F.coalesce(F.nullif(F.trim(support), F.lit("")), F.trim(overview))
    return F.coalesce(F.get(named, F.lit(0)), F.when(lead != "", F.concat(F.left(lead, F.lit(40)), F.lit("…"))).otherwise(""))


def is_cut_title(title: Column) -> Column:
    own = squeezed(title)
    return own.rlike(ELLIPSIS) & (F.trim(F.regexp_replace(own, ELLIPSIS, "")) != "")


def whole_title(listed: Column, detail: Column) -> Column:
    """The detail page's title, where the listed one is cut and begins it (white space aside); else null."""
    stem, full = compact(F.regexp_replace(squeezed(listed), ELLIPSIS, "")), squeezed(detail)
    return F.when(is_cut_title(listed) & (full != "") & compact(full).startswith(stem), full)


def regions_of_field(text: Column) -> Column:
    """Provinces that a region field names by one of their whole names, in the order of the text."""
    names = {n for all_ in PROVINCES.values() for n in all_}
    tokens = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), REGION_SPLIT), lambda t: t != ""), compact)
    two = lambda t: F.coalesce(*[F.when(t == k, F.array(*[F.lit(v) for v in both])) for k, both in TWO_PROVINCES.items()])
    each = F.transform(tokens, lambda t: F.coalesce(two(t), F.when(t.isin(*sorted(names)), F.array(canonical_region(t))), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(each))


def bound_regions(region: Column, title: Column) -> Column:
    """Provinces that an announcement is bound to by its field and its title's tag; empty where it is for all, or names too many to
    tell."""
    tag = F.nullif(F.regexp_extract(F.ltrim(F.coalesce(title, F.lit(""))), r"^\[([^\]]+)\]", 1), F.lit(""))
    theirs = F.array_union(regions_of_field(region), regions_of_field(tag))
    return F.when(~compact(region).rlike("전국|무관") & F.size(theirs).between(1, MOST_EXCLUSIVE), theirs).otherwise(F.array().cast("array<string>"))


def own_region(region: Column) -> Column:
    """A company's province; null where it isn't known or is nationwide."""
    return F.when(~compact(region).startswith("전국"), canonical_region(region))


def prefilter(bound: Column, end: Column, mine: Column, now: Column) -> Column:
    """drop-closed past the end; drop-region where the bound regions (bound_regions) leave out mine (own_region); else keep."""
    other = mine.isNotNull() & (F.size(bound) > 0) & ~F.array_contains(bound, mine)
    return F.when(end < now, "drop-closed").when(F.coalesce(other, F.lit(False)), "drop-region").otherwise("keep")


def regions_of_orgs(agency: Column) -> Column:
    """Provinces of the regional bodies in a list of agencies: a province's whole name and a body's, nothing else."""
    parts = F.split(F.coalesce(agency, F.lit("")), r"[,/·]|및")
    names = "|".join(sorted({n for all_ in PROVINCES.values() for n in all_}, key=lambda n: (-len(n), n)))
    whole = F.filter(F.transform(parts, compact), lambda p: p.rlike(f"^(?:{names})(?:{ORG_TAILS})$"))
    return F.array_distinct(F.transform(whole, canonical_region))


def document_kind(text: Column, file_name: Column) -> Column:
    """Title clue 3, up to three supporting words 1 each, file name 2; a form counts its labels, 3 more from three on. The best
    kind counts with 3 or more, two ahead of the next; else unknown."""
    body, name = compact(text), compact(file_name)
    one = lambda test, n: F.when(test, n).otherwise(0)
    labels = sum((one(body.contains(x), 1) for x in FORM_LABELS), F.lit(0))
    scores = {"company-status": labels + one(labels >= 3, 3) + one(name.contains(FORM_NAME), 2)}
    for kind, (title, support, named) in DOCUMENT_CLUES.items():
        clues = sum((one(body.rlike(p), 1) for p in support), F.lit(0))
        scores[kind] = one(body.rlike(title), 3) + F.least(F.lit(3), clues) + one(name.rlike(named), 2)
    ranked = F.sort_array(F.array(*[F.struct(s.alias("score"), F.lit(k).alias("kind")) for k, s in scores.items()]), asc=False)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((top["score"] >= 3) & (top["score"] - second["score"] >= 2), top["kind"]).otherwise("unknown")


def attachment_kind(name: Column, url: Column) -> Column:
    """By the extension of a name, else of an address's last path segment, else of a value of its query; else etc."""
    known = lambda x: F.regexp_extract(F.lower(x), r"\.(pdf|hwpx|hwp|zip)$", 1)
    path = F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", "")
    values = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")), F.regexp_replace(p, "^[^=]*=?", "")))
    some = lambda x: F.nullif(x, F.lit(""))
    of_query = F.get(F.filter(F.transform(values, known), lambda x: x != ""), F.lit(0))
    return F.coalesce(some(known(F.regexp_replace(F.coalesce(name, F.lit("")), "[?#].*$", ""))), some(known(path)), of_query, F.lit("etc"))


