"""Conditions read from an announcement's text by rules, as an array of (key, op, values, number, flag, raw_text,
machine_readable). Each rule reads the text once; what it found carries its surroundings, so that no place is counted twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.functions.regions import DISTRICTS, PROVINCES, canonical_region, compact, district_of, provinces_in, provinces_of_compact
from eligo.functions.notices import loan_programme, region_from_field
from eligo.functions.sectors import sectors_in_title
from eligo.operators.evaluate import EXPECTED_OP

#: Letters between a word and its number, units of won, words of sizes and of negation.
NEAR = r"[^.。\n]{0,20}?"
NUMBER = r"([0-9][0-9,]*)"
WON_UNITS = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000}
SIZES = ("중소기업", "소상공인", "중견기업", "예비창업자")
NEGATION = r"제외|아닌|아니한|아니하|않는|않은|않음|불가|해당\s*없|미해당|불인정"
REGION_WORDS = r"소재|관내|도내|시내|거주|위치|본사|사업장|주소|에 있는|내\s*기업|내\s*중소기업"
#: The letters that these words begin with: where another one stands, none of them has to be tried.
REGION_FIRST = "[소관도시거위본사주에내]"
AGE, WORKERS, REVENUE = "(?:업력|창업)", r"(?:상시\s*)?(?:근로자|종업원|임직원)", "매출액?"
#: Lines of business that are looked for, in their order.
INDUSTRY_WORDS = (
    "제조업", "건설업", "도소매업", "도매업", "소매업", "음식점업", "숙박업", "운수업", "물류업",
    "정보통신업", "정보통신산업", "출판업", "교육서비스업", "보건업", "부동산업", "임대업",
    "농업", "임업", "어업", "축산업", "광업", "수산업", "서비스업", "지식서비스산업",
    "콘텐츠산업", "관광업", "금융업", "보험업", "예술", "스포츠", "수리업", "협회", "단체",
    "섬유", "피혁", "식품", "화장품", "바이오", "반도체", "자동차부품", "기계", "조선", "항공",
    "소프트웨어", "게임", "디자인", "인쇄", "화학", "금속", "전자부품", "의료기기", "패션", "가구",
)
WINDOW = 30
#: What stands before the text that a rule has read, and the letters kept before and after it.
RULE_PREFIX, BEFORE, AFTER, TITLE_LETTERS = "[자동 인식]", 15, 25, 40
#: Fixed value: letters from a word of location within which a province counts.
REGION_NEAR = 25
CONDITION_TYPE = "struct<key:string,op:string,values:array<string>,number:double,flag:boolean,raw_text:string,machine_readable:boolean>"


def _let(value: Column, body) -> Column:
    """body(value), where the value is worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _condition(key: str, machine_readable: Column, raw: Column, values=None, number=None, flag=None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(key).alias("key"), F.lit(EXPECTED_OP[key]).alias("op"), (values if values is not None else none).cast("array<string>").alias("values"),
        (number if number is not None else none).cast("double").alias("number"), (flag if flag is not None else none).cast("boolean").alias("flag"), raw.alias("raw_text"), machine_readable.alias("machine_readable"),
    )


def _part(text: Column, at: Column, before: int, after) -> Column:
    """Letters from `before` ahead of a place (1-based) to `after` behind it."""
    start = F.greatest(at - before, F.lit(1))
    return F.substring(text, start, at + after - start)


def _raw(part: Column) -> Column:
    return F.concat(F.lit(RULE_PREFIX + " "), F.regexp_replace(part, r"(?U)^\s+|\s+$", ""))


def _found(text: Column, at: Column, length, condition) -> Column:
    """condition(denied, raw text) of what stands at a place (1-based): whether a word of negation is near, and the part kept."""
    return condition(_part(text, at, WINDOW, length + WINDOW).rlike(NEGATION), _raw(_part(text, at, BEFORE, length + AFTER)))


def _numbered(text: Column, key: str, pattern: str, below: bool, unit: bool = False) -> Column:
    def read(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, pattern, i)
        n = F.replace(part(1), F.lit(","), F.lit("")).cast("double")
        if unit:
            n = n * F.coalesce(*[F.when(part(2) == u, F.lit(w)) for u, w in WON_UNITS.items()], F.lit(1))
        if below:
            n = F.when(part(3 if unit else 2) == "미만", F.greatest(n - 1, F.lit(0.0))).otherwise(n)
        told = lambda at: _found(text, at, F.length(found), lambda denied, raw: _condition(key, ~denied, raw, number=n))
        return F.when(found.isNotNull(), _let(F.instr(text, found), told))

    return _let(F.regexp_substr(text, F.lit(pattern)), read)


def _named(text: Column, key: str, words: tuple[str, ...], never=None) -> Column:
    """The words that the text holds; not for machines where any of them is denied at its first place, or where never(words)."""
    lengths = F.create_map(*[x for w in words for x in (F.lit(w), F.lit(len(w)))])

    def read(found: Column) -> Column:
        denied = F.exists(found, lambda w: _let(F.instr(text, w), lambda at: _part(text, at, WINDOW, F.try_element_at(lengths, w) + WINDOW).rlike(NEGATION)))
        fine = ~denied if never is None else ~denied & ~never(found)
        first = F.get(found, F.lit(0))
        raw = _let(F.instr(text, first), lambda at: _raw(_part(text, at, BEFORE, F.length(first) + AFTER)))
        return F.when(F.size(found) > 0, _condition(key, fine, raw, values=found))

    return _let(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)), read)


def _places(text: Column) -> Column:
    """Provinces within REGION_NEAR letters of a word of location, denied by what stands round the first such word that has one.

    Each word of location comes with the WINDOW letters before it and those after it: lookarounds leave them to its neighbours."""
    ahead, behind = WINDOW, WINDOW + 4
    around = rf"(?s)(?={REGION_FIRST})(?=({REGION_WORDS})(.{{0,{behind}}}))(?<=(\A.{{0,{ahead - 1}}}|.{{{ahead}}}))"
    part = lambda i: F.regexp_extract_all(text, F.lit(around), i)
    rest = F.zip_with(part(1), part(2), lambda w, r: F.struct(w.alias("w"), r.alias("r")))
    marks = F.zip_with(part(3), rest, lambda b, x: F.struct(b.alias("b"), x["w"].alias("w"), x["r"].alias("r")))
    near = lambda m: F.concat(F.right(m["b"], F.lit(REGION_NEAR)), m["w"], F.left(m["r"], F.lit(REGION_NEAR)))
    any_place = r"(?U)" + "|".join(r"\s*".join(n) for n in dict.fromkeys(n for names in PROVINCES.values() for n in (names[0], *names)))

    def read(rows: Column) -> Column:
        first = F.get(rows, F.lit(0))["m"]
        after = F.concat(first["w"], first["r"])
        denied = F.concat(first["b"], F.left(after, F.lit(4 + WINDOW))).rlike(NEGATION)
        raw = _raw(F.concat(F.right(first["b"], F.lit(BEFORE)), F.left(after, F.lit(4 + AFTER))))
        return F.when(F.size(rows) > 0, _condition("region", ~denied, raw, values=F.array_distinct(F.flatten(F.transform(rows, lambda r: r["p"])))))

    named = F.filter(F.transform(marks, lambda m: F.struct(m.alias("m"), near(m).alias("near"))), lambda x: x["near"].rlike(any_place))
    told = F.transform(named, lambda x: F.struct(x["m"].alias("m"), _let(compact(x["near"]), provinces_of_compact).alias("p")))
    return F.when(text.rlike(f"(?={REGION_FIRST})(?:{REGION_WORDS})"), _let(F.filter(told, lambda r: F.size(r["p"]) > 0), read))


def extract_conditions(text: Column) -> Column:
    """Numbers of age, workers and revenue, taxes, sizes, lines of business and places, in this order; an empty array where the
    text says nothing. "미만" is one less. What a negation stands beside, and a call for founders-to-be alone, is not for machines.
    raw_text is the part of the text that a condition was read from."""
    units = f"({'|'.join(WON_UNITS)})?"
    founders = lambda found: (F.size(found) == 1) & F.array_contains(found, SIZES[-1])

    def read(own: Column) -> Column:
        tax = _let(F.instr(own, F.lit("체납")), lambda at: F.when(at > 0, _condition("noTaxDelinquency", F.lit(True), _raw(_part(own, at, BEFORE, 2 + AFTER)), flag=F.lit(True))))
        return F.array_compact(F.array(
            _numbered(own, "businessAgeMaxYears", rf"{AGE}{NEAR}{NUMBER}\s*년\s*(이내|미만|이하)", True),
            _numbered(own, "businessAgeMinYears", rf"{AGE}{NEAR}{NUMBER}\s*년\s*이상", False),
            _numbered(own, "employeeMin", rf"{WORKERS}{NEAR}{NUMBER}\s*[인명]\s*이상", False),
            _numbered(own, "employeeMax", rf"{WORKERS}{NEAR}{NUMBER}\s*[인명]\s*(이하|미만)", True),
            _numbered(own, "revenueMaxKrw", rf"{REVENUE}{NEAR}{NUMBER}\s*{units}\s*원\s*(이하|미만)", True, True),
            _numbered(own, "revenueMinKrw", rf"{REVENUE}{NEAR}{NUMBER}\s*{units}\s*원\s*이상", False, True),
            tax,
            _named(own, "companyScale", SIZES, founders),
            _named(own, "industry", INDUSTRY_WORDS),
            _places(own),
        ))

    return _let(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\u00a0]+", " "), read)


def districts_in(text: Column, districts=None) -> Column:
    """Known districts that a title names with a boundary on either side, in the order of the text."""
    known = DISTRICTS if districts is None else districts
    names = "|".join(sorted(known, key=lambda n: (-len(n), n)))
    edge = "가-힣0-9A-Za-z"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<![{edge}])({names})(?![{edge}])"), 1))


def title_regions(title: Column, agency: Column, districts=None) -> Column:
    """Region conditions of a title. "[province] district, ...": the province, unless the agency is of another one, and the
    districts for humans; nothing where what follows the tag isn't districts alone. Else the districts that it names, where they are
    of one province and the agency is of that one."""
    own = F.coalesce(title, F.lit(""))
    tag = r"^\s*\[([^\]]{1,12})\]\s*(\S+)"  # fixed value
    tagged, of_agency = provinces_in(F.regexp_extract(own, tag, 1)), provinces_in(agency)
    heads = F.filter(F.split(F.regexp_extract(own, tag, 2), "[ㆍ·,/]"), lambda x: x != "")
    places = F.filter(heads, lambda x: x.rlike("^.{1,5}[시군구]$") & canonical_region(x).isNull())
    no_clash = (F.size(of_agency) == 0) | F.arrays_overlap(tagged, of_agency)
    raw = _of_title(own)
    by_tag = F.array_compact(F.array(F.when(no_clash, _condition("region", F.lit(True), raw, values=tagged)), _condition("region", F.lit(False), raw, values=places)))
    none = F.array().cast(f"array<{CONDITION_TYPE}>")
    found = districts_in(own, districts)
    sidos = F.array_distinct(F.transform(found, lambda d: district_of(d, districts)["sido"]))
    named = (F.size(found) > 0) & ~own.contains("전국") & (F.size(sidos) == 1) & F.array_contains(of_agency, F.get(sidos, F.lit(0)))
    by_name = F.when(named, F.array(_condition("region", F.lit(True), raw, values=found))).otherwise(none)
    with_tag = F.when((F.size(places) > 0) & (F.size(places) == F.size(heads)), by_tag).otherwise(none)
    return F.when(F.size(tagged) > 0, with_tag).otherwise(by_name)


def _of_title(title: Column) -> Column:
    return F.concat(F.lit(RULE_PREFIX + " "), F.left(title, F.lit(TITLE_LETTERS)))


def _has(conditions: Column, key: str) -> Column:
    return F.exists(conditions, lambda c: c["key"] == key)


def _added(conditions: Column, more: Column) -> Column:
    """Conditions and those that aren't null of an array."""
    return F.concat(conditions, F.array_compact(more))


def loan_conditions(title: Column, agency: Column, conditions: Column) -> Column:
    """What a programme's name asks for, unless its key is there: a guarantee in use at the guarantor, or a loan to refinance."""
    p = loan_programme(title, agency)
    converts = F.when((p["kind"] == "conversion") & ~_has(conditions, "guaranteeInUse"), _condition("guaranteeInUse", F.lit(True), F.concat(p["guarantor"], F.lit(" 보증 이용 중(전환보증)")), values=F.array(p["guarantor"])))
    refinances = F.when((p["kind"] == "refinance") & ~_has(conditions, "hasExistingLoan"), _condition("hasExistingLoan", F.lit(True), F.lit("기존 대출 이용 중(대환)"), flag=F.lit(True)))
    return F.array(converts, refinances)


def _sector(title: Column) -> Column:
    found = sectors_in_title(title)
    return F.when(F.size(found) > 0, _condition("targetSector", F.lit(True), _of_title(F.coalesce(title, F.lit(""))), values=found))


def rule_conditions(target: Column, summary: Column, title: Column, agency: Column, districts=None) -> Column:
    """Conditions of a notice that no model has read: of its body and title, its title's places (those for machines only where the
    body has none) and its title's sectors. Fields are joined by newlines, so that no rule reaches across."""
    some = lambda x: F.nullif(x, F.lit(""))
    body = extract_conditions(F.concat_ws("\n", some(target), some(summary), some(title)))
    placed = F.exists(body, lambda c: (c["key"] == "region") & c["machine_readable"])
    of_title = F.filter(title_regions(title, agency, districts), lambda c: ~(placed & c["machine_readable"]))
    return _added(F.concat(body, of_title), F.array(_sector(title)))


def augmented(conditions: Column, title: Column, agency: Column, region: Column, from_field: bool = False, districts=None) -> Column:
    """Conditions with what title and fields add. Places of the title for machines where no readable place is there (districts not
    beside a nationwide one); else, if wanted and no region is there at all, those of the region field. Then a sector of the title
    and a loan programme, each unless its key is there."""
    machine = F.filter(conditions, lambda c: (c["key"] == "region") & c["machine_readable"])
    readable = F.exists(machine, lambda c: F.exists(c["values"], lambda v: (F.size(provinces_in(v)) > 0) | district_of(v, districts).isNotNull()))
    nationwide = F.exists(machine, lambda c: F.exists(c["values"], lambda v: v.contains("전국")))
    of_title = F.filter(title_regions(title, agency, districts), lambda c: c["machine_readable"] & ~(nationwide & F.forall(c["values"], lambda v: district_of(v, districts).isNotNull())))
    field = region_from_field(F.trim(region))
    of_field = F.array_compact(F.array(F.when(F.lit(from_field) & ~_has(conditions, "region") & field.isNotNull(), _condition("region", F.lit(True), F.concat(F.lit("[공고 지역 칸] "), F.trim(region)), values=field))))
    none = F.array().cast(f"array<{CONDITION_TYPE}>")
    places = F.when(readable, none).when(F.size(of_title) > 0, of_title).otherwise(of_field)
    sector = F.array(F.when(~_has(conditions, "targetSector"), _sector(title)))
    return _added(_added(F.concat(conditions, places), sector), loan_conditions(title, agency, conditions))
