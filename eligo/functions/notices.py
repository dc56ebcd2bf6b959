"""Column expressions that judge notices: titles that offer nothing, loan programmes, own shares, words of deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.functions.korean import kst_date, squeezed
from eligo.functions.regions import PROVINCES, canonical_region, provinces_in

#: Titles that are no programme, and those that hire for one all the same.
NON_PROGRAM = r"선정\s*결과|결과\s*(?:공고|발표|안내)|합격자|최종\s*선정자|평가\s*위원|심사\s*위원|매각|입찰|낙찰|(?:직원|신규|경력|정규직|계약직)\s*채용|채용\s*공고|초빙|설문\s*조사|스팸|사칭"
HIRING_NOTICE = r"(?:직원|신규|경력|정규직|계약직)\s*채용|채용\s*공고"
HIRING_AID = r"채용\s*(?:지원|장려)|인건비|장려금|지원금|보조금"
OPERATOR_CALL = r"(?:자문|심사|평가|전문|운영)\s*위원\s*(?:모집|위촉|공모|선정)|(?:강사|멘토|전문가|컨설턴트|자문단|지원단)\s*(?:모집|위촉|공모|풀\s*모집)|(?:수행|운영|위탁|주관|전담)\s*(?:기관|단체)\s*(?:모집|공모|선정|재공모)|(?:수행|공급)\s*(?:기업|업체|사)\s*(?:모집|공모|선정|등록)|운영자\s*(?:선정|모집)|관리\s*위탁|채용\s*시험|경력\s*경쟁|공무원\s*(?:채용|임용|시험)"
ENDED_NOTICE = r"종료\s*안내\s*(?:[(（\[](?:[^()（）\[\]]|[(（][^()（）]*[)）])*[)）\]]\s*)*$"
ENDED_CALL = r"모집[^및,]*(?:및|,)[^및,]*종료\s*안내"
REASONS = {"notice": "지원사업 공고가 아닌 글", "operator": "운영기관·위원·강사 모집 글"}
#: Programmes that turn a guarantee or a loan into another one, and their guarantors.
CONVERSION = (r"(?:^|[^가-힣])전환\s*보증", r"보증\s*전환", r"보증\s*통합")
REFINANCE = (r"대환(?![영경])", r"차환(?![영경])", r"(?:^|[^가-힣])전환\s*대출")
KODIT, KIBO, REGIONAL, FOUNDATION = "신용보증기금", "기술보증기금", "지역신용보증재단", "신용보증재단"
KODIT_SHORT, KIBO_SHORT = r"(?:^|[^가-힣])신보(?!증)", r"(?:^|[^가-힣])기보(?!증)"
#: Wordings of an own share.
COPAY_PERCENT = r"(?:자부담|자기\s*부담|본인\s*부담|기업\s*부담|참여\s*기업\s*부담|민간\s*부담)\s*(?:금|비율)?\s*[:：]?\s*(?:총\s*사업비의?\s*)?([0-9]{1,2}(?:\.[0-9]+)?)\s*%"
COPAY_WORDS = r"자부담|자기\s*부담|본인\s*부담|기업\s*부담금|매칭\s*(?:펀드|자금|비율|투자)|대응\s*자금|민간\s*부담"
NO_COPAY = r"자부담\s*(?:없음|없이|0\s*%|면제)|자기\s*부담\s*(?:없음|없이)|전액\s*(?:무상|지원)|100\s*%\s*(?:무상\s*)?지원"
OWN_VAT = r"부가\s*(?:가치)?\s*세\s*(?:\(?\s*VAT\s*\)?\s*)?(?:는|은)?\s*(?:별도|제외|미포함|불포함|(?:기업|자부담|본인|신청자|참여\s*기업|수혜\s*기업)\s*(?:부담|에서))"
SUPPORT_PERCENT = r"(?:총\s*)?(?:사업비|비용|소요\s*비용|구입\s*비|구매\s*비|공급\s*가액)\s*의?\s*([0-9]{2})\s*%\s*(?:이내|까지|를|만)?\s*(?:\(?[^)]{0,12}\)?\s*)?(?:지원|보조)"
#: Letters of a deadline's own words in a chip.
CHIP_LETTERS = 14
#: A support in percent, and words beside it that mean something else.
PERCENT_SUPPORT = r"(?<![0-9.,])([0-9]{1,3}(?:\.[0-9]+)?)\s*%\s*(이내|까지|한도)?\s*(지원|보조)"
NOT_SUPPORT = r"자부담|감소|이상|이하|증가"

_NAMES = "|".join(sorted((n for names in PROVINCES.values() for n in names), key=lambda n: (-len(n), n)))
_FOUNDATION_OF = rf"({_NAMES})\s*(?:신용보증재단|신보)"


def any_rule(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def no_programme(title: Column) -> Column:
    """Why a title is no offer: an ended or a plain notice, a call for operators; null for others. Notices that hire with aid are
    offers."""
    own = F.coalesce(title, F.lit(""))
    hires = own.contains("채용") & own.rlike(HIRING_AID) & ~F.regexp_replace(own, HIRING_NOTICE, " ").rlike(NON_PROGRAM)
    ended = own.rlike(ENDED_NOTICE) & ~own.rlike(ENDED_CALL)
    return F.when(ended | (own.rlike(NON_PROGRAM) & ~hires), REASONS["notice"]).when(own.rlike(OPERATOR_CALL), REASONS["operator"])


def foundation_in(text: Column) -> Column:
    """The first regional foundation named in a text, by its province's short name."""
    return F.concat(canonical_region(F.nullif(F.regexp_extract(text, _FOUNDATION_OF, 1), F.lit(""))), F.lit(FOUNDATION))


def loan_programme(title: Column, agency: Column) -> Column:
    """(kind, guarantor) of a programme that converts a guarantee or refinances a loan; null for other titles."""
    text = F.concat_ws(" ", title, agency)
    guarantor = F.coalesce(
        foundation_in(title), foundation_in(agency), F.when(text.contains(KODIT) | text.rlike(KODIT_SHORT), KODIT), F.when(text.contains(KIBO) | text.rlike(KIBO_SHORT), KIBO), F.lit(REGIONAL)
    )
    row = lambda kind, g: F.struct(F.lit(kind).alias("kind"), g.cast("string").alias("guarantor"))
    return F.when(any_rule(title, CONVERSION), row("conversion", guarantor)).when(any_rule(title, REFINANCE), row("refinance", F.lit(None)))


def guarantors_in(text: Column) -> Column:
    """All guarantors that a text names: regional foundations, any other foundation, the two funds."""
    named = F.transform(F.regexp_extract_all(text, F.lit(_FOUNDATION_OF), 1), lambda x: F.concat(canonical_region(x), F.lit(FOUNDATION)))
    rest = F.regexp_replace(text, _FOUNDATION_OF, " ")
    more = F.array(F.when(rest.contains("재단"), F.lit(REGIONAL)), F.when(rest.contains(KODIT) | rest.rlike(KODIT_SHORT), F.lit(KODIT)), F.when(rest.contains(KIBO) | rest.rlike(KIBO_SHORT), F.lit(KIBO)))
    return F.array_distinct(F.array_compact(F.concat(named, more)))


def copay_of(texts: Column) -> Column:
    """(copay, label) of an array of texts: a percentage and VAT, else a support below all, else the bare word; or none."""
    every = F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), " \n ")
    part = lambda p: F.nullif(F.regexp_extract(every, p, 1), F.lit(""))
    percent, support = part(COPAY_PERCENT), part(SUPPORT_PERCENT).cast("int")
    first = F.array_compact(F.array(F.when(percent.isNotNull(), F.concat(F.lit("자부담 "), percent, F.lit("%"))), F.when(every.rlike(OWN_VAT), F.lit("부가세 고객 부담"))))
    by_support = F.concat(F.lit("총사업비 "), support.cast("string"), F.lit("% 지원(자부담 "), (100 - support).cast("string"), F.lit("%)"))
    free = every.rlike(NO_COPAY)
    label = F.when(F.size(first) > 0, F.array_join(first, " · ")).when(support < 100, by_support).when(every.rlike(COPAY_WORDS) & ~free, "자부담 있음(비율 원문 확인)")
    return F.struct(label.isNotNull().alias("copay"), F.coalesce(label, F.when(free, "자부담 없음"), F.lit("자부담 원문에 없음")).alias("label"))


def deadline_words(deadline: Column, end: Column, text: Column, now: Column) -> Column:
    """(chip, long, tone) of a deadline, and of an end and the words of its period."""
    kind, days, left = deadline["kind"], deadline["d_day"], deadline["end_d_day"]
    day = F.concat(F.month(kst_date(end)).cast("string"), F.lit("월 "), F.dayofmonth(kst_date(end)).cast("string"), F.lit("일"))
    n, said = days.cast("string"), squeezed(text)
    row = lambda chip, long, tone: F.struct((F.lit(chip) if isinstance(chip, str) else chip).alias("chip"), (F.lit(long) if isinstance(long, str) else long).alias("long"), F.lit(tone).alias("tone"))
    until = F.concat(F.lit("마감 D-"), left.cast("string"))
    dated = (
        F.when(days < 0, row("마감됨", "마감됨", "plain"))
        .when(days == 0, row("오늘 마감", "오늘 마감", "red"))
        .when(days == 1, row(F.concat(F.lit("내일("), day, F.lit(") 마감")), F.concat(F.lit("내일("), day, F.lit(") 마감")), "red"))
        .when(days <= 7, row(F.concat(n, F.lit("일 남음")), F.concat(n, F.lit("일 남음 ("), day, F.lit(" 마감)")), "red"))
        .otherwise(row(F.concat(day, F.lit(" 마감")), F.concat(day, F.lit(" 마감")), "plain"))
    )
    soon = F.concat(n, F.lit("일 뒤 접수 시작"))
    upcoming = F.when(left >= 0, row(F.concat(F.lit("접수 예정 · "), until), F.concat(soon, F.lit(" · "), until), "plain")).otherwise(row(soon, soon, "plain"))
    chip = F.when(F.length(said) > CHIP_LETTERS, F.concat(F.left(said, F.lit(CHIP_LETTERS)), F.lit("…"))).otherwise(said)
    return (
        F.when(kind == "date", dated)
        .when(kind == "upcoming", upcoming)
        .when(kind == "always", row("상시 접수", "상시 접수", "green"))
        .when(kind == "budget", row("예산 소진 시 마감", "예산 소진 시 마감", "plain"))
        .when(kind == "text", row(chip, said, "plain"))
        .when(kind == "closed", row("마감됨", "마감됨", "plain"))
        .otherwise(row("기간 미기재", "기간 미기재", "plain"))
    )


def percent_support(text: Column) -> Column:
    """"N% support" of a text without words of an own share or a change within eight letters; else empty."""
    found = F.regexp_substr(text, F.lit(PERCENT_SUPPORT))
    at = F.instr(text, found)
    start = F.greatest(at - 8, F.lit(1))
    near = F.substring(text, start, at + F.length(found) + 8 - start)
    return F.when(found.isNotNull() & ~near.rlike(NOT_SUPPORT), squeezed(found)).otherwise("")


def region_from_field(text: Column) -> Column:
    """Provinces of an announcement's region field, where it makes a condition: not nationwide, not all of them; else null."""
    named = provinces_in(text)
    return F.when(~F.coalesce(text, F.lit("")).contains("전국") & F.size(named).between(1, len(PROVINCES) - 1), named)


def body_digest(body: Column) -> Column:
    """Length and the first 16 hex digits of the digest of its first 200 letters: tells whether an attachment's text changed."""
    own = F.trim(F.coalesce(body, F.lit("")))
    digest = F.left(F.sha2(F.left(own, F.lit(200)), 256), F.lit(16))
    return F.concat(F.length(own).cast("string"), F.lit(":"), F.when(own == "", "").otherwise(digest))


def fits_prompt(text: Column, most: int = 160_000, overhead: int = 4_096) -> Column:
    """Whether a text's UTF-8 bytes and the overhead stay within a prompt."""
    return F.octet_length(F.coalesce(text, F.lit(""))) + overhead <= most




#: Kinds of a same document in the order in which one is taken.
SAME_DOCUMENT = ("hwpx", "hwp", "pdf", "odt", "hml", "docx", "doc")
#: First bytes of formats, in hexadecimal.
FORMATS = {"pdf": ("25504446",), "hwp": ("D0CF11E0A1B11AE1",), "zip": ("504B0304",), "image": ("FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "49492A00", "4D4D002A")}


def format_of(body: Column) -> Column:
    """pdf, hwp, zip, image, hml or html by the first bytes of a body; null for others."""
    head = F.hex(F.substring(body, 1, 16))
    text = F.ltrim(F.regexp_replace(F.try_validate_utf8(F.substring(body, 1, 1024)), "^\ufeff", ""))
    marked = F.coalesce(*[F.when(head.startswith(sig), F.lit(kind)) for kind, sigs in FORMATS.items() for sig in sigs])
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.coalesce(marked, F.when(webp, "image"), F.when(text.startswith("<") & text.rlike("(?i)<HWPML[\\s>]"), "hml"), F.when(text.rlike("(?is)^<(?:!doctype html|html[\\s>])"), "html"))


def same_document(name: Column) -> Column:
    """(key, rank) of a file's name: names that differ in their format only are one document, of which the first format is taken."""
    own = F.trim(F.coalesce(name, F.lit("")))
    kind, stem = F.lower(F.regexp_extract(own, r"\.([^.]*)$", 1)), squeezed(F.lower(F.regexp_replace(own, r"\.[^.]*$", "")))
    rank = F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(SAME_DOCUMENT)])
    return F.when(rank.isNotNull() & (stem != ""), F.struct(stem.alias("key"), rank.alias("rank")))


def schedule_percent(start: Column, end: Column, now: Column) -> Column:
    """How much of an application period is over, in Korean days; 100 for a single day, null where an end is missing or before the
    start."""
    total, passed = F.datediff(kst_date(end), kst_date(start)), F.datediff(kst_date(now), kst_date(start))
    return F.when(total == 0, 100).when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(passed / total * 100 + 0.5).cast("int"))))


#: Months, days, and what after a number makes it no day.
_MONTH, _DAY = "(1[0-2]|0?[1-9])", "(3[01]|[12][0-9]|0?[1-9])"
_NO_DAY = r"(?!\s*(?:억|천만|백만|만|원|%|퍼센트|배|명|개|건|년|주|시간|kg|㎡))"
TITLE_YEAR = rf"~\s*([0-9]{{2}})\s*\.\s*{_MONTH}\s*\.\s*{_DAY}(?![0-9]){_NO_DAY}"
TITLE_DAY = rf"~\s*{_MONTH}\s*[./월]\s*{_DAY}(?![0-9]){_NO_DAY}"
TITLE_UNTIL = rf"{_MONTH}\s*[./월]\s*{_DAY}\s*일?{_NO_DAY}[^~]{{0,12}}까지"


def title_deadline(title: Column, registered: Column) -> Column:
    """The end that a title names, as year-month-day: "~yy.m.d", "~m.d" or "m월 d일까지", a year that isn't there being that of the
    registration, or the next for an earlier month; empty without one, or where it lies before the registration."""
    part = lambda p, i: F.regexp_extract(title, p, i)
    two = lambda x: F.lpad(x, 2, "0")
    known = registered.rlike("^[0-9]{4}-[0-9]{2}")
    year, month = F.left(registered, F.lit(4)).cast("int"), F.substring(registered, 6, 2).cast("int")

    def dated(p: str) -> Column:
        own = F.when(part(p, 1).cast("int") < month, year + 1).otherwise(year)
        return F.when(known, F.concat_ws("-", own.cast("string"), two(part(p, 1)), two(part(p, 2)))).otherwise("")

    with_year = F.concat(F.lit("20"), part(TITLE_YEAR, 1), F.lit("-"), two(part(TITLE_YEAR, 2)), F.lit("-"), two(part(TITLE_YEAR, 3)))
    found = F.when(title.rlike(TITLE_YEAR), with_year).when(title.rlike(TITLE_DAY), dated(TITLE_DAY)).when(title.rlike(TITLE_UNTIL), dated(TITLE_UNTIL)).otherwise("")
    past = registered.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (found < registered)
    return F.when((found != "") & ~F.coalesce(past, F.lit(False)), found).otherwise("")


#: Fixed value: marks that two conditions' texts may differ in.
CONDITION_MARKS = r"(?U)[\s.,:;·()（）「」\"'-]"
LEAST_PART = 6


def same_condition(a: Column, b: Column, least: int = LEAST_PART) -> Column:
    """Two texts of one condition: equal without marks, or the shorter one within the longer, with `least` letters at least."""
    x, y = F.regexp_replace(a, CONDITION_MARKS, ""), F.regexp_replace(b, CONDITION_MARKS, "")
    inside = F.when(F.length(x) <= F.length(y), (F.length(x) >= least) & y.contains(x)).otherwise((F.length(y) >= least) & x.contains(y))
    return (x != "") & (y != "") & ((x == y) | inside)


def merged_rows(checks: Column, told: Column) -> Column:
    """checks and told: arrays of (text, verdict). Each told one goes to the first check of the same condition, and decides it where
    it is unknown; the others are appended in order."""
    of = lambda t: F.get(F.filter(F.transform(checks, lambda c, i: F.when(same_condition(c["text"], t["text"]), i)), lambda i: i.isNotNull()), F.lit(0))
    placed = F.transform(told, lambda t: F.struct(of(t).alias("at"), t["text"].alias("text"), t["verdict"].alias("verdict")))

    def decided(c: Column, i: Column) -> Column:
        says = F.get(F.filter(placed, lambda p: (p["at"] == i) & (p["verdict"] != "unknown")), F.lit(0))
        return F.struct(c["text"].alias("text"), F.when(c["verdict"] == "unknown", F.coalesce(says["verdict"], c["verdict"])).otherwise(c["verdict"]).alias("verdict"))

    more = F.transform(F.filter(placed, lambda p: p["at"].isNull()), lambda p: F.struct(p["text"].alias("text"), p["verdict"].alias("verdict")))
    return F.concat(F.transform(checks, decided), more)


def csv_cells(line: Column) -> Column:
    """Cells of a line of comma-separated values; quoted cells may hold commas and doubled quotes."""
    cell = r'(?:^|,)((?:"(?:[^"]|"")*"|[^,"])*)'
    bare = lambda x: F.replace(F.regexp_replace(x, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(F.regexp_extract_all(line, F.lit(cell), 1), lambda x: bare(x))


def table_cells(line: Column) -> Column:
    """Cells of a table's row: by tabs where it has one, else by bars, else by commas."""
    by_bars = F.split(F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", ""), r"\|")
    return F.when(line.contains("\t"), F.split(line, "\t")).when(line.contains("|"), by_bars).otherwise(csv_cells(line))


def storable(text: Column) -> Column:
    """Without the characters that no store takes."""
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def ordered_labels(labels: Column) -> Column:
    """Distinct labels in their order, trimmed, without blank ones."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != ""))
