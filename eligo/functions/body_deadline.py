"""The application period that a body of text tells: every label and keyword is a candidate with its surroundings, candidates are
ranked, the best one is the deadline. Each rule reads the text once; what a candidate needs is in its own window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.functions.korean import day_end, day_start, kst_date, squeezed

#: Labels of periods, words of deadlines, words of periods without an end.
LABELS = r"신청\s*[·ㆍ・]\s*접수기간|접수기간|신청기간|모집기간|접수 기간|신청 기간|공모기간|공고일정"
KEYWORDS = "접수마감|신청마감|마감|기한|까지"
OPEN = r"(?U)예산\s*소진|상시|선착순"
TILDES = "[~～〜∼]"
#: What makes numbers an amount and not a day.
UNITS = "억|천만|백만|만|원|%|퍼센트|배|명|개|건|년|주|시간|kg|㎡"
MONTH, DAY = "(?:1[0-2]|0?[1-9])", "(?:3[01]|[12][0-9]|0?[1-9])"
_TAIL = rf"(?![0-9])\s*일?(?!\s*(?:{UNITS}))"
#: A day with its year, with two digits of it, without.
DATE = (
    rf"(?U)20[0-9]{{2}}\s*[.\-/년]\s*{MONTH}\s*[.\-/월]\s*{DAY}{_TAIL}"
    rf"|(?<![0-9])[0-9]{{2}}\s*[.\-/]\s*{MONTH}\s*[.\-/]\s*{DAY}{_TAIL}"
    rf"|(?<![0-9]){MONTH}\s*[./월]\s*{DAY}{_TAIL}"
)
#: Letters read after a label, on either side of a keyword, shown as evidence; days back to which a day without
#: a year is this year's; years from now within which an end is believed.
AFTER_LABEL, AROUND, SHOWN = 120, 40, 80
WRAP_DAYS, YEARS_BACK, YEARS_AHEAD = 30, 2, 3

_LABEL = rf"(?sU)({LABELS})(?=(.{{0,{AFTER_LABEL}}}))"
_KEYWORD = rf"(?s)(?={KEYWORDS})(?<=(\A.{{0,{AROUND - 1}}}|.{{{AROUND}}}))({KEYWORDS})(?=(.{{0,{AROUND}}}))"
_MARK = "\u0001"


def _each(rows: Column, **steps) -> Column:
    """Rows with a column added for each step; a step sees those before it once they are computed."""
    for name, step in steps.items():
        rows = F.transform(rows, lambda r: r.withField(name, step(r)))  # noqa: B023
    return rows


def _ranked(rows: Column) -> Column:
    """Rows with a rank, the earlier the higher."""
    return F.transform(rows, lambda r, i: r.withField("rank", -i))


def _numbers(day: Column) -> Column:
    """Numbers of a day's text: year, month, day or month, day; null without a day."""
    return F.when(day != "", F.transform(F.regexp_extract_all(day, F.lit("[0-9]+"), 0), lambda x: x.cast("int")))


def _first_day(text: Column) -> Column:
    return _numbers(F.regexp_extract(text, DATE, 0))


def _from_last_day(text: Column) -> Column:
    """A text from its last day on; null without one."""
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), DATE, _MARK + "$0")
    return F.when(F.contains(marked, F.lit(_MARK)), F.substring_index(marked, _MARK, -1))


def _year(day: Column) -> Column:
    first = F.get(day, F.lit(0))
    return F.when(F.size(day) == 3, F.when(first < 100, first + 2000).otherwise(first))


def _date(day: Column, year: Column) -> Column:
    """The calendar day, null where there is none such."""
    written = F.format_string("%04d%02d%02d", year, F.element_at(day, -2), F.element_at(day, -1))
    return F.when(day.isNotNull() & year.isNotNull(), F.to_date(F.try_to_timestamp(written, F.lit("yyyyMMdd"))))


def _believed(end: Column, now: Column) -> Column:
    at = day_end(end)
    return (at <= now + F.expr(f"INTERVAL {YEARS_AHEAD} YEARS")) & (at >= now - F.expr(f"INTERVAL {YEARS_BACK} YEARS"))


def _end(day: Column, year: Column, start: Column, posted: Column) -> Column:
    """The end's day; one without a year that lies before the start, or long before the posting, is the next year's."""
    end = _date(day, year)
    early = F.when(start.isNotNull(), end < start).otherwise(day_end(end) < posted - F.expr(f"INTERVAL {WRAP_DAYS} DAYS"))
    return F.when((F.size(day) == 2) & early, _date(day, year + 1)).otherwise(end)


def _evidence(text: Column) -> Column:
    return F.left(squeezed(text), F.lit(SHOWN))


def _labelled(text: Column, now: Column, posted: Column) -> Column:
    """Of the labels' periods the one that ends last, the first of equals; without any, the first open one."""
    none = F.lit(None).cast("array<int>")
    base = F.year(kst_date(posted))
    labels, windows = F.regexp_extract_all(text, F.lit(_LABEL), 1), F.regexp_extract_all(text, F.lit(_LABEL), 2)
    rows = _each(
        _ranked(F.zip_with(labels, windows, lambda label, window: F.struct(label.alias("label"), window.alias("window")))),
        open=lambda r: r["window"].rlike(OPEN),
        sides=lambda r: F.split(r["window"], TILDES, 2),
        first=lambda r: F.when(r["open"], _first_day(r["window"])).when(F.size(r["sides"]) == 2, _first_day(_from_last_day(F.get(r["sides"], F.lit(0))))),
        last=lambda r: F.when(~r["open"] & (F.size(r["sides"]) == 2), _first_day(F.get(r["sides"], F.lit(1)))).otherwise(none),
        year=lambda r: F.coalesce(_year(r["first"]), _year(r["last"]), base),
        start=lambda r: _date(r["first"], r["year"]),
        end=lambda r: _end(r["last"], F.coalesce(_year(r["last"]), F.year(r["start"]), r["year"]), r["start"], posted),
    )
    fine = F.filter(rows, lambda r: r["open"] | (r["end"].isNotNull() & F.coalesce(r["start"] <= r["end"], F.lit(True)) & _believed(r["end"], now)))
    ranked = F.transform(fine, lambda r: F.struct(F.coalesce(r["end"], F.lit("0001-01-01").cast("date")).alias("by"), r["rank"], r["start"], r["end"], _evidence(F.concat(r["label"], r["window"])).alias("evidence")))
    return F.array_max(ranked)


def _keyed(text: Column, now: Column, posted: Column) -> Column:
    """The first keyword whose closest day can be the end; without any, the last one that stands in an open period."""
    base = F.year(kst_date(posted))
    found = lambda i: F.regexp_extract_all(text, F.lit(_KEYWORD), i)
    sides = F.zip_with(found(1), found(3), lambda left, right: F.struct(left.alias("left"), right.alias("right")))
    rows = _each(
        _ranked(F.zip_with(sides, found(2), lambda side, word: side.withField("word", word))),
        open=lambda r: F.concat(r["left"], r["word"], r["right"]).rlike(OPEN),
        back=lambda r: F.when(~r["open"], _from_last_day(r["left"])),
        ahead=lambda r: F.when(~r["open"], F.regexp_instr(r["right"], F.lit(DATE))),
        near=lambda r: F.when((r["ahead"] > 0) & (r["back"].isNull() | (F.length(r["word"]) + r["ahead"] - 1 < F.length(r["back"]))), _first_day(r["right"])).otherwise(_first_day(r["back"])),
        end=lambda r: _end(r["near"], F.coalesce(_year(r["near"]), base), F.lit(None).cast("date"), posted),
    )
    fine = F.filter(rows, lambda r: r["open"] | (r["end"].isNotNull() & _believed(r["end"], now)))
    ranked = F.transform(fine, lambda r: F.struct(r["end"].isNotNull().alias("closed"), F.when(r["open"], -r["rank"]).otherwise(r["rank"]).alias("rank"), F.lit(None).cast("date").alias("start"), r["end"], _evidence(F.concat(r["left"], r["word"], r["right"])).alias("evidence")))
    return F.array_max(ranked)


def body_deadline(text: Column, now: Column, posted: Column) -> Column:
    """(start, end, evidence) of the application period in a text, UTC instants of Korean days; an open period has no end. Labels
    go before keywords. `posted` (null: now) gives the year to days without one. Null where nothing is told: null, empty and
    blank texts too."""
    posted = F.coalesce(posted, now)
    told = lambda best: F.get(F.transform(F.filter(F.array(best), lambda r: r.isNotNull()), lambda r: F.struct(day_start(r["start"]).alias("start"), day_end(r["end"]).alias("end"), r["evidence"].alias("evidence"))), F.lit(0))
    return F.coalesce(told(_labelled(text, now, posted)), told(_keyed(text, now, posted)))
