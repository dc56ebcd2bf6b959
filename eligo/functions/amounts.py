"""The amount that one company gets, read from a text: candidates are judged by the words round their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligo.functions.korean import won_of
from eligo.functions.notices import percent_support

#: An amount after a word of limit, and one without.
NUMBER = r"[0-9,.]+\s*(?:억|천만|백만|만|천)(?:\s*[0-9,.]+\s*(?:천만|백만|만|천))?\s*원?"
HEADED = rf"(?:(1개사당|개사당|기업당|업체당|건당|점포당|인당)\s*)?(최대|한도|기업당|업체당|건당|점포당|인당|최고)[:：]?\s*({NUMBER})"
#: Words before an amount of a whole programme, words of one company's share, and from where on they are needed.
PROGRAMME = "총|규모|예산|조성|펀드|기금|재원|출자"
EACH = "1개사당|개사당|기업당|업체당|사업자당|차주당|건당|점포당|인당"
LARGE_WON = 10_000_000_000
#: Words of a threshold that a company must meet, before and after an amount; words of a limit.
THRESHOLD_NOUN = "매출액|매출|자본금|총자산|자산|부채|보험료|납입|가입"
COMPARED = "이하|미만|이상|초과|넘는|까지의"
LIMIT_WITH_TAIL = r"한도액|한도|최대|최고|지원(?!\s*(?:대상|자격|요건))|융자|대출|보증"
LIMIT_EXPLICIT = "한도액|한도"
LIMIT_BETWEEN = r"최대|최고|한도|까지|지원금|지원(?!\s*(?:대상|자격|요건))"
#: Letters looked at before an amount, for each purpose, and after it; letters of a text that may hold a bare amount.
NEAR, NEAR_NOUN, NEAR_EACH, AFTER, SHORT = 8, 10, 16, 6, 80


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as an array of (at, match), places from 1 on."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern)
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(found, lambda m, i: F.struct((length(F.slice(pieces, 1, i + 1)) + length(F.slice(found, 1, i)) + 1).alias("at"), m.alias("match")))


def _before(text: Column, at: Column, n: int) -> Column:
    start = F.greatest(at - n, F.lit(1))
    return F.substring(text, start, at - start)


def _after_noun(before: Column) -> Column:
    """What stands between the last noun of a threshold and the amount; null without one."""
    return F.when(before.rlike(THRESHOLD_NOUN), F.regexp_replace(before, f"(?s)^.*(?:{THRESHOLD_NOUN})", ""))


def _threshold(text: Column, at: Column, n: Column) -> Column:
    """Whether an amount is one that a company must meet."""
    before, tail = _before(text, at, NEAR_NOUN), F.substring(text, at + n, F.lit(AFTER))
    between = _after_noun(before)
    compared = F.when(between.isNotNull(), ~between.rlike(LIMIT_EXPLICIT)).otherwise(~before.rlike(LIMIT_WITH_TAIL))
    return F.when(tail.rlike(COMPARED), compared).otherwise(between.isNotNull() & ~F.coalesce(between.rlike(LIMIT_BETWEEN), F.lit(False)))


def _own_clause(before: Column) -> Column:
    """The letters since the last mark that ends a clause; a colon ends one only after an amount."""
    own = F.regexp_replace(before, r"(?s)^.*[;,.·/\n]", "")
    return F.regexp_replace(own, r"(?s)^.*[0-9][0-9,.]*\s*(?:억|만|천|원).*?[:：]", "")


def _counts(text: Column, at: Column, n: Column, won: Column, each: Column) -> Column:
    named = each | _own_clause(_before(text, at, NEAR_EACH)).rlike(EACH)
    return won.isNotNull() & ~_threshold(text, at, n) & ~_before(text, at, NEAR).rlike(PROGRAMME) & ((won < LARGE_WON) | named)


def largest_amount(text: Column) -> Column:
    """Won that a company gets at most: the largest headed amount that counts; without one, and without a support in percent, the
    largest bare amount of a short text; else null."""
    own = F.coalesce(text, F.lit(""))

    def headed(x: Column) -> Column:
        amount = F.regexp_extract(x["match"], HEADED, 3)
        at = x["at"] + F.length(x["match"]) - F.length(amount)
        each = F.regexp_extract(x["match"], HEADED, 1).rlike(EACH) | F.regexp_extract(x["match"], HEADED, 2).rlike(EACH)
        return F.when(_counts(own, at, F.length(amount), won_of(amount), each), won_of(amount))

    bare = lambda x: F.when(_counts(own, x["at"], F.length(x["match"]), won_of(x["match"]), F.lit(False)), won_of(x["match"]))
    best = F.array_max(F.transform(located(own, HEADED), headed))
    short = F.when((F.length(own) <= SHORT) & (percent_support(own) == ""), F.array_max(F.transform(located(own, NUMBER), bare)))
    return F.coalesce(best, short)
