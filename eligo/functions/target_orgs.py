"""Kinds of organisation that a title declares as its target. The grammar of declarations (a word, further words over list marks,
an end that neither denies nor goes on) is regular, so each kind is one pattern, compiled once from the tables below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and the words that titles have for them.
KINDS = {
    "사회적기업": ("사회적기업", "예비사회적기업", "(예비)사회적기업"),
    "사회적경제": ("사회적경제기업", "사회적경제조직"),
    "협동조합": ("협동조합",),
    "마을기업": ("마을기업",),
    "자활기업": ("자활기업",),
    "소셜벤처": ("소셜벤처",),
    "착한가격업소": ("착한가격업소", "착한가격"),
    "예비창업자": ("예비창업자", "예비 창업자", "예비창업팀"),
}
#: Fixed value: kinds that are a state and not something a notice grants.
STATES = ("예비창업자",)
#: Ends of organisations' names; what may follow a list mark though no kind names it.
NAME_ENDS = ("기업", "업소", "자", "기관", "조합", "벤처", "조직", "팀")
LISTED = "[가-힣]{2,12}(?:회사|조합|조직|단체|법인)(?![가-힣])"
#: Words after a kind by which it is a counterparty, or still to be gained; bare documents.
COUNTERPARTY = "실증|납품|제안|협업|공동|연계|협력"
TO_BE_GAINED = r"모집|지정|공모|신규|설립|창업|양성|입문|전환|희망|되기\s*위|준비\s*단계"
BARE = r"(?:공고|안내|계획|알림|공지|공모전)(?:\s|$|[()\[\]（）「」])"
#: Fixed value: words in a row that are followed after the first.
FURTHER = 7

_MARK = r"[·ㆍ,、/]|및|과\s|와\s"
_SPACE = r"\s|등(?=[\s·ㆍ,、/]|$)"
_BRIDGE = f"(?:{_SPACE}|{_MARK})*+"


def _quoted(words) -> str:
    return "|".join(rf"\Q{w}\E" for w in sorted(words, key=lambda w: (-len(w), w)))


_WORDS = [w for words in KINDS.values() for w in words]
_WORD = f"(?>{_quoted(_WORDS)})"
_NAMES = f"(?:{_quoted(w for w in _WORDS if w.endswith(NAME_ENDS))})"


def _declared(words: tuple[str, ...], denied: str) -> str:
    """A pattern of one of the words, those in a row with it, and a right end."""
    guard = rf"(?!\s*등[^\s·ㆍ,、/])(?!{_BRIDGE}(?:{denied}|{BARE}))"
    further = f"{guard}{_BRIDGE}{_WORD}"
    direct = f"(?![가-힣]|{_SPACE}|{_MARK})"
    spaced = f"(?=(?:{_SPACE})++(?!{_MARK}))"
    listed = f"(?=(?:{_SPACE})*+(?:{_MARK}){_BRIDGE}{LISTED})"
    rest = f"(?:{further}){{0,{FURTHER}}}{guard}(?!{_BRIDGE}{_WORD})(?:{direct}|{spaced}|{listed})"
    named = [w for w in words if w.endswith(NAME_ENDS)]
    others = [w for w in words if w not in named]
    starts = [f"(?:{_quoted(named)})"]
    if others:  # a row needs a name somewhere
        starts.append(f"(?:{_quoted(others)})(?=(?:{guard}{_BRIDGE}(?!{_NAMES})(?:{_quoted(others)}))*+{guard}{_BRIDGE}{_NAMES})")
    return f"(?:{'|'.join(starts)}){rest}"


def _pattern(kind: str, sure: bool) -> str:
    words, full = KINDS[kind], f"{TO_BE_GAINED}|{COUNTERPARTY}"
    if kind not in STATES:
        return "(?U)" + _declared(words, full)
    if not sure:
        return "(?U)" + _declared(words, COUNTERPARTY)
    after_other = r"(?:및|과|와|[·ㆍ,、/])\s{0,20}"
    return f"(?U)(?:(?<!{after_other}){_declared(words, COUNTERPARTY)}|{_declared(words, full)})"


def _found(title: Column, sure: bool) -> Column:
    hit = [F.when(F.coalesce(title, F.lit("")).rlike(_pattern(kind, sure)), F.lit(kind)) for kind in KINDS]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def target_orgs(title: Column) -> Column:
    """Kinds that a title is meant for, in the table's order; empty for null and empty titles."""
    return _found(title, True)


def uncertain_target_orgs(title: Column) -> Column:
    """Kinds that may be meant: states that stand after others in a list. People have to look at them."""
    return F.array_except(_found(title, False), target_orgs(title))
