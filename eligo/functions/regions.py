"""Column expressions over Korean place names: provinces, districts, nationwide lists."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Provinces in their order, each with the names that announcements use for it.
PROVINCES = {
    "서울": ("서울", "서울특별시", "서울시"),
    "부산": ("부산", "부산광역시"),
    "대구": ("대구", "대구광역시"),
    "인천": ("인천", "인천광역시"),
    "광주": ("광주", "광주광역시", "전남광주"),
    "대전": ("대전", "대전광역시"),
    "울산": ("울산", "울산광역시"),
    "세종": ("세종", "세종특별자치시"),
    "경기": ("경기", "경기도"),
    "강원": ("강원", "강원도", "강원특별자치도"),
    "충북": ("충북", "충청북도"),
    "충남": ("충남", "충청남도"),
    "전북": ("전북", "전라북도", "전북특별자치도"),
    "전남": ("전남", "전라남도"),
    "경북": ("경북", "경상북도"),
    "경남": ("경남", "경상남도"),
    "제주": ("제주", "제주도", "제주특별자치도"),
}
NATIONWIDE = "전국"
#: Fixed value: a list that names so many provinces is as good as nationwide.
NATIONWIDE_PROVINCES = 10
FOUNDATION = "신용보증재단"
#: District: its province, and the one that it belonged to before. A full gazetteer is a parameter; these are examples.
DISTRICTS = {
    "강남구": ("서울", None),
    "영월군": ("강원", None),
    "청주시": ("충북", None),
    "화성시": ("경기", None),
    "성남시": ("경기", None),
    "구미시": ("경북", None),
    "군위군": ("대구", "경북"),
    "제주시": ("제주", None),
    "서귀포시": ("제주", None),
}

_BY_LENGTH = sorted(((name, sido) for sido, names in PROVINCES.items() for name in names), key=lambda x: (-len(x[0]), x[0]))


def compact(text: Column) -> Column:
    """Without white space, the wide kinds included; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")


def any_of(text: Column, words) -> Column:
    """Whether the text holds one of the words: one pattern, however many there are."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def _table(rows: dict, ddl: str) -> Column:
    """A fixed map as one literal."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"map<string,{ddl}>")


#: At a text's beginning, the longest of the names that provinces have.
_FIRST = "^(" + "|".join(name for name, _ in _BY_LENGTH) + ")"


def canonical_region(text: Column) -> Column:
    """The province whose longest name begins the text; null where none does."""
    return F.try_element_at(_table(dict(_BY_LENGTH), "string"), F.regexp_extract(compact(text), _FIRST, 1))


def provinces_in(text: Column) -> Column:
    """All provinces named anywhere in the text, in the order of PROVINCES."""
    return provinces_of_compact(compact(text))


def provinces_of_compact(own: Column) -> Column:
    """provinces_in of a text without white space."""
    return F.array_compact(F.array(*[F.when(any_of(own, names), F.lit(sido)) for sido, names in PROVINCES.items()]))


def foundation_province(name: Column) -> Column:
    """The province of a regional guarantee foundation, by the part before that word."""
    own = compact(name)
    return F.when(own.endswith(FOUNDATION), canonical_region(F.regexp_replace(own, FOUNDATION + "$", "")))


def is_nationwide(values: Column) -> Column:
    """Of an array of places: it says nationwide, or names very many provinces."""
    named = F.array_distinct(F.flatten(F.transform(values, provinces_in)))
    return F.exists(values, lambda v: v.contains(NATIONWIDE)) | (F.size(named) >= NATIONWIDE_PROVINCES)


def stem_of(name: str) -> str | None:
    """A district's name without its last syllable, where that tells it apart from provinces."""
    stem = name[:-1] if name[-1] in "시군구" else ""
    return stem if len(stem) >= 2 and all(stem != n for n, _ in _BY_LENGTH) else None


def district_of(text: Column, districts=None) -> Column:
    """(name, sido, former) of a district by its name or, where only one district has it, its stem; null for other texts."""
    known = DISTRICTS if districts is None else districts
    stems: dict[str, list[str]] = {}
    for name in known:
        if stem := stem_of(name):
            stems.setdefault(stem, []).append(name)
    names = {n: n for n in known} | {s: n[0] for s, n in stems.items() if len(n) == 1 and s not in known}
    rows = {key: {"name": n, "sido": known[n][0], "former": known[n][1]} for key, n in names.items()}
    return F.try_element_at(_table(rows, "struct<name:string,sido:string,former:string>"), compact(text))


def place_words(region: Column) -> Column:
    """The words of a location, and what follows its province's name where all is written in one."""
    words = F.filter(F.split(F.coalesce(region, F.lit("")), r"(?U)[\s,·ㆍ()（）\[\]【】/]+"), lambda w: w != "")
    own = compact(region)
    return F.array_append(words, F.regexp_replace(own, _FIRST, ""))


def names_district(words: Column, name: Column) -> Column:
    """Whether one of place_words is the district: its name, its stem, or the stem with another last syllable."""
    stem = F.when(name.rlike("[시군구]$"), F.regexp_replace(name, ".$", ""))
    stem = F.when((F.length(stem) >= 2) & ~stem.isin([n for n, _ in _BY_LENGTH]), stem)
    like = lambda w: (w == name) | F.coalesce((w == stem) | (w.startswith(stem) & (F.length(w) == F.length(stem) + 1) & w.rlike("[시군구]$")), F.lit(False))
    return F.exists(words, like)


def trusted_district(region: Column, district: Column, districts=None) -> Column:
    """A company's district, unless its location names provinces and none of them is the district's, now or before."""
    hit, mine = district_of(district, districts), provinces_in(region)
    fits = (F.size(mine) == 0) | F.array_contains(mine, hit["sido"]) | F.coalesce(F.array_contains(mine, hit["former"]), F.lit(False))
    return F.when(fits, hit["name"])
