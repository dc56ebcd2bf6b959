import itertools

from pyspark.sql import functions as F

from eligo.functions.target_orgs import KINDS, target_orgs, uncertain_target_orgs

#: title, kinds meant, kinds that may be meant; worked out by hand.
TITLES = [
    (None, [], []),
    ("", [], []),
    ("소상공인 경영 지원", [], []),
    ("2026 사회적기업 판로 지원사업", ["사회적기업"], []),
    ("(예비)사회적기업 시설비 지원", ["사회적기업"], []),
    ("예비사회적기업", ["사회적기업"], []),
    ("사회적기업을 지원하는 조직 선발", [], []),
    ("사회적기업과 함께하는 나눔", [], []),
    ("예비사회적기업 지정 공모", [], []),
    ("예비사회적기업 공고", [], []),
    ("예비사회적기업 공고문", ["사회적기업"], []),
    ("마을기업 설립 전 교육", [], []),
    ("협동조합 협업 사업", [], []),
    ("착한가격업소 물품 지원", ["착한가격업소"], []),
    ("착한가격 물품 지원", [], []),
    ("착한가격·마을기업 물품 지원", ["마을기업", "착한가격업소"], []),
    ("마을기업 및 농어촌공동체회사 지원", ["마을기업"], []),
    ("사회적기업 및 중소기업 상생 지원", [], []),
    ("마을기업, 자활기업 등 지원", ["마을기업", "자활기업"], []),
    ("마을기업, 자활기업 등을 지원하는 사업", [], []),
    ("예비창업자 모집", ["예비창업자"], []),
    ("예비창업자 협업 과제", [], []),
    ("유치사업자 및 예비창업자 모집", [], ["예비창업자"]),
    ("유치사업자 및 예비창업자 지원", ["예비창업자"], []),
]


def found(spark, titles):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    return [(r.a, r.b) for r in rows.select("i", target_orgs(F.col("t")).alias("a"), uncertain_target_orgs(F.col("t")).alias("b")).orderBy("i").collect()]


def test_titles(spark):
    got = found(spark, [t for t, _, _ in TITLES])
    assert [(t, *g) for (t, _, _), g in zip(TITLES, got)] == [(t, a, b) for t, a, b in TITLES]


def test_rows_of_kinds_name_each_of_them(spark):
    names = ["사회적기업", "협동조합", "마을기업", "자활기업"]
    rows = [(c, mark) for n in (2, 3) for c in itertools.permutations(names, n) for mark in ("·", ", ", " 및 ", "/", "와 ")]
    got = found(spark, [mark.join(c) + " 시설 지원" for c, mark in rows] + [mark.join(c) + "을 돕는 사업" for c, mark in rows])
    order = list(KINDS)
    assert got == [(sorted(c, key=order.index), []) for c, _ in rows] + [([], [])] * len(rows)


def test_a_row_is_followed_for_seven_words_and_long_titles_end(spark):
    row = "·".join(["마을기업"] * 7)
    got = found(spark, [f"협동조합·{row} 지원", f"협동조합·{row}·자활기업 지원", "마을기업·" * 50_000 + "지원", "과 " * 200_000 + "마을기업 지원"])
    assert got == [(["협동조합", "마을기업"], []), (["마을기업", "자활기업"], []), ([], []), (["마을기업"], [])]
