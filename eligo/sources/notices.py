"""Notices over the supplied texts: each document, whole, with sentences of a notice set into its middle. Which sentences, and
the numbers in them, follow from doc_id, so that SQL can say what a rule has to find; the rest of the text is the document's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.sources.bridge import SIDO

#: Letters between two sentences, more than any rule looks across.
GAP = "\n" + ". " * 30


def _provinces(id_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SIDO]), (id_ % len(SIDO)).cast("int") + 1)


def sentences(id_: Column) -> dict[str, Column]:
    """A notice's sentences by name, null where the document has none."""
    on = lambda m, text: F.when(id_ % m != 0, text)
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return {
        "age": on(3, said("업력 ", id_ % 9 + 1, "년 ", F.when(id_ % 2 == 0, "이내").otherwise("미만"), "인 자")),
        "workers": on(4, said("상시 근로자 ", id_ % 50 + 1, F.when(id_ % 2 == 0, "인").otherwise("명"), " 이상")),
        "revenue": on(5, said("매출액 ", F.format_number((id_ % 9000) + 1000, 0), "만원 이하", F.when(id_ % 7 == 0, " 기업은 제외").otherwise(""))),
        "tax": on(2, F.lit("국세 체납이 없을 것")),
        "place": on(6, said(_provinces(id_), " 소재 사업장", F.when(id_ % 11 == 0, "이 아닌 곳").otherwise(""))),
    }


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of each document; null texts are empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    told = F.concat_ws(GAP, *sentences(F.col("id")).values())
    return docs.select("id", F.concat(F.left("t", half), F.lit(GAP), told, F.lit(GAP), F.expr("substring(t, cast(floor(length(t) / 2) AS int) + 1)")).alias("text"))


def _sql_when(m: int, text: str) -> str:
    return f"CASE WHEN doc_id % {m} <> 0 THEN {text} END"


SENTENCES_SQL = {
    "age": _sql_when(3, "'업력 ' || (doc_id % 9 + 1) || '년 ' || CASE WHEN doc_id % 2 = 0 THEN '이내' ELSE '미만' END || '인 자'"),
    "workers": _sql_when(4, "'상시 근로자 ' || (doc_id % 50 + 1) || CASE WHEN doc_id % 2 = 0 THEN '인' ELSE '명' END || ' 이상'"),
    "revenue": _sql_when(5, "'매출액 ' || format('{:,}', doc_id % 9000 + 1000) || '만원 이하' || CASE WHEN doc_id % 7 = 0 THEN ' 기업은 제외' ELSE '' END"),
    "tax": _sql_when(2, "'국세 체납이 없을 것'"),
    "place": _sql_when(6, f"list_extract({list(SIDO)!r}, CAST(doc_id % {len(SIDO)} AS INTEGER) + 1) || ' 소재 사업장' || CASE WHEN doc_id % 11 = 0 THEN '이 아닌 곳' ELSE '' END"),
}
_GAP_SQL = "'" + GAP + "'"
#: The notices, their texts with runs of spaces as one, and their sentences.
NOTICES_SQL = f"""notice AS (
  SELECT *, regexp_replace(left(t, CAST(floor(length(t) / 2) AS INTEGER)) || {_GAP_SQL} || concat_ws({_GAP_SQL}, {', '.join(SENTENCES_SQL)}) || {_GAP_SQL} || substr(t, CAST(floor(length(t) / 2) AS INTEGER) + 1), '[ \t ]+', ' ', 'g') AS text
  FROM (SELECT doc_id, coalesce(text, '') AS t, {', '.join(f'{q} AS {n}' for n, q in SENTENCES_SQL.items())} FROM documents))"""


#: Letters between a sentence of a period and the rest, more than a label or a keyword looks across.
FAR = "\n" + ". " * 70
#: The day of a notice's posting is this one and up to 299 days on.
POSTED = "2025-03-01"


def period_sentence(id_: Column) -> Column:
    """What a notice says of its period, by the remainder of its id by eight; the seventh kind says nothing of a day."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    day = id_ % 28 + 1
    kinds = [
        said("접수기간 : 2026.03.05 ~ 2026. 4. ", day, "."),
        said("신청기간 11월 20일 ~ 1월 ", day, "일 18시"),
        said("기존 접수기간 2026.3.2~2026.3.10 연장 접수기간 2026.3.2~2026.4.", day),
        said("모집기간 : 2026-05-", F.lpad(day.cast("string"), 2, "0"), " ~ 예산 소진 시까지"),
        said("제출은 7월 ", day, "일까지"),
        said("신청마감 2026.9.", day, " (2026.10.30 발표)"),
        said("지원한도 3.5억원, 마감 26.6.", day),
        said("접수기간은 추후 공고"),
    ]
    return F.element_at(F.array(*kinds), (id_ % 8).cast("int") + 1)


def dated_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, posted) of each document with the sentence of its period in its middle; null texts are empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    text = F.concat(F.left("t", half), F.lit(FAR), period_sentence(F.col("id")), F.lit(FAR), F.expr("substring(t, cast(floor(length(t) / 2) AS int) + 1)"))
    return docs.select("id", text.alias("text"), F.date_add(F.lit(POSTED).cast("date"), (F.col("id") % 300).cast("int")).cast("timestamp_ntz").alias("posted"))


_DAY = "(doc_id % 28 + 1)"
#: The notices with their sentence `said` and the day they were posted.
DATED_SQL = f"""dated AS (
  SELECT *, left(t, CAST(floor(length(t) / 2) AS INTEGER)) || '{FAR}' || said || '{FAR}' || substr(t, CAST(floor(length(t) / 2) AS INTEGER) + 1) AS text
  FROM (SELECT doc_id, coalesce(text, '') AS t, DATE '{POSTED}' + CAST(doc_id % 300 AS INTEGER) AS posted, CASE doc_id % 8
    WHEN 0 THEN '접수기간 : 2026.03.05 ~ 2026. 4. ' || {_DAY} || '.' WHEN 1 THEN '신청기간 11월 20일 ~ 1월 ' || {_DAY} || '일 18시'
    WHEN 2 THEN '기존 접수기간 2026.3.2~2026.3.10 연장 접수기간 2026.3.2~2026.4.' || {_DAY} WHEN 3 THEN '모집기간 : 2026-05-' || lpad(CAST({_DAY} AS VARCHAR), 2, '0') || ' ~ 예산 소진 시까지'
    WHEN 4 THEN '제출은 7월 ' || {_DAY} || '일까지' WHEN 5 THEN '신청마감 2026.9.' || {_DAY} || ' (2026.10.30 발표)'
    WHEN 6 THEN '지원한도 3.5억원, 마감 26.6.' || {_DAY} ELSE '접수기간은 추후 공고' END AS said FROM documents))"""


#: Kinds, marks between two of them, and what follows them in a title; after the first two a title is meant for them.
TITLE_KINDS = ("사회적기업", "사회적경제기업", "협동조합", "마을기업", "자활기업", "소셜벤처", "착한가격업소")
TITLE_MARKS = ("·", ", ", " 및 ", "/", "와 ")
TITLE_ENDS = (" 시설 지원", " 등 지원", "을 돕는 사업", " 모집", " 공고", " 등을 위한 사업")


def _picked(n: Column, of: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in of]), (n % len(of)).cast("int") + 1)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title) of each document: its first line, then two kinds with a mark between them and an end, all four by its id."""
    id_ = F.col("doc_id")
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"\A[^\n]*", 0)
    row = F.concat(_picked(id_, TITLE_KINDS), _picked(id_, TITLE_MARKS), _picked(F.floor(id_ / 7), TITLE_KINDS), _picked(F.floor(id_ / 5), TITLE_ENDS))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(id_.alias("id"), F.concat(first, F.lit(" - "), row).alias("title"))
