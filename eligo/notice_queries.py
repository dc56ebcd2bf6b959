"""Queries of the notice rules over the whole texts of `documents`, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.functions.body_deadline import body_deadline
from eligo.functions.target_orgs import target_orgs
from eligo.operators import extract
from eligo.sources import notices as source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


#: Of each sentence: key, op, the words it was read from (a part of the sentence), value, whether a machine may use it.
_READ = {
    "businessAgeMaxYears": ("lte", "age", "regexp_replace(age, '인 자$', '')", "CAST(NULL AS VARCHAR[])", "CAST(doc_id % 9 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE)", "NULL", "true"),
    "employeeMin": ("gte", "workers", "workers", "NULL", "CAST(doc_id % 50 + 1 AS DOUBLE)", "NULL", "true"),
    "revenueMaxKrw": ("lte", "revenue", "regexp_replace(revenue, ' 기업은 제외$', '')", "NULL", "CAST((doc_id % 9000 + 1000) * 10000 AS DOUBLE)", "NULL", "doc_id % 7 <> 0"),
    "noTaxDelinquency": ("eq", "tax", "'체납'", "NULL", "NULL", "true", "true"),
    "region": ("in", "place", "'소재 사'", f"[split_part(place, ' ', 1)]", "NULL", "NULL", "doc_id % 11 <> 0"),
}
_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{key}' AS key, '{op}' AS op, {values} AS vals, {number} AS number, CAST({flag} AS BOOLEAN) AS flag, {fine} AS machine_readable, text, instr(text, {name}) + instr({name}, {words}) - 1 AS pos, length({words}) AS n FROM notice WHERE {name} IS NOT NULL"
    for key, (op, name, words, values, number, flag, fine) in _READ.items()
)


@query(f"""WITH {source.NOTICES_SQL}, told AS ({_ROWS})
SELECT doc_id AS id, key, op, array_to_string(vals, ',') AS "values", number, flag, machine_readable,
  '{extract.RULE_PREFIX} ' || regexp_replace(regexp_replace(substr(text, greatest(pos - 15, 1), pos + n + 25 - greatest(pos - 15, 1)), '^\\s+', ''), '\\s+$', '') AS raw_text FROM told""")
def notice_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions of whole notices, with the part of the text that each was read from."""
    rows = source.notices(spark, sf).select("id", F.explode(extract.extract_conditions(F.col("text"))).alias("c"))
    return rows.select("id", "c.key", "c.op", F.array_join("c.values", ",").alias("values"), "c.number", "c.flag", "c.machine_readable", "c.raw_text")


#: By the remainder by eight: start and end (days), the label or keyword, letters read before and after it.
_PERIODS = {
    0: ("DATE '2026-03-05'", "make_date(2026, 4, day)", "접수기간", 0, 120),
    1: ("make_date(year(posted), 11, 20)", "make_date(year(posted) + 1, 1, day)", "신청기간", 0, 120),
    2: ("DATE '2026-03-02'", "make_date(2026, 4, day)", "접수기간 2026.3.2~2026.4.", 0, 120 - len(" 2026.3.2~2026.4.")),
    3: ("make_date(2026, 5, day)", "NULL", "모집기간", 0, 120),
    4: ("NULL", "make_date(year(posted) + CASE WHEN make_date(year(posted), 7, day) + INTERVAL '14:59:59' HOUR TO SECOND < posted - INTERVAL 30 DAYS THEN 1 ELSE 0 END, 7, day)", "까지", 40, 40),
    5: ("NULL", "make_date(2026, 9, day)", "신청마감", 40, 40),
    6: ("NULL", "make_date(2026, 6, day)", "마감", 40, 40),
}
_PERIODS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, CAST({start} AS DATE) AS start_day, CAST({end} AS DATE) AS end_day, instr(text, said) + instr(said, '{word}') - 1 - {back} AS pos, {back + len(word) + ahead} AS n, text FROM day WHERE doc_id % 8 = {kind}"
    for kind, (start, end, word, back, ahead) in _PERIODS.items()
).replace("INTERVAL '14:59:59' HOUR TO SECOND", "INTERVAL 53999 SECONDS")


@query(f"""WITH {source.DATED_SQL}, day AS (SELECT *, CAST(doc_id % 28 + 1 AS INTEGER) AS day FROM dated), told AS ({_PERIODS_SQL})
SELECT doc_id AS id, strftime(start_day, '%Y-%m-%d') AS start_day, strftime(end_day, '%Y-%m-%d') AS end_day,
  left(trim(regexp_replace(substr(text, pos, n), '\\s+', ' ', 'g')), 80) AS evidence FROM told
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM dated WHERE doc_id % 8 = 7""")
def body_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    """Application periods of whole notices as Korean days, with the words they were read from; nulls where none is told."""
    rows = source.dated_notices(spark, sf).withColumn("x", body_deadline(F.col("text"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), F.col("posted")))
    day = lambda at: F.date_format(at + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")
    return rows.select("id", day(F.col("x.start")).alias("start_day"), day(F.col("x.end")).alias("end_day"), F.col("x.evidence").alias("evidence"))


#: The kinds of TITLE_KINDS' words, in their order; only the second word isn't its kind's name.
_KINDS_SQL = "['사회적기업', '사회적경제', '협동조합', '마을기업', '자활기업', '소셜벤처', '착한가격업소']"


@query(f"""SELECT doc_id AS id, CASE WHEN ending > 1 THEN '' WHEN a = b THEN {_KINDS_SQL}[a] ELSE {_KINDS_SQL}[least(a, b)] || ',' || {_KINDS_SQL}[greatest(a, b)] END AS kinds
FROM (SELECT doc_id, doc_id % 7 + 1 AS a, (doc_id // 7) % 7 + 1 AS b, (doc_id // 5) % 6 AS ending FROM documents)""")
def declared_orgs(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of organisation that each title is meant for, in the order of their table."""
    return source.titles(spark, sf).select("id", F.array_join(target_orgs(F.col("title")), ",").alias("kinds"))
