"""Queries over the derived domain tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.functions import classify, korean
from eligo.operators import evaluate, grouping, ledgers, totals
from eligo.plans import deadline
from eligo.sources import bridge
from eligo.sources.bridge import FUNDING_GROUPS, NOW, SIDO
from eligo.sources.held import held, told_once

#: The provinces of the bridge's places, None where a place has none.
_OF_PLACE = {"서울특별시 강남구": "서울", "충북 청주시": "충북", "강원영월군": "강원", "경상북도 군위군": "경북", "경기도 화성시": "경기", "경기": "경기", "경북": "경북", "부산": "부산"}
regions_of = _OF_PLACE.get


def _literal(values) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + "]"


_pick = lambda values, index: f"list_extract({_literal(values)}, CAST({index} AS INTEGER) + 1)"

ANN = f"""ann AS (
  SELECT o_orderkey AS id, o_orderpriority AS source, {_pick(SIDO, "c_nationkey % 17")} AS sido,
    CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, o_orderdate AS apply_start,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) + INTERVAL '14:59:59' END AS apply_end,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_custkey || '|' || strftime(o_orderdate, '%Y-%m') END AS dedup_key,
    CASE WHEN o_orderkey % 11 = 0 THEN 'id:' || o_orderkey ELSE o_custkey || '|' || strftime(o_orderdate, '%Y-%m') END AS grp,
    {_pick(FUNDING_GROUPS, "o_orderkey % 6")} AS funding_group, CAST(floor(o_totalprice / 10) AS BIGINT) * 10000 AS amount_won, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_case = lambda rows: " ".join(f"WHEN {k} THEN {v}" for k, v in rows.items())
_kind = {k: i for i, k in enumerate(bridge.KINDS)}
COND = f"""cond AS (
  SELECT id, v, kind, {_pick(bridge.KINDS, "kind")} AS key, ok, opfits, flag,
    CASE kind {_case({_kind["businessAgeMaxYears"]: "q % 15 + 1", _kind["businessAgeMinYears"]: "q % 15", _kind["revenueMaxKrw"]: "q * 200", _kind["revenueMinKrw"]: "q * 100", _kind["employeeMax"]: "q * 2", _kind["employeeMin"]: "q", _kind["creditScoreMin"]: "300 + q * 10", _kind["creditScoreMax"]: "400 + q * 10"})} END AS num
  FROM (SELECT l_orderkey AS id, l_suppkey AS v, (l_orderkey + 3 * l_linenumber) % 20 AS kind, CAST(floor(l_quantity) AS BIGINT) AS q, l_returnflag <>
    'N' AND l_partkey % 13 <> 0 AS ok,
    l_partkey % 13 <> 0 AS opfits, l_partkey % 2 = 0 AS flag FROM lineitem))"""
COMPANY = f"""company AS (
  SELECT s_suppkey AS company_id, s_suppkey AS s, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS revenue, CASE WHEN s_suppkey
    % 5 <> 0 THEN s_suppkey % 120 END AS employees,
    CASE WHEN s_suppkey % 3 <> 0 THEN 300 + s_suppkey * 7 % 700 END AS credit,
    CASE WHEN s_suppkey % 19 <> 0 AND s_suppkey % 17 <> 0 THEN (s_suppkey * 97 % 6000 + 0.125) / 365.25 END AS age,
    CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 4 = 0 END AS tax, CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey % 4 <> 2 END AS loan,
    CASE s_suppkey % 5 WHEN 1 THEN true WHEN 2 THEN false ELSE CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 3 = 1 END END AS corp FROM supplier)"""
_told = lambda rows, fact: f"substr({_pick([v for _, v in rows], f'v % {len(rows)}')}, CAST({fact} AS INTEGER) + 1, 1)"
_yes = lambda test: f"CASE WHEN ({test}) IS NULL THEN 'u' WHEN {test} THEN 'p' ELSE 'f' END"
_loan = _told(bridge.LOAN_CASES, "s % 6")
TOLD = {
    "region": _told(bridge.REGION_CASES, "s % 10"), "industry": _told(bridge.INDUSTRY_CASES, "s // 2 % 5"), "targetSector": _told(bridge.SECTOR_CASES, "s // 2 % 5"), "targetOrg": _told(bridge.ORG_CASES, "s // 3 % 5"), "companyScale": _told(bridge.SCALE_CASES, "s % 4"),
    "businessAgeMaxYears": _yes("age <= num"), "businessAgeMinYears": _yes("age >= num"), "revenueMaxKrw": _yes("revenue <= num"), "revenueMinKrw": _yes("revenue >= num"), "employeeMax": _yes("employees <= num"), "employeeMin": _yes("employees >= num"),
    "noTaxDelinquency": _yes("NOT tax"), "certRequired": "CASE WHEN s % 3 = 2 THEN 'f' ELSE 'u' END", "patentRequired": "CASE WHEN s % 4 >= 2 THEN 'f' ELSE 'u' END", "creditScoreMin": _yes("credit >= num"), "creditScoreMax": _yes("credit <= num"),
    "hasExistingLoan": _yes("loan = flag"), "isCorporation": _yes("corp = flag"), "guaranteeInUse": f"CASE WHEN {_loan} = 'p' THEN 'p' WHEN NOT loan THEN 'f' ELSE {_loan} END", "other": "'u'",
}
CHECKED = f"""checked AS (
  SELECT id, company_id, key, CASE t WHEN 'p' THEN 'pass' WHEN 'f' THEN 'fail' ELSE 'unknown' END AS verdict,
    t = 'p' AND NOT (key IN ('isCorporation', 'companyScale') OR (key = 'region' AND v % 10 IN (2, 9))) AS strong
  FROM (SELECT *, CASE WHEN NOT ok THEN 'u' ELSE CASE kind {_case({_kind[k]: t for k, t in TOLD.items()})} END END AS t FROM cond CROSS JOIN company))"""
GRADED = """counts AS (
  SELECT ann.id, c.company_id, count(verdict) FILTER (verdict = 'pass') AS p, count(verdict) FILTER (verdict = 'fail') AS f, count(verdict) FILTER
    (verdict = 'unknown') AS u, coalesce(bool_or(strong), false) AS strong
  FROM ann CROSS JOIN company c LEFT JOIN checked k ON k.id = ann.id AND k.company_id = c.company_id GROUP BY 1, 2
), graded AS (
  SELECT *, CASE WHEN f > 0 THEN 'impossible' WHEN p + u > 0 AND u = 0 THEN 'possible' ELSE 'uncertain' END AS grade,
    CASE WHEN p + f + u = 0 THEN 40 ELSE 50 + 15 * p - 40 * f END AS score,
    CASE WHEN f > 0 THEN 'excluded' WHEN u = 0 AND strong THEN 'fit' ELSE 'unverified' END AS fit FROM counts)"""
RUNS = """runs AS (
  SELECT event_id AS run_id, user_id AS source, ts AS run_at, event_type = 'error' AS failed, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n_rows, event_type <> 'click' AS complete FROM events)"""
LINES = f"""bucket AS (
  SELECT p_partkey AS bucket_id, {_pick(FUNDING_GROUPS, "p_partkey % 6")} AS category,
    CASE WHEN p_partkey % 9 <> 0 THEN DATE '{NOW[:10]}' + CAST(p_partkey % 45 - 4 AS INTEGER) END AS apply_end_date FROM part
), match AS (
  SELECT l_suppkey AS company_id, l_partkey AS bucket_id, CASE WHEN max(l_quantity) >= 25 THEN 'fit' ELSE 'unverified' END AS verdict FROM lineitem
    GROUP BY 1, 2
), line AS (
  SELECT m.company_id, m.bucket_id, m.verdict, b.category, date_diff('day', DATE '{NOW[:10]}', apply_end_date) AS d_day
  FROM match m JOIN bucket b ON m.bucket_id = b.bucket_id JOIN supplier ON s_suppkey = m.company_id WHERE apply_end_date >= DATE '{NOW[:10]}')"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _totals(spark: SparkSession, sf: str, by=None, largest=None) -> tuple[DataFrame, DataFrame | None]:
    return totals.parts(bridge.announcements(spark, sf), bridge.conditions(spark, sf), bridge.companies(spark, sf), bridge.now(), by, largest)


@query(f"WITH {COND}, {COMPANY}, {CHECKED} SELECT company_id, key, verdict, count(*) AS n FROM checked GROUP BY 1, 2, 3")
def condition_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by company and key. Conditions are counted, and their verdicts added up by the facts that they ask about, before
    they meet the companies."""
    rows, names = bridge.conditions(spark, sf), evaluate.CONDITION
    n = rows.groupBy(*names).agg(F.count("*").alias("n"))
    found, told = evaluate.by_facts(rows, bridge.companies(spark, sf), bridge.now())
    same = F.lit(True)
    for x in names:
        same = same & n[x].eqNullSafe(F.col("c")[x])
    added = found.join(F.broadcast(n), same).groupBy("facts", "c.key", "verdict").agg(F.sum("n").alias("n"))
    return told.join(added, "facts").groupBy("company_id", "key", "verdict").agg(F.sum("n").alias("n"))


@query(f"""WITH {ANN}, {COND}, {COMPANY}, {CHECKED}, {GRADED} SELECT company_id, grade, fit, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM graded GROUP
  BY 1, 2, 3""")
def grade_and_score(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf)[0].groupBy("company_id", "grade", "fit").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))


BARS = {"region": "CASE WHEN NOT opfits THEN false ELSE " + " OR ".join(f"(v % 10 = {v} AND s % 10 IN ({', '.join(map(str, places))}))" for v, places in {5: (0, 5, 6, 8), 6: (0, 5, 6), 7: (0, 5), 8: (0, 6, 8)}.items()) + " END"}


@query(f"""WITH {COND}, {COMPANY}, {CHECKED} SELECT c.company_id, count(*) AS n FROM (SELECT *, {BARS["region"]} AS barred FROM cond CROSS JOIN company WHERE kind = 0) c
  WHERE barred AND (NOT ok OR {TOLD["region"]} = 'u') GROUP BY 1""")
def barred_from_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Region conditions that stay open and name foreign districts only: they rule a fit out."""
    rows = bridge.conditions(spark, sf).where("key = 'region'")
    n = rows.groupBy(*evaluate.CONDITION).agg(F.count("*").alias("n"))
    found = evaluate.checks(rows, bridge.companies(spark, sf), bridge.now()).where("bars")
    same = F.lit(True)
    for x in evaluate.CONDITION:
        same = same & n[x].eqNullSafe(found[x])
    return found.join(n, same).groupBy("company_id").agg(F.sum("n").alias("n"))


ALL = f"WITH {ANN}, {COND}, {COMPANY}, {CHECKED}, {GRADED}, one AS (SELECT ann.*, company_id, p, f, u, score, fit FROM ann JOIN graded ON ann.id = graded.id)"


@query(ALL + """, n_of AS (SELECT grp, count(DISTINCT source) AS n_sources FROM ann GROUP BY 1)
  SELECT company_id, r.grp, id AS rep_id, fit, n AS group_count, n_sources FROM (
  SELECT *, count(*) OVER (PARTITION BY company_id, grp) AS n, row_number() OVER (PARTITION BY company_id, grp ORDER BY CASE fit WHEN 'excluded' THEN 0
    WHEN 'fit' THEN 1 ELSE 2 END, p + f + u DESC, apply_end NULLS LAST, id) AS k FROM one) r
  JOIN n_of ON r.grp = n_of.grp WHERE k = 1""")
def representative_pick(spark: SparkSession, sf: str) -> DataFrame:
    n = bridge.conditions(spark, sf).groupBy("id").agg(F.count("*").alias("checks"))
    rows = bridge.announcements(spark, sf).select("id", "source", "dedup_key", "apply_end").join(n, "id", "left").na.fill(0, ["checks"])
    return totals.representatives(grouping.placed(rows), bridge.conditions(spark, sf), bridge.companies(spark, sf), bridge.now())


@query(ALL + """ SELECT company_id, id, funding_group, fit, score, k AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, funding_group, fit ORDER BY score DESC, apply_end NULLS LAST, id) AS k FROM one) WHERE k <= 80""")
def top_n_per_verdict(spark: SparkSession, sf: str) -> DataFrame:
    found = totals.firsts(bridge.announcements(spark, sf), bridge.conditions(spark, sf), bridge.companies(spark, sf), bridge.now())
    return found.select("company_id", "id", "funding_group", "fit", "score", "place")


@query(ALL + f""" SELECT g.company_id, g.funding_group, count(id) FILTER (fit <> 'excluded') AS n_normal, count(id) FILTER (fit = 'excluded') AS n_excluded, count(id) FILTER (fit = 'fit') AS n_fit,
  max(amount_won) FILTER (fit <> 'excluded') AS max_won FROM (SELECT company_id, unnest({list(FUNDING_GROUPS)!r}) AS funding_group FROM company) g
  LEFT JOIN one ON one.funding_group = g.funding_group AND one.company_id = g.company_id GROUP BY 1, 2""")
def group_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the six groups of each company; an empty group stays, its amount null."""
    normal, fit, n = F.col("fit") != "excluded", F.col("fit") == "fit", F.col("n")
    added = lambda test: F.sum(F.when(test, n).otherwise(0))
    sums, largest = _totals(spark, sf, {"funding_group": F.col("funding_group")}, F.col("amount_won"))
    counts = sums.unionByName(largest, allowMissingColumns=True).groupBy("company_id", "funding_group").agg(
        added(normal).alias("n_normal"), added(~normal).alias("n_excluded"), added(fit).alias("n_fit"), F.max("largest").alias("max_won")
    )
    groups = F.explode(F.array(*[F.lit(g) for g in FUNDING_GROUPS])).alias("funding_group")
    every = bridge.companies(spark, sf).select("company_id", groups)
    return every.join(counts, ["company_id", "funding_group"], "left").na.fill(0, ["n_normal", "n_excluded", "n_fit"])


@query(ALL + f""" SELECT company_id, count(*) FILTER (is_open) AS n_open, count(*) FILTER (is_open AND d BETWEEN 0 AND 7) AS n_soon, count(*) FILTER (funding_group = 'grant') AS n_grant, max(amount_won) FILTER (funding_group = 'grant') AS max_grant FROM (
  SELECT *, apply_start <= TIMESTAMP '{NOW}' AND (apply_end IS NULL OR apply_end >= TIMESTAMP '{NOW}') AS is_open,
    date_diff('day', CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE), CAST(apply_end + INTERVAL 9 HOUR AS DATE)) AS d FROM one WHERE fit <> 'excluded') GROUP BY 1""")
def glance(spark: SparkSession, sf: str) -> DataFrame:
    """Four tiles of each company that has an announcement which isn't excluded."""
    at = bridge.now()
    begun, ended = F.col("apply_start") <= at, F.coalesce(F.col("apply_end") < at, F.lit(False))
    is_open, days = begun & ~ended, korean.d_day(F.col("apply_end"), at)
    by = {"is_open": is_open, "soon": F.coalesce(is_open & days.between(0, 7), F.lit(False)), "is_grant": F.col("funding_group") == "grant"}
    granted = F.when(F.col("funding_group") == "grant", F.col("amount_won"))
    sums, largest = _totals(spark, sf, by, granted)
    rows, n = sums.where("fit <> 'excluded'").unionByName(largest, allowMissingColumns=True), F.col("n")
    added = lambda test: F.sum(F.when(F.col(test), n).otherwise(0))
    return rows.groupBy("company_id").agg(added("is_open").alias("n_open"), added("soon").alias("n_soon"), added("is_grant").alias("n_grant"), F.max("largest").alias("max_grant"))


_MINE = _pick(tuple(regions_of(p) for p, _ in bridge.PLACES), "company_id % 10")


@query(ALL + f""", d AS (SELECT one.*, CASE WHEN apply_end < TIMESTAMP '{NOW}' THEN 'drop-closed' WHEN sido <> {_MINE} THEN 'drop-region' ELSE 'keep' END AS decision, CASE WHEN f > 0 THEN 'impossible' WHEN p + u > 0 AND u = 0 THEN 'possible' ELSE 'uncertain' END AS g FROM one)
SELECT company_id, count(*) FILTER (decision = 'drop-region') AS dropped_by_region, count(*) FILTER (decision = 'keep') AS candidates, count(*) FILTER
  (decision = 'keep' AND g = 'possible') AS possible,
  count(*) FILTER (decision = 'keep' AND g = 'uncertain') AS uncertain, count(*) FILTER (decision = 'keep' AND g = 'impossible') AS impossible FROM d GROUP BY 1""")
def diagnose_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Of the announcements that a company's prefilter leaves, how many it can have; and how many its region took away."""
    rows = bridge.announcements(spark, sf).select("id", "apply_end", "sido", "title")
    rows = told_once(rows, ["sido", "title"], {"bound": classify.bound_regions(F.col("sido"), F.col("title"))})
    mine = bridge.companies(spark, sf).select("company_id", classify.own_region(F.col("region")).alias("mine"))
    by = {"bound": F.array_join("bound", ","), "closed": classify.prefilter(F.array().cast("array<string>"), F.col("apply_end"), F.lit(None).cast("string"), bridge.now()) == "drop-closed"}
    cells, _ = totals.parts(rows, bridge.conditions(spark, sf), bridge.companies(spark, sf), bridge.now(), by)
    open_end = F.lit(None).cast("timestamp_ntz")
    places = F.filter(F.split("bound", ","), lambda x: x != "")
    decision = F.when(F.col("closed"), "drop-closed").otherwise(classify.prefilter(places, open_end, F.col("mine"), bridge.now()))
    # places are few, so each pair of them is decided once
    decisions = held(rows.select(*[c.alias(x) for x, c in by.items()]).distinct().crossJoin(mine.select("mine").distinct()).withColumn("decision", decision))
    same = F.col("c.bound").eqNullSafe(F.col("d.bound")) & F.col("c.closed").eqNullSafe(F.col("d.closed")) & F.col("m.mine").eqNullSafe(F.col("d.mine"))
    decided = cells.alias("c").join(mine.alias("m"), "company_id").join(F.broadcast(decisions).alias("d"), same)
    added = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    kept = F.col("decision") == "keep"
    by_grade = [added(kept & (F.col("grade") == g)).alias(g) for g in ("possible", "uncertain", "impossible")]
    return decided.groupBy("company_id").agg(added(F.col("decision") == "drop-region").alias("dropped_by_region"), added(kept).alias("candidates"), *by_grade)


BROWSE = """ SELECT grp, arg_min(id, k) AS rep_id, arg_min_null(apply_end, k) AS apply_end, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 50) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY apply_end NULLS LAST, apply_start DESC, id) AS k FROM ann WHERE status = 'open') GROUP BY grp"""


@query(f"WITH {ANN}{BROWSE}")
def browse_groups(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.browse(bridge.announcements(spark, sf), "open")


@query(f"WITH {ANN} SELECT * FROM ({BROWSE}) ORDER BY apply_end NULLS LAST, rep_id LIMIT 50 OFFSET 50")
def browse_page(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.page(grouping.browse(bridge.announcements(spark, sf), "open"), 2)


@query(f"WITH {ANN} SELECT count(DISTINCT grp) AS total FROM ann WHERE status = 'open' AND sido LIKE '%경%'")
def browse_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = grouping.keyed(bridge.announcements(spark, sf).where((F.col("status") == "open") & F.col("sido").like("%경%")))
    return rows.agg(F.count_distinct("grp").alias("total"))


@query(f"""WITH {ANN}, d AS (SELECT id, CASE WHEN apply_start > TIMESTAMP '{NOW}' THEN 'upcoming' WHEN apply_end IS NOT NULL THEN 'date' ELSE {_pick(("unknown", "budget", "always", "text", "always"), "id // 7 % 5")} END AS kind,
    date_diff('day', CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE), CAST(apply_end + INTERVAL 9 HOUR AS DATE)) AS d FROM ann)
  SELECT id, kind, CAST(CASE WHEN kind = 'upcoming' AND d IS NULL THEN 89999 WHEN kind IN ('upcoming', 'date') THEN CASE WHEN d < 0 THEN 99999 ELSE d END
    WHEN kind = 'always' THEN 90000 WHEN kind = 'budget' THEN 90001 WHEN kind = 'text' THEN 90002 ELSE 90003 END AS BIGINT) AS dead_rank FROM d""")
def deadline_kinds(spark: SparkSession, sf: str) -> DataFrame:
    d = korean.announcement_deadline(F.col("apply_start"), F.col("apply_end"), F.col("deadline_text"), bridge.now())
    rows = bridge.announcements(spark, sf).select("id", d.alias("d"))
    return rows.select("id", F.col("d.kind").alias("kind"), korean.dead_rank(F.col("d")).cast("long").alias("dead_rank"))


@query("""SELECT o_orderkey AS id, o_orderdate - INTERVAL 9 HOUR AS period_start, o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) + INTERVAL '14:59:59'
  AS period_end FROM orders""")
def apply_periods(spark: SparkSession, sf: str) -> DataFrame:
    start, end = korean.period_bounds(F.col("period_text"))
    return bridge.announcements(spark, sf).select("id", start.alias("period_start"), end.alias("period_end"))


@query(f"WITH {ANN} SELECT id, amount_won AS won FROM ann")
def amounts_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """Read from the text; the check computes them from the columns that made it."""
    return bridge.announcements(spark, sf).select("id", korean.won_of(F.col("amount_text")).alias("won"))


_thousands = lambda x: f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '^(\\d+)(\\d{{3}})(\\d{{3}})$', '\\1,\\2,\\3'), '^(\\d+)(\\d{{3}})$', '\\1,\\2')"


@query(f"""WITH {ANN}, a AS (SELECT id, amount_won // 7 AS won FROM ann) SELECT id, CASE WHEN won <= 0 THEN '—' WHEN won >= 100000000 THEN {_thousands("won // 100000000")} || '억' ||
  CASE WHEN won % 100000000 // 10000 > 0 THEN ' ' || {_thousands("won % 100000000 // 10000")} || '만원' ELSE '원' END
  WHEN won >= 10000 THEN {_thousands("(won + 5000) // 10000")} || '만원' ELSE {_thousands("won")} || '원' END AS words FROM a""")
def amount_words(spark: SparkSession, sf: str) -> DataFrame:
    """Of amounts that are no multiples of 10,000."""
    return bridge.announcements(spark, sf).select("id", korean.format_won(F.floor(F.col("amount_won") / 7)).alias("words"))


@query(f"""WITH {ANN} SELECT id, sido || CASE WHEN id % 2 = 0 THEN '정책자금융자' ELSE 'growth지원사업' END || (id % 97) || '호|agency' || (o_custkey % 29) AS dedup_key FROM ann""")
def dedup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.announcements(spark, sf).select("id", korean.dedup_key_of(F.col("title"), F.col("agency")).alias("dedup_key"))


@query(f"WITH {ANN} SELECT funding_group, count(*) AS n FROM ann WHERE id % 2 = 0 AND sido = '경기' GROUP BY 1")
def funding_search(spark: SparkSession, sf: str) -> DataFrame:
    """All terms must be found in title and agency."""
    terms = F.split(F.lower(F.lit("자금·융자 경기")), " ")
    text = F.lower(F.concat_ws(" ", "title", "agency"))
    rows = bridge.announcements(spark, sf).withColumn("hay", text).where(F.forall(terms, lambda t: F.contains(F.col("hay"), t)))
    return rows.groupBy("funding_group").agg(F.count("*").alias("n"))


PRODUCT = f"""product AS (SELECT p_partkey AS product_id, (p_partkey % 1500 + 1) || '|' || printf('%d-%02d', 1995 + p_partkey % 4, p_partkey % 12 + 1) AS grp, {_pick(FUNDING_GROUPS, "p_partkey % 6")} AS funding_group FROM part),
folded AS (SELECT a.id, p.product_id AS related_product_id FROM (SELECT grp, min(id) AS id FROM ann GROUP BY 1) a JOIN (SELECT grp, min(product_id) AS product_id FROM product GROUP BY 1) p ON a.grp = p.grp)"""


@query(f"WITH {ANN}, {PRODUCT} SELECT id, related_product_id FROM folded")
def twin_fold(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.fold_twins(bridge.announcements(spark, sf), bridge.products(spark, sf))


@query(f"WITH {ANN}, {PRODUCT} SELECT product_id, funding_group FROM product WHERE product_id NOT IN (SELECT related_product_id FROM folded)")
def unfolded_products(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.unfolded_products(bridge.announcements(spark, sf), bridge.products(spark, sf)).select("product_id", "funding_group")


_ROLL = """, streak AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY run_at, run_id) AS s FROM runs),
counted AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source, s ORDER BY run_at, run_id) AS in_a_row FROM streak)"""


@query(f"WITH {RUNS}{_ROLL} SELECT source, run_id, CAST(in_a_row AS BIGINT) AS in_a_row FROM counted")
def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.failure_streaks(bridge.runs(spark, sf)).select("source", "run_id", "in_a_row")


@query(f"WITH {RUNS}{_ROLL} SELECT source, run_id, CAST(in_a_row AS BIGINT) AS in_a_row FROM counted WHERE failed AND in_a_row % 3 = 0")
def failure_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.alerts(bridge.runs(spark, sf))


@query(f"""WITH {RUNS}, r AS (SELECT *, last_value(CASE WHEN complete THEN {{'n': n_rows, 'at': run_at}} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY run_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM runs WHERE NOT failed)
SELECT source, run_id, n_rows, base.n AS base_rows FROM r WHERE base.n >= 10 AND 2 * n_rows < base.n AND run_at < base.at + INTERVAL 26 HOUR""")
def sudden_drops(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.sudden_drops(bridge.runs(spark, sf))


@query(f"""WITH {RUNS} SELECT source, run_id, n_rows, failed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_at DESC, run_id DESC) AS k FROM
  runs) WHERE k = 1""")
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.latest(bridge.runs(spark, sf))


@query(f"""WITH {RUNS} SELECT source, day, run_id FROM (SELECT *, CAST(run_at AS DATE) AS day, row_number() OVER (PARTITION BY source, CAST(run_at AS DATE) ORDER
  BY run_at, run_id) AS k FROM runs) WHERE k = 1""")
def first_writers(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.first_writers(bridge.runs(spark, sf))


@query(f"""WITH p AS (SELECT l_suppkey AS source, l_orderkey % 40 + 1 AS page, l_partkey % 120 AS key FROM lineitem),
n AS (SELECT source, page, count(DISTINCT key) FILTER (first = page) AS n_new FROM (SELECT *, min(page) OVER (PARTITION BY source, key) AS first FROM
  p) GROUP BY 1, 2),
e AS (SELECT *, sum(CASE WHEN n_new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS k FROM n),
s AS (SELECT *, min(page) FILTER (k = 2) OVER (PARTITION BY source) AS stop FROM e)
SELECT source, max(page) AS last_page, bool_or(stop IS NOT NULL) AS stopped, CAST(sum(n_new) AS BIGINT) AS n_keys FROM s WHERE stop IS NULL OR page <= stop GROUP BY 1""")
def page_stops(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") % 40 + 1).alias("page"), (F.col("l_partkey") % 120).alias("key"))
    return ledgers.stop_pages(rows)


@query("""WITH r AS (SELECT o_custkey AS source, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 AND o_custkey % 11 = 0 THEN '공지사항' ELSE 'title ' || o_orderkey END AS title,
  CASE WHEN o_custkey % 7 = 0 THEN 'javascript:' || o_orderkey ELSE 'https://x/' || (o_orderkey % (1 + o_custkey % 9)) END AS url, o_orderkey % (2 +
    o_custkey % 6) = 0 AS dated FROM orders),
f AS (SELECT source, count(*) AS n, count(*) FILTER (length(trim(title)) >= 4 AND title <> '공지사항') AS t, count(*) FILTER (url LIKE 'http%') AS l,
  count(DISTINCT url) AS u, count(*) FILTER (dated) AS d FROM r GROUP BY 1)
SELECT source, n, CASE WHEN n < 3 THEN 'few' WHEN source % 40 >= 10 AND 2 * n < source % 40 THEN 'drop' WHEN 10 * t < 6 * n THEN 'titles' WHEN 10 * l < 6 * n THEN 'links' WHEN 2 * u < n THEN 'urls' WHEN 10 * d < 3 * n THEN 'dates' ELSE 'ok' END AS reason FROM f""")
def row_validation_gate(spark: SparkSession, sf: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = orders.select(
        c.alias("source"),
        F.when((k % 3 == 0) & (c % 5 == 0), "").when((k % 2 == 0) & (c % 11 == 0), "공지사항").otherwise(F.concat(F.lit("title "), k.cast("string"))).alias("title"),
        F.when(c % 7 == 0, F.concat(F.lit("javascript:"), k.cast("string"))).otherwise(F.concat(F.lit("https://x/"), (k % (1 + c % 9)).cast("string"))).alias("url"),
        (k % (2 + c % 6) == 0).alias("dated"),
    )
    previous = orders.select(c.alias("source"), (c % 40).alias("prev_count")).distinct()
    return ledgers.row_gate(rows, previous, least=3)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return deadline.lines(bridge.matches(spark, sf), bridge.buckets(spark, sf), bridge.companies(spark, sf), F.to_date(bridge.now()))


@query(f"""WITH {LINES} SELECT count(DISTINCT company_id) FILTER (d_day <= 7) AS companies_7, count(DISTINCT bucket_id) FILTER (d_day <= 7) AS buckets_7, count(DISTINCT bucket_id) FILTER (d_day <= 14) AS buckets_14,
  count(DISTINCT bucket_id) FILTER (d_day <= 30) AS buckets_30, count(DISTINCT bucket_id) AS buckets_all, count(*) FILTER (verdict = 'fit') AS n_fit FROM line""")
def deadline_summary(spark: SparkSession, sf: str) -> DataFrame:
    return deadline.summary(_lines(spark, sf))


@query(f"""WITH {LINES} SELECT b.bucket_id, b.category, CAST(date_diff('day', DATE '{NOW[:10]}', apply_end_date) AS INTEGER) AS d_day, count(*) FILTER (verdict = 'fit') AS fit, count(*) FILTER (verdict = 'unverified') AS unverified
  FROM bucket b LEFT JOIN match m ON m.bucket_id = b.bucket_id GROUP BY 1, 2, 3""")
def deadline_list(spark: SparkSession, sf: str) -> DataFrame:
    return deadline.bucket_list(bridge.buckets(spark, sf), bridge.matches(spark, sf), F.to_date(bridge.now()))


@query(f"""WITH {LINES}, k AS (SELECT company_id, category, count(*) AS n, min(d_day) AS nearest FROM line WHERE d_day <= 14 GROUP BY 1, 2)
SELECT company_id, CAST(min(nearest) AS INTEGER) AS nearest, CAST(sum(n) AS BIGINT) AS n_lines, string_agg(category || ':' || n || ':' || nearest, ',' ORDER BY nearest, category) AS kinds FROM k GROUP BY 1""")
def deadline_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return deadline.contacts(_lines(spark, sf))
