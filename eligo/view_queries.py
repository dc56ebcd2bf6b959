"""Queries of the deadline views, the funding map's orders and folds, browse filters and documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eligo.functions import korean
from eligo.operators import documents, grouping
from eligo.plans import deadline, funding
from eligo.queries import ANN, LINES, _pick
from eligo.sources import bridge
from eligo.sources.bridge import FUNDING_GROUPS, NOW

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


DAY = f"DATE '{NOW[:10]}'"
FULL = f"""{LINES.split("), match AS")[0]}), firm AS (
  SELECT s_suppkey AS company_id, 'Firm ' || (s_suppkey * 7 % 50) AS company_name, s_nationkey AS nation FROM supplier
), match AS (
  SELECT l_suppkey AS company_id, l_partkey AS bucket_id, CASE WHEN max(l_quantity) >= 25 THEN 'fit' ELSE 'unverified' END AS verdict, count(*) % 3 AS c
    FROM lineitem GROUP BY 1, 2
), start AS (
  SELECT l_suppkey AS company_id, l_partkey AS bucket_id, min(struct_pack(a := l_shipdate, t := l_orderkey)).t AS track_id FROM lineitem WHERE
    l_linenumber = 1 GROUP BY 1, 2
), line AS (
  SELECT m.*, b.category, b.apply_end_date, date_diff('day', {DAY}, apply_end_date) AS d_day, company_name, nation, s.track_id IS NOT NULL AS begun
  FROM match m JOIN bucket b USING (bucket_id) JOIN firm USING (company_id) LEFT JOIN start s USING (company_id, bucket_id))"""
KEPT = "d_day BETWEEN 0 AND 14 AND NOT (verdict = 'unverified' AND c < 2) AND NOT begun"


def _today():
    return F.to_date(bridge.now())


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return deadline.full_lines(bridge.matches(spark, sf), bridge.buckets(spark, sf), bridge.company_names(spark, sf), bridge.progress(spark, sf), _today())


@query(f"WITH {FULL} SELECT bucket_id, company_id, company_name, verdict, begun FROM line WHERE d_day >= 0 OR d_day IS NULL")
def deadline_bucket_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Companies of each bucket that hasn't ended, and whether they have begun."""
    return _lines(spark, sf).where("d_day >= 0 OR d_day IS NULL").select("bucket_id", "company_id", "company_name", "verdict", "begun")


@query(f"""WITH {FULL} SELECT company_id, bucket_id, d_day, row_number() OVER (PARTITION BY company_id ORDER BY apply_end_date, bucket_id) AS place FROM line
  WHERE d_day BETWEEN 0 AND 30""")
def deadline_company(spark: SparkSession, sf: str) -> DataFrame:
    """Each company's dated buckets of the next 30 days, in order."""
    rows = _lines(spark, sf).where(deadline.in_days(F.col("d_day"), 30))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("apply_end_date", "bucket_id"))
    return rows.select("company_id", "bucket_id", F.col("d_day").cast("long").alias("d_day"), place.cast("long").alias("place"))


@query(f"""WITH {FULL}, k AS (SELECT company_id, company_name, category, count(*) AS n, min(d_day) AS nearest, count(*) FILTER (begun) AS b FROM line WHERE
  {KEPT} GROUP BY 1, 2, 3) SELECT company_id, company_name, CAST(min(nearest) AS BIGINT) AS nearest, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(b) AS
  BIGINT) AS n_begun, string_agg(category || ':' || n || ':' || nearest, ',' ORDER BY category) AS kinds FROM k GROUP BY 1, 2""")
def deadline_contact_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Companies to call within 14 days, without empty judgements and those that have begun."""
    found = deadline.contact_rows(deadline.contact_lines(_lines(spark, sf), bridge.GENERIC))
    return found.withColumn("nearest", F.col("nearest").cast("long"))


@query(f"""WITH {FULL}, r AS (SELECT company_id, CASE category WHEN 'policy' THEN 'p' WHEN 'grant' THEN 'g' ELSE 'o' END AS k FROM line WHERE {KEPT}) SELECT
  count(DISTINCT company_id) FILTER (k = 'p') AS policy_fund, count(DISTINCT company_id) FILTER (k = 'g') AS free_grant, count(DISTINCT company_id)
  FILTER (k = 'o') AS other FROM r""")
def deadline_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("category") == "policy", deadline.KINDS_FIRST[0]).when(F.col("category") == "grant", deadline.KINDS_FIRST[1]).otherwise(F.col("category"))
    return deadline.kind_counts(deadline.contact_lines(_lines(spark, sf), bridge.GENERIC).withColumn("category", named))


@query(f"""WITH {FULL} SELECT bucket_id, row_number() OVER (ORDER BY apply_end_date NULLS LAST, bucket_id) AS place FROM bucket WHERE apply_end_date IS NULL OR
  date_diff('day', {DAY}, apply_end_date) BETWEEN 0 AND 14""")
def deadline_list_order(spark: SparkSession, sf: str) -> DataFrame:
    return deadline.in_order(bridge.buckets(spark, sf), _today(), 14).select("bucket_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {FULL} SELECT bucket_id, company_id, verdict, row_number() OVER (ORDER BY apply_end_date NULLS LAST, bucket_id, verdict, company_name,
  company_id) AS place FROM line WHERE d_day BETWEEN 0 AND 14 OR apply_end_date IS NULL QUALIFY place <= 50000""")
def deadline_export(spark: SparkSession, sf: str) -> DataFrame:
    """The spreadsheet's rows, 50,000 at most as the feature has it."""
    return deadline.export(_lines(spark, sf), 14).select("bucket_id", "company_id", "verdict", F.col("place").cast("long").alias("place"))


@query(f"""WITH {FULL} SELECT 'n3' AS reader, count(*) AS n, count(DISTINCT company_id) AS n_companies FROM line WHERE nation = 3 UNION ALL SELECT 'third',
  count(*), count(DISTINCT company_id) FROM line WHERE company_id % 3 = 0 UNION ALL SELECT 'keys', count(*), count(DISTINCT company_id) FROM line
  WHERE company_id IN (1, 2) UNION ALL SELECT 'none', 0, 0""")
def deadline_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """What each of four scopes sees; an empty list of keys sees nothing."""
    every = bridge.company_names(spark, sf)
    scopes = {"n3": deadline.in_scope(every, reader="n3"), "third": deadline.in_scope(every, reader="third"), "keys": deadline.in_scope(every, keys=[1, 2]), "none": deadline.in_scope(every, keys=[])}
    rows, found = bridge.matches(spark, sf).join(bridge.buckets(spark, sf), "bucket_id"), None
    for name, firms in scopes.items():
        one = rows.join(firms, "company_id").agg(F.lit(name).alias("reader"), F.count("*").alias("n"), F.count_distinct("company_id").alias("n_companies"))
        found = one if found is None else found.unionByName(one)
    return found


@query(f"WITH {FULL} SELECT company_id, bucket_id, track_id FROM start")
def progress_starts(spark: SparkSession, sf: str) -> DataFrame:
    return deadline.first_starts(bridge.progress(spark, sf)).select("company_id", "bucket_id", "track_id")


@query(f"WITH {FULL} SELECT category, row_number() OVER (ORDER BY category) AS place FROM (SELECT DISTINCT category FROM bucket WHERE category <> '')")
def deadline_categories(spark: SparkSession, sf: str) -> DataFrame:
    names = bridge.buckets(spark, sf).where("category <> ''").agg(F.sort_array(F.collect_set("category")).alias("c"))
    return names.select(F.posexplode("c").alias("place", "category")).select("category", (F.col("place") + 1).cast("long").alias("place"))


# Orders of the funding map

ITEM = f"""item AS (SELECT id, funding_group, CASE id % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'unverified' ELSE 'excluded' END AS fit, CASE WHEN id % 4 > 0 THEN id % 4 END AS step, id % 5 * 6 + id % 3 * 3 AS weight, id * 37 % 1000 AS score,
  CASE WHEN id % 8 > 0 THEN id % 40 * 0.25 END AS rate_min, CASE WHEN id % 9 > 0 THEN amount_won END AS amount_won,
  CASE WHEN apply_start > TIMESTAMP '{NOW}' THEN 'upcoming' WHEN apply_end IS NOT NULL THEN 'date' ELSE {_pick(("unknown", "budget", "always", "text", "always"), "id // 7 % 5")} END AS kind,
  date_diff('day', CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE), CAST(apply_end + INTERVAL 9 HOUR AS DATE)) AS d FROM ann),
ranked AS (SELECT *, CASE WHEN kind = 'upcoming' AND d IS NULL THEN 89999 WHEN kind IN ('upcoming', 'date') THEN CASE WHEN d < 0 THEN 99999 ELSE d END
  WHEN kind = 'always' THEN 90000 WHEN kind = 'budget' THEN 90001 WHEN kind = 'text' THEN 90002 ELSE 90003 END AS dead,
  CASE WHEN coalesce(kind IN ('upcoming', 'date') AND d = 0, false) THEN 1 ELSE 0 END AS due, CASE fit WHEN 'fit' THEN 0 WHEN 'unverified' THEN 1 ELSE 2 END AS v FROM item)"""
_SORTS = {"rec": "v, due, coalesce(step, CASE WHEN fit = 'fit' THEN 3 ELSE 5 END), weight, dead, score DESC, id", "dead": "dead, id", "rate": "rate_min NULLS LAST, id", "amt": "coalesce(amount_won, -1) DESC, id"}


def _items(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    d = korean.announcement_deadline(F.col("apply_start"), F.col("apply_end"), F.col("deadline_text"), bridge.now())
    zero = F.lit(0)
    return bridge.announcements(spark, sf).select(
        "id", "funding_group", "title", "agency", "apply_start", "apply_end", d.alias("deadline"), k.alias("ord"),
        F.when(k % 3 == 0, "fit").when(k % 3 == 1, "unverified").otherwise("excluded").alias("fit"),
        F.when(k % 4 > 0, k % 4).alias("step"),
        funding.review_weight(k % 5, zero, zero, k % 3).alias("weight"),
        (k * 37 % 1000).alias("score"),
        F.when(k % 8 > 0, k % 40 * 0.25).alias("rate_min"),
        F.when(k % 9 > 0, F.col("amount_won")).alias("amount_won"),
    )


def _sorted(sort: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return funding.top_items(_items(spark, sf), sort).select("funding_group", "fit", "id", F.col("place").cast("long").alias("place"))

    run.__name__ = f"sort_{sort}"
    return run


for _name, _order in _SORTS.items():
    query(f"WITH {ANN}, {ITEM} SELECT funding_group, fit, id, row_number() OVER (PARTITION BY funding_group, fit ORDER BY {_order}) AS place FROM ranked QUALIFY place <= 80")(_sorted(_name))


@query(f"""WITH {ANN}, {ITEM}, o AS (SELECT *, kind NOT IN ('upcoming', 'closed') AND (d IS NULL OR kind <> 'date' OR d >= 0) AS is_open FROM ranked)
SELECT tab, count(*) AS n FROM (SELECT 'all' AS tab FROM o UNION ALL SELECT 'now' FROM o WHERE is_open UNION ALL SELECT 'soon' FROM o WHERE is_open AND kind = 'date' AND d <= 7 UNION ALL SELECT funding_group FROM o) GROUP BY 1""")
def tab_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Items of every tab in one pass over the items."""
    tabs = ["all", "now", "soon", *FUNDING_GROUPS]
    counts = _items(spark, sf).agg(*[F.count_if(funding.tab_match(t, F.col("deadline"), F.col("funding_group"))).alias(t) for t in tabs])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in tabs]), F.array(*tabs))).alias("tab", "n")).where("n > 0")


@query(f"WITH {ANN} SELECT funding_group, count(*) AS n FROM ann WHERE id % 97 = 7 AND id % 2 = 1 GROUP BY 1")
def searched_items(spark: SparkSession, sf: str) -> DataFrame:
    """All terms of a search, whatever their case."""
    terms = funding.search("GROWTH 지원-사업 7호")
    rows = _items(spark, sf).where(funding.matches_search(terms, [F.col("title"), F.col("agency")]) & F.col("title").rlike(" 7호$"))
    return rows.groupBy("funding_group").agg(F.count("*").alias("n"))


@query(f"""WITH {ANN}, {ITEM}, s AS (SELECT r.*, a.apply_start, a.apply_end FROM ranked r JOIN ann a USING (id)) SELECT funding_group, id, row_number() OVER (PARTITION BY funding_group ORDER BY
  CASE WHEN apply_start > TIMESTAMP '{NOW}' THEN 2 WHEN apply_end > TIMESTAMP '{NOW}' THEN 0 ELSE 1 END, score DESC, apply_end NULLS LAST, id) AS place FROM s QUALIFY place <= 50""")
def recommended_order(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("funding_group").orderBy(*funding.recommended(F.col("id"), bridge.now())))
    return _items(spark, sf).withColumn("place", place).where("place <= 50").select("funding_group", "id", F.col("place").cast("long").alias("place"))


TWIN = f"""product AS (SELECT p_partkey AS ord, (p_partkey % 1500 + 1) || '|' || printf('%d-%02d', 1995 + p_partkey % 4, p_partkey % 12 + 1) AS grp, CASE p_partkey % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'unverified' ELSE 'excluded' END AS verdict, p_partkey % 2 = 0 AS place_only FROM part),
last AS (SELECT grp, max(struct_pack(o := ord, v := verdict, p := place_only)) AS t FROM product GROUP BY 1)"""


@query(f"""WITH {ANN}, {TWIN} SELECT id, CASE WHEN id % 3 = 0 AND coalesce(t.v <> 'fit' AND NOT (t.v = 'excluded' AND t.p), false) THEN 'unverified' ELSE CASE id
  % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'unverified' ELSE 'excluded' END END AS fit FROM ann LEFT JOIN last USING (grp)""")
def twin_downgrade(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    items = grouping.keyed(bridge.announcements(spark, sf)).select("id", "grp", F.when(k % 3 == 0, "fit").when(k % 3 == 1, "unverified").otherwise("excluded").alias("fit"))
    products = bridge.products(spark, sf).withColumns({"ord": F.col("product_id"), "place_only": F.col("product_id") % 2 == 0})
    return funding.twin_downgrade(items, products).select("id", "fit")


@query("""SELECT p_partkey AS product_id, 'stored' AS origin FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, 'manual' FROM part WHERE p_partkey %
  5 = 0 AND p_partkey % 2 = 0""")
def manual_products(spark: SparkSession, sf: str) -> DataFrame:
    """Manual products that aren't among the stored ones."""
    every = bridge.products(spark, sf).select("product_id")
    stored = every.where("product_id % 5 > 0").withColumn("origin", F.lit("stored"))
    manual = every.where("product_id % 2 = 0").withColumn("origin", F.lit("manual"))
    return funding.with_manual(stored, manual, "product_id")


@query(f"""WITH {ANN}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM ann)
SELECT grp, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 20) AS ids, count(DISTINCT nullif(trim(source), '')) AS n_sources FROM k GROUP BY grp HAVING count(*) > 1""")
def group_members(spark: SparkSession, sf: str) -> DataFrame:
    return funding.group_members(grouping.keyed(bridge.announcements(spark, sf)))


@query(f"""WITH {ANN}, r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'fit' ELSE 'unverified' END AS fit, row_number() OVER (PARTITION BY grp ORDER BY id) = 1 AS rep, id % 4 = 1 AS own FROM ann),
m AS (SELECT grp, string_agg('check ' || id % 2, ',' ORDER BY f) AS more FROM (SELECT grp, id % 2 AS id, min(id) AS f FROM r WHERE NOT rep AND own
  GROUP BY 1, 2) GROUP BY 1)
SELECT grp, id, CASE WHEN fit = 'fit' AND more IS NOT NULL THEN 'unverified' ELSE fit END AS fit, CASE WHEN fit = 'fit' AND more IS NOT NULL THEN CASE
  WHEN own AND more <> 'check ' || id % 2 THEN 'check ' || id % 2 || ',원문 확인,' || more WHEN own THEN 'check ' || id % 2 || ',원문 확인' ELSE '원문 확인,' ||
  more END
  ELSE CASE WHEN own THEN 'check ' || id % 2 || ',원문 확인' ELSE '원문 확인' END END AS checks FROM r LEFT JOIN m USING (grp) WHERE rep""")
def sibling_downgrade(spark: SparkSession, sf: str) -> DataFrame:
    """Representatives that are fit take the checks of their groups' other rows."""
    k = F.col("id")
    advice = F.lit(bridge.GENERIC[0])
    own = F.when(k % 4 == 1, F.array(F.concat(F.lit("check "), (k % 2).cast("string")), advice)).otherwise(F.array(advice))
    rep = F.row_number().over(Window.partitionBy("grp").orderBy("id")) == 1
    rows = grouping.keyed(bridge.announcements(spark, sf)).select("grp", "id", F.when(k % 3 == 0, "fit").otherwise("unverified").alias("fit"), own.alias("to_check"), rep.alias("rep"))
    return funding.sibling_downgrade(rows, bridge.GENERIC).select("grp", "id", "fit", F.array_join("to_check", ",").alias("checks"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size AS s FROM part), c AS (
  SELECT id, 0 AS o, 'region' AS key, '서울+경기' AS v FROM r WHERE id % 2 = 0 UNION ALL SELECT id, 1, 'industry', '제조' FROM r WHERE id % 3 = 0 UNION ALL
    SELECT id, 2, 'companyScale', '소상공인' FROM r WHERE id % 5 = 0
  UNION ALL SELECT id, 3, 'businessAgeMinYears', CAST(s AS VARCHAR) FROM r WHERE id % 7 = 0 UNION ALL SELECT id, 4, 'businessAgeMaxYears', CAST(s AS
    VARCHAR) FROM r WHERE id % 7 = 1 UNION ALL SELECT id, 5, 'creditScoreMin', CAST(600 + s AS VARCHAR) FROM r WHERE id % 4 = 1
  UNION ALL SELECT id, 7, 'revenueMaxKrw', CAST(s * 1000000 AS VARCHAR) FROM r WHERE id % 6 = 0 UNION ALL SELECT id, 8, 'employeeMax', CAST(s AS
    VARCHAR) FROM r WHERE id % 8 = 0 UNION ALL SELECT id, 9, 'isCorporation', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END FROM r WHERE id % 9 =
    0
  UNION ALL SELECT id, 10, 'hasExistingLoan', 'false' FROM r WHERE id % 10 = 3 UNION ALL SELECT id, 11, 'other', '39' FROM r WHERE id % 11 = 0)
SELECT id AS product_id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS ord, key, v AS value, key <> 'other' AS machine_readable FROM c""")
def product_conditions(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    rules = spark.read.parquet(f"{sf}/part.parquet").select(
        k.alias("product_id"),
        F.when(k % 2 == 0, words("서울", "경기")).alias("regions"),
        F.when(k % 3 == 0, words("제조")).otherwise(F.array().cast("array<string>")).alias("industries"),
        F.when(k % 5 == 0, words("소상공인")).alias("scales"),
        F.when(k % 7 == 0, size).alias("age_min"),
        F.when(k % 7 == 1, size).alias("age_max"),
        F.when(k % 4 == 1, 600 + size).alias("credit_min"),
        F.lit(None).cast("int").alias("credit_max"),
        F.when(k % 6 == 0, size.cast("long") * 1_000_000).alias("revenue_max"),
        F.when(k % 8 == 0, size).alias("employees_max"),
        F.when(k % 9 == 0, k % 2 == 0).alias("corporation"),
        F.when(k % 10 == 3, False).alias("existing_loan"),
        F.when(k % 11 == 0, 39).alias("owner_age"),
    )
    value = F.coalesce(F.array_join("values", "+"), F.col("number").cast("long").cast("string"), F.col("flag").cast("string"))
    return funding.product_conditions(rules).select("product_id", F.col("ord").cast("long").alias("ord"), "key", value.alias("value"), "machine_readable")


# Browsing

@query(f"WITH {ANN} SELECT count(DISTINCT grp) AS total, count(*) AS n FROM ann WHERE status = 'open' AND id % 2 = 0 AND id % 97 = 50")
def browse_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of any case in title or agency; its own wildcards are letters."""
    found = grouping.browse_rows(bridge.announcements(spark, sf), status="open", text="자금·융자 50호", fields=("title", "agency"))
    return grouping.keyed(found, trim=False).agg(F.count_distinct("grp").alias("total"), F.count("*").alias("n"))


@query("SELECT 0 AS n")
def browse_wildcards(spark: SparkSession, sf: str) -> DataFrame:
    """No title has a percent sign: the search for it finds nothing."""
    return grouping.browse_rows(bridge.announcements(spark, sf), text="50%", fields=("title", "agency")).agg(F.count("*").cast("int").alias("n"))


@query(f"""WITH {ANN} SELECT grp, id AS rep_id, n FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY apply_start DESC, id) AS k, count(*) OVER
  (PARTITION BY grp) AS n FROM ann WHERE status = 'closed') WHERE k = 1""")
def browse_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of the closed ones, newest first within a group."""
    return grouping.browse(bridge.announcements(spark, sf), "closed").select("grp", "rep_id", "n")


# Documents

FACT = """fact AS (SELECT o_custkey AS company_id, CASE o_orderkey % 3 WHEN 0 THEN 'industry' WHEN 1 THEN 'address' ELSE 'revenue' END AS field, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'value ' || o_orderkey % 4 END AS value,
  CASE WHEN o_orderkey % 5 > 0 THEN 2020 + o_orderkey % 5 END AS year, o_orderkey % 6 AS rank, o_orderkey AS ord FROM orders)"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").alias("company_id"),
        F.when(k % 3 == 0, "industry").when(k % 3 == 1, "address").otherwise("revenue").alias("field"),
        F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("value "), (k % 4).cast("string"))).alias("value"),
        F.when(k % 5 > 0, 2020 + k % 5).alias("year"),
        (k % 6).alias("rank"),
        k.alias("ord"),
    )


@query(f"""WITH {FACT}, o AS (SELECT company_id, field, value, max(year) AS year, min(rank) AS rank, min(ord) AS ord, count(*) AS n FROM fact WHERE trim(value) <> '' GROUP BY 1, 2, 3)
SELECT company_id, field, value, n_options, n AS n_documents FROM (SELECT *, row_number() OVER (PARTITION BY company_id, field ORDER BY year DESC NULLS LAST, rank, ord) AS k, count(*) OVER (PARTITION BY company_id, field) AS n_options FROM o) WHERE k = 1""")
def document_merge(spark: SparkSession, sf: str) -> DataFrame:
    return documents.merge_fields(_facts(spark, sf))


@query("""WITH r AS (SELECT l_orderkey AS company_id, 'p' || l_partkey % 7 AS name, CASE WHEN l_partkey % 50 = 0 THEN '123' ELSE printf('%06d-%07d', l_partkey % 7, l_partkey % 7) END AS number, CASE WHEN l_linenumber % 2 = 0 THEN '고용' ELSE '상실' END AS status FROM lineitem)
SELECT company_id, CASE WHEN count(*) FILTER (number = '123') = 0 THEN count(DISTINCT name || number) FILTER (status = '고용') END AS employees FROM r GROUP BY 1""")
def employee_count(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_partkey")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_orderkey").alias("company_id"),
        F.concat(F.lit("p"), (p % 7).cast("string")).alias("name"),
        F.when(p % 50 == 0, "123").otherwise(F.format_string("%06d-%07d", p % 7, p % 7)).alias("number"),
        F.when(F.col("l_linenumber") % 2 == 0, "고용").otherwise("상실").alias("status"),
    )
    return documents.head_count(rows)


@query(f"""WITH {FACT}, l AS (SELECT company_id, field, max(struct_pack(o := ord, v := value)).v AS value FROM fact GROUP BY 1, 2), p AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 2 = 0 THEN 'value 1' END AS industry, 'value 2' AS address FROM customer)
SELECT l.company_id, field, value, CASE field WHEN 'industry' THEN industry ELSE address END AS stored FROM l JOIN p USING (company_id) WHERE field <> 'revenue' AND value IS DISTINCT FROM CASE field WHEN 'industry' THEN industry ELSE address END""")
def profile_changes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    profile = spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("company_id"), F.when(k % 2 == 0, "value 1").alias("industry"), F.lit("value 2").alias("address"))
    return documents.profile_changes(_facts(spark, sf), profile, ("industry", "address"))


@query("""SELECT o_orderkey AS id, '담당 ○○○, ○○○ 및 홍길' || CASE WHEN o_orderkey % 2 = 0 THEN '순' ELSE '' END AS text FROM orders WHERE o_orderkey % 2 = 0 UNION
  ALL SELECT o_orderkey, '담당 ○○○, ○○○ 및 홍길' FROM orders WHERE o_orderkey % 2 = 1""")
def redacted_names(spark: SparkSession, sf: str) -> DataFrame:
    """Known names go from a text; a longer name goes before one that it holds."""
    text = F.concat(F.lit("담당 김철수, 홍길동 및 홍길"), F.when(F.col("o_orderkey") % 2 == 0, "순").otherwise(""))
    names = F.array(F.lit("철"), F.lit("홍길동"), F.lit("김철수"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), documents.redacted(text, names).alias("text"))


@query("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, '[' || l_linenumber || ']' AS marker, repeat('x', CAST(max(l_quantity) AS INTEGER)) AS body FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, 60 - sum(length(marker)) OVER (PARTITION BY doc_id) - coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN
  UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b)
SELECT doc_id, ord, marker || left(body, CAST(greatest(room, 0) AS INTEGER)) AS text FROM w""")
def text_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    marker = F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    blocks = lines.select(F.col("l_orderkey").alias("doc_id"), n.alias("ord"), marker.alias("marker"), F.expr("repeat('x', CAST(q AS INT))").alias("body"))
    return documents.cut_to_budget(blocks, 60)


@query("""WITH s AS (SELECT l_orderkey AS track_id, l_linenumber // 3 AS g, l_linenumber % 3 AS i, 'group ' || l_linenumber // 3 AS gn, 'step ' || l_partkey % 3 AS label, CASE WHEN l_linenumber % 2 = 0 THEN 'given' ELSE '' END AS id FROM lineitem),
o AS (SELECT *, CASE WHEN id <> '' THEN id ELSE 's-' || g || '-' || i || '-' || left(sha256(gn || label), 6) END AS own FROM s)
SELECT track_id, g, i, own || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS step_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id, own ORDER BY g, i) AS n FROM o)""")
def progress_step_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    g = F.floor(n / 3).cast("int")
    steps = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_orderkey").alias("track_id"), g.alias("g"), (n % 3).alias("i"), F.concat(F.lit("group "), g.cast("string")).alias("group_name"),
        F.concat(F.lit("step "), (F.col("l_partkey") % 3).cast("string")).alias("label"), F.when(n % 2 == 0, "given").otherwise("").alias("id"),
    )
    return documents.step_ids(steps)


_GAP_SQL = {"credit": "s % 3 = 0", "has_loan": "s % 4 = 3", "region": "s % 10 = 4", "industry": "s // 2 % 5 = 2", "founded": "s % 19 <> 0 AND s % 17 = 0", "revenue": "s % 7 = 0", "employees": "s % 5 = 0", "scale": "s % 4 = 0", "tax_delinquent": "s % 11 = 0", "has_cert": "s % 3 = 0", "has_patent": "s % 4 = 0", "bizno": "s % 5 IN (0)"}


_GAP_LIST = ", ".join(f"CASE WHEN {_GAP_SQL[k]} THEN '{label}' END" for k, (label, _) in funding.GAPS.items())


@query(f"""WITH c AS (SELECT s_suppkey AS s FROM supplier)
  SELECT s AS company_id, array_to_string(list_filter([{_GAP_LIST}], lambda x: x IS NOT NULL), ',') AS gaps FROM c""")
def profile_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What each company hasn't told, as far as a condition asks for it."""
    return funding.visible_gaps(bridge.companies(spark, sf), bridge.conditions(spark, sf)).select("company_id", F.array_join("gaps", ",").alias("gaps"))


@query(f"WITH {ANN}, {ITEM} SELECT funding_group, id FROM ranked ORDER BY {_SORTS['rec']} LIMIT 10 OFFSET 20")
def one_list_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of the recommended order."""
    return funding.page_of(_items(spark, sf), 3).select("funding_group", "id")


@query(f"WITH {ANN} SELECT id FROM ann WHERE status = 'open' AND (apply_end IS NULL OR apply_end > TIMESTAMP '{NOW}')")
def open_announcements(spark: SparkSession, sf: str) -> DataFrame:
    return funding.open_announcements(bridge.announcements(spark, sf), bridge.now()).select("id")


@query(f"""WITH {ANN}, {ITEM} SELECT tab, count(*) FILTER (fit = 'fit') AS fit, count(*) FILTER (fit = 'unverified') AS unverified, count(*) FILTER (fit = 'excluded') AS excluded
  FROM (SELECT 'all' AS tab, fit FROM ranked UNION ALL SELECT funding_group, fit FROM ranked) GROUP BY 1""")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of all items and of each group, in one pass."""
    count = lambda v: F.count_if(F.col("fit") == v).alias(v)
    found = _items(spark, sf).rollup("funding_group").agg(count("fit"), count("unverified"), count("excluded"), F.grouping("funding_group").alias("g"))
    return found.select(F.when(F.col("g") == 1, "all").otherwise(F.col("funding_group")).alias("tab"), "fit", "unverified", "excluded")


@query(f"""WITH {FULL}, n AS (SELECT bucket_id, count(*) FILTER (verdict = 'fit') AS fit, count(*) FILTER (verdict = 'unverified') AS unverified FROM match GROUP BY 1)
  SELECT b.bucket_id, b.category, coalesce(fit, 0) AS fit, coalesce(unverified, 0) AS unverified FROM bucket b JOIN n USING (bucket_id) WHERE category = 'grant' AND fit > 0""")
def deadline_list_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Grants with a company that fits."""
    found = deadline.bucket_list(bridge.buckets(spark, sf), bridge.matches(spark, sf), _today())
    return deadline.shown(found, "grant", fit_only=True).select("bucket_id", "category", "fit", "unverified")
