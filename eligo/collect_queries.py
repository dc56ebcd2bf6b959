"""Queries of collection: envelopes, feeds, sweeps, page windows, detail pages, directories, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.operators import collect, html_rows
from eligo.streaming import failures

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet")


@query("SELECT o_orderkey AS id, i AS ord, 'name ' || (o_orderkey + i) AS name FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 5 <> 4")
def json_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Items under one of several keys, or the body itself; an envelope without any has none."""
    k = F.col("o_orderkey")
    items = F.concat(F.lit('[{"name": "name '), k.cast("string"), F.lit('"}, {"name": "name '), (k + 1).cast("string"), F.lit('", "x": 1}]'))
    wrapped = lambda name: F.concat(F.lit(f'{{"total": 2, "{name}": '), items, F.lit("}"))
    body = F.when(k % 5 == 0, wrapped("jsonArray")).when(k % 5 == 1, wrapped("items")).when(k % 5 == 2, wrapped("list")).when(k % 5 == 3, items).otherwise('{"total": 0}')
    found = _orders(spark, sf).select(k.alias("id"), collect.json_items(body, ("jsonArray", "items", "list"), "struct<name:string>").alias("items"))
    return found.select("id", F.posexplode("items").alias("ord", "x")).select("id", "ord", "x.name")


@query("""SELECT o_orderkey AS id, i AS ord, 'A & B <' || (o_orderkey + i) || '>' AS title, 'https://x/' || o_orderkey || '?a=1&b=' || i AS link FROM orders, (SELECT unnest([0, 1]) AS i)""")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of a feed: tags, CDATA and escaped marks."""
    k = F.col("o_orderkey").cast("string")
    second = (F.col("o_orderkey") + 1).cast("string")
    body = F.concat(
        F.lit("<rss><channel><item><title>A &amp; B &lt;"), k, F.lit("&gt;</title><link>https://x/"), k, F.lit("?a=1&amp;b=0</link></item>\n<item id='2'><title><![CDATA[A & B <"), second,
        F.lit(">]]></title><link>https://x/"), k, F.lit("?a=1&amp;b=1</link></item></channel></rss>"),
    )
    rows = _orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.posexplode(collect.xml_rows(body)).alias("ord", "x"))
    return rows.select("id", "ord", F.col("x")["title"].alias("title"), F.col("x")["link"].alias("link"))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS recruiting, '사업 ' || o_orderkey AS title FROM orders")
def xml_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose columns are named by an attribute."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('<data><item><col name="biz_nm">사업 '), k.cast("string"), F.lit('</col><col name="rcrt_prgs_yn">'), F.when(k % 2 == 0, "Y").otherwise("N"), F.lit("</col></item></data>"))
    rows = _orders(spark, sf).select(k.alias("id"), F.explode(collect.xml_rows(body)).alias("x"))
    return rows.select("id", (F.col("x")["rcrt_prgs_yn"] == "Y").alias("recruiting"), F.col("x")["biz_nm"].alias("title"))


PAGES = "(SELECT o_custkey AS source, o_orderkey % 6 + 1 AS page, o_orderkey % 90 AS key FROM orders)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _orders(spark, sf).select(F.col("o_custkey").alias("source"), (k % 6 + 1).alias("page"), (k % 90).alias("key"))


@query(f"""WITH h AS (SELECT source, page, sha256(string_agg(CAST(key AS VARCHAR), chr(10) ORDER BY CAST(key AS VARCHAR))) AS digest FROM (SELECT DISTINCT * FROM
  {PAGES}) GROUP BY 1, 2) SELECT source, page, digest, coalesce(lag(digest) OVER (PARTITION BY source ORDER BY page) = digest, false) AS repeats FROM
  h""")
def page_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return collect.page_repeats(_pages(spark, sf))


@query(f"""WITH p AS (SELECT source, page, list(key ORDER BY key) AS ids FROM {PAGES} GROUP BY 1, 2), t AS (SELECT *, CASE WHEN source % 4 = 0 AND page > 1 THEN 7 ELSE 3 END AS total, 2 AS size FROM p),
i AS (SELECT source, count(*) AS n, count(DISTINCT id) AS n_ids FROM (SELECT source, unnest(ids) AS id FROM t) GROUP BY 1),
f AS (SELECT source, min(total) AS low, max(total) AS high, max(page) AS last, count(*) AS n_pages, count(*) FILTER (len(ids) <> size AND page * size
  <= total) AS short FROM t GROUP BY 1)
SELECT f.source, n_ids, CASE WHEN low <> high THEN 'total' WHEN n_pages <> last THEN 'pages' WHEN short > 0 THEN 'short' WHEN n <> n_ids THEN 'twice' WHEN n < high THEN 'missing' ELSE 'whole' END AS state FROM f JOIN i USING (source)""")
def complete_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the pages of a source make a whole read, and what is wrong first."""
    pages = _pages(spark, sf).groupBy("source", "page").agg(F.collect_list("key").alias("ids"))
    told = pages.withColumns({"total": F.when((F.col("source") % 4 == 0) & (F.col("page") > 1), 7).otherwise(3), "size": F.lit(2)})
    return collect.complete_pages(told)


@query("""WITH k AS (SELECT o_orderkey * 2 AS n FROM orders WHERE o_orderkey % 3 = 0), e AS (SELECT greatest(600, max(n) + 200) AS e FROM k) SELECT n, 'SI' ||
  printf('%08d', n) AS id FROM (SELECT unnest(range(1, e + 1)) AS n FROM e UNION SELECT n FROM k)""")
def sweep_plan(spark: SparkSession, sf: str) -> DataFrame:
    known = _orders(spark, sf).where("o_orderkey % 3 = 0").select(F.format_string("SI%08d", F.col("o_orderkey") * 2).alias("id"))
    return collect.planned_ids(known, spark)


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 > 0)")
def sweep_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Known rows that weren't seen, or failed."""
    k = F.col("id")
    known = _orders(spark, sf).select(F.col("o_orderkey").alias("id"))
    return collect.restored(known, known.where(k % 2 == 0).withColumn("parsed", k % 5 > 0))


@query("""SELECT CASE WHEN 2 * count(*) FILTER (o_orderkey % 4 = 0) > count(*) THEN 'network' WHEN 2 * count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 7 =
  0) >= count(*) FILTER (o_orderkey % 3 = 0) THEN 'known' WHEN 10 * count(*) FILTER (o_orderkey % 7 > 0) < count(*) THEN 'few' ELSE 'good' END AS
  verdict, count(*) AS n FROM orders""")
def sweep_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    ids = _orders(spark, sf).select(F.col("o_orderkey").alias("id"))
    return collect.sweep_verdict(ids.withColumns({"parsed": k % 7 > 0, "broken": k % 4 == 0}), ids.where(k % 3 == 0))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'page,start' WHEN 2 THEN '/path' ELSE '' END AS params FROM orders")
def paging_params(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = k.cast("string")
    first = F.when(k % 4 == 0, F.concat(F.lit("https://x/list?b="), own, F.lit("&page=1"))).when(k % 4 == 1, F.concat(F.lit("https://x/list?page=1&b="), own, F.lit("&start=0"))).when(k % 4 == 2, "https://x/list/1").otherwise("https://x/list?b=1")
    second = F.when(k % 4 == 0, F.concat(F.lit("https://x/list?b="), own, F.lit("&page=2"))).when(k % 4 == 1, F.concat(F.lit("https://x/list?page=2&b="), own, F.lit("&start=10"))).when(k % 4 == 2, "https://x/list/2").otherwise("https://x/list?b=1")
    return _orders(spark, sf).select(k.alias("id"), F.array_join(collect.paging_params(first, second), ",").alias("params"))


@query("SELECT o_orderkey AS id, o_orderkey % 5 > 0 AND (o_orderkey % 3 = 1 OR o_orderkey % 2 = 1) AS changed FROM orders")
def attachments_changed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    some = lambda *x: F.array(*[F.lit(v) for v in x])
    before = F.when(k % 5 > 0, some("a", "b"))
    after = F.when(k % 3 == 1, some("a")).when(k % 2 == 1, some("b", "a", "c")).otherwise(some("b", "a"))
    return _orders(spark, sf).select(k.alias("id"), collect.attachments_changed(before, after).alias("changed"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'print|1,file2|2' ELSE 'file1|1,file2|2' END AS files FROM orders")
def merged_attachments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    file = lambda name, url: F.struct(F.lit(name).alias("name"), F.lit(url).alias("url"))
    printed = F.when(k % 2 == 0, F.array(file("print", "1")))
    found = collect.merged_attachments(printed, F.array(file("file1", "1"), file("file2", "2"), file("file3", "2")))
    return _orders(spark, sf).select(k.alias("id"), F.array_join(F.transform(found, lambda x: F.concat_ws("|", x["name"], x["url"])), ",").alias("files"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'detail' WHEN o_orderkey % 3 = 0 THEN '' ELSE 'own' END AS body, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '1998-01-01' ELSE o_orderdate END AS apply_start,
  CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '1998-02-01' END AS apply_end, CASE WHEN o_orderkey % 10 = 0 THEN 'closed' ELSE 'open' END AS status FROM orders""")
def detail_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows of even ids have a detail page; a period counts when both of its ends are there."""
    k = F.col("id")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    base = _orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("own").alias("body"), F.col("o_orderdate").alias("apply_start"), F.lit(None).cast("timestamp_ntz").alias("apply_end"), F.lit("open").alias("status"))
    detail = base.where(k % 2 == 0).select("id", F.lit("detail").alias("body"), at("1998-01-01").alias("start"), F.when(k % 4 == 0, at("1998-02-01")).alias("end"), (k % 10 == 0).alias("gone"))
    return collect.filled(base, detail)


@query("""WITH s AS (SELECT c_custkey AS source, CASE c_custkey % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'candidate' WHEN 2 THEN 'blocked' ELSE 'excluded' END AS listed, c_custkey % 3 > 0 AS connected, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 END AS saved, c_custkey % 7 = 0 AS error,
  CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 2 = 1 END AS hit, CASE WHEN c_custkey % 8 > 0 THEN c_custkey % 100 END AS cap_at, CASE WHEN c_custkey % 5
    > 0 AND c_custkey % 9 > 0 THEN 50 END AS ran_at FROM customer)
SELECT source, CASE WHEN NOT connected THEN listed WHEN listed IN ('blocked', 'excluded') AND coalesce(saved, 0) <= 0 THEN listed WHEN c.error AND
  saved IS NOT NULL AND coalesce(saved, 0) = 0 THEN 'error' ELSE 'connected' END AS status,
  CASE WHEN NOT coalesce(hit, false) THEN false WHEN ran_at IS NULL THEN true WHEN cap_at IS NULL THEN NULL ELSE cap_at >= ran_at END AS hit_cap FROM s c""")
def directory_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    sources = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", k.alias("source"))
    listed = sources.select("source", F.when(k % 4 == 0, "waiting").when(k % 4 == 1, "candidate").when(k % 4 == 2, "blocked").otherwise("excluded").alias("listed"))
    caps = sources.where(k % 6 > 0).select("source", (k % 2 == 1).alias("hit"), F.when(k % 8 > 0, k % 100).alias("cap_at"))
    runs = sources.where(k % 5 > 0).select("source", (k % 2).alias("saved"), (k % 7 == 0).alias("error"), F.when(k % 9 > 0, F.lit(50)).alias("ran_at"))
    return collect.directory_status(listed, sources.where(k % 3 > 0), caps, runs)


@query("""WITH a AS (SELECT o_custkey AS source, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_suppkey AS source, count(*) AS n FROM lineitem GROUP BY
  1) SELECT source, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS n FROM a FULL JOIN b USING (source)""")
def merged_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Saved announcements and products by source."""
    ours = _orders(spark, sf).groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("n"))
    products = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("n"))
    return collect.merged_counts(ours, products)


@query("""SELECT l_orderkey AS run_id, CASE WHEN count(*) = count(*) FILTER (l_linenumber % 3 = 1) THEN 'all-failed' WHEN count(*) FILTER (l_linenumber % 3 = 1)
  > 0 THEN 'partial' ELSE 'ok' END AS outcome FROM lineitem GROUP BY 1""")
def fetch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return collect.outcome(spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") % 3 == 1).alias("failed")))


@query("""WITH r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'failed' ELSE 'pending' END AS s, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS v FROM orders)
SELECT count(*) AS total, count(*) FILTER (s = 'done' AND v >= 4) AS done, count(*) FILTER (s = 'needs_review' AND v >= 4) AS needs_review, count(*)
  FILTER (s = 'failed') AS failed,
  count(*) - count(*) FILTER (s = 'done' AND v >= 4) - count(*) FILTER (s = 'needs_review' AND v >= 4) - count(*) FILTER (s = 'failed') AS pending FROM r""")
def structure_progress(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _orders(spark, sf).select(F.when(k % 4 == 0, "done").when(k % 4 == 1, "needs_review").when(k % 4 == 2, "failed").otherwise("pending").alias("status"), F.when(k % 5 > 0, k % 7).alias("version"))
    return collect.structure_progress(rows)


@query("SELECT o_orderkey AS id, 'a < b & \"c\"' || chr(39) || o_orderkey AS text FROM orders")
def html_entities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _orders(spark, sf).select(k.alias("id"), collect.entities(F.concat(F.lit("a &lt; b &amp; &quot;c&quot;&#39;"), k.cast("string"))).alias("text"))


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share; only a local master gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="eligo-stream-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@query("""WITH runs AS (SELECT event_id AS run_id, user_id AS source, ts AS run_at, event_type = 'error' AS failed FROM events), s AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY run_at, run_id) AS g FROM runs),
c AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source, g ORDER BY run_at, run_id) AS k FROM s) SELECT source, run_id, 3 AS in_a_row FROM c WHERE failed AND k % 3 = 0""")
def failure_alert_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts as a stream over the run table's file, to its end; the sink is read back."""
    at = _shared(spark, "alerts")
    events = spark.read.parquet(f"{sf}/events.parquet")
    raw = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    runs = raw.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source"), F.col("ts").alias("run_at"), (F.col("event_type") == "error").alias("failed"))
    sink = failures.stream_alerts(runs).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(failures.OUTPUT).parquet(f"{at}/out")


@query("SELECT user_id AS source, date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY 1, 2")
def run_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by day and source."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return failures.run_rates(events.select(F.col("user_id").alias("source"), F.col("ts").alias("run_at"), (F.col("event_type") == "error").alias("failed"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS u, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM pages)
SELECT page_id, title, url FROM (SELECT page_id, unnest(t) AS title, unnest(u) AS url FROM r WHERE len(u) >= 3) WHERE length(title) >= 4""")
def html_list_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the list that each page has."""
    return html_rows.list_rows(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "title", "url")
