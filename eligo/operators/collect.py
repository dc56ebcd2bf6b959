"""Reading sources: envelopes of JSON, items of XML and feeds, id sweeps, page windows, and what changed since the last read.
Input are bytes already fetched, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An id sweep's first end and how far it looks beyond the largest known id.
SEED_END, FRONTIER = 600, 200
ID_FORMAT = "SI%08d"


def json_items(body: Column, keys: tuple[str, ...], item_type: str) -> Column:
    """The array of items in an envelope: under the first of the keys that has one; an array by itself counts as well."""
    arrays = [F.from_json(F.get_json_object(body, f"$.{key}"), f"array<{item_type}>") for key in keys]
    return F.coalesce(*arrays, F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{item_type}>")))


def complete_pages(pages: DataFrame) -> DataFrame:
    """pages (source, page, total, size, ids): per source whether the read is whole: one total throughout, full pages but for the
    last, no id twice; and which rule is broken first."""
    ids = pages.select("source", F.explode("ids").alias("id")).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))
    facts = pages.groupBy("source").agg(
        F.min("total").alias("low"), F.max("total").alias("high"), F.max("page").alias("last"), F.count_distinct("page").alias("n_pages"),
        F.count_if((F.size("ids") != F.col("size")) & (F.col("page") * F.col("size") <= F.col("total"))).alias("short"),
    )
    why = (
        F.when(F.col("low") != F.col("high"), "total")
        .when(F.col("n_pages") != F.col("last"), "pages")
        .when(F.col("short") > 0, "short")
        .when(F.col("n") != F.col("n_ids"), "twice")
        .when(F.col("n") < F.col("high"), "missing")
        .otherwise("whole")
    )
    return facts.join(ids, "source", "left").na.fill(0, ["n", "n_ids"]).select("source", "n_ids", why.alias("state"))


def xml_rows(body: Column, tag: str = "item") -> Column:
    """The items of an XML body as maps: tags to texts, or <col name="..."> to texts. CDATA is taken as it is. Of a tag that an item
    has twice the first text counts. An item ends at the next </item>; what is after the last one is no item."""
    pieces = F.split(body, f"</{tag}\\s*>")
    opened = f"(?s)<{tag}(?:\\s[^>]*)?>(.*)$"
    items = F.transform(F.filter(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: x.rlike(opened)), lambda x: F.regexp_extract(x, opened, 1))
    plain = lambda x: entities(F.regexp_replace(F.trim(x), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))

    def fields(x: Column) -> Column:
        pattern = r'(?s)<(?:col\s+name="([^"]+)"|([A-Za-z][\w:.-]*))[^>]*>(.*?)</(?:col|\2)>'
        part = lambda i: F.regexp_extract_all(x, F.lit(pattern), i)
        names = F.zip_with(part(1), part(2), lambda a, b: F.when(a != "", a).otherwise(b))
        texts = part(3)
        entries = F.transform(F.array_distinct(names), lambda k: F.struct(k, plain(F.get(texts, (F.array_position(names, k) - 1).cast("int")))))
        return F.map_from_entries(entries)

    return F.transform(items, lambda x: fields(x))


def entities(text: Column) -> Column:
    """The five named marks of HTML, in this order."""
    for mark, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def planned_ids(known: DataFrame, spark) -> DataFrame:
    """Ids to read: from 1 to the seed's end or beyond the largest known one, and all known ones, in order of their numbers."""
    numbers = known.select(F.regexp_extract("id", "^SI([0-9]{8})$", 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("n"))
    end = numbers.agg(F.greatest(F.lit(SEED_END), F.coalesce(F.max("n"), F.lit(0)) + FRONTIER)).first()[0]
    every = spark.range(1, end + 1).select(F.col("id").alias("n")).unionByName(numbers).distinct()
    return every.select("n", F.format_string(ID_FORMAT, "n").alias("id"))


def restored(known: DataFrame, read: DataFrame) -> DataFrame:
    """Known rows that a sweep didn't see, or saw fail: they stay as they were."""
    seen = read.where("parsed").select("id").distinct()
    return known.join(seen, "id", "left_anti")


def sweep_verdict(read: DataFrame, known: DataFrame) -> DataFrame:
    """One row: whether a sweep counts. Not with half of the known ids failed, under a tenth parsed, or over half of all broken by
    the network."""
    rows = read.join(known.select("id", F.lit(True).alias("was_known")), "id", "left")
    n, was = F.count("*"), F.coalesce("was_known", F.lit(False))
    known_bad = 2 * F.count_if(was & ~F.col("parsed")) >= F.greatest(F.count_if(was), F.lit(1))
    return rows.agg(F.when(2 * F.count_if("broken") > n, "network").when(known_bad, "known").when(10 * F.count_if("parsed") < n, "few").otherwise("good").alias("verdict"), n.alias("n"))


def page_repeats(pages: DataFrame) -> DataFrame:
    """pages (source, page, key): per page a digest of its keys in order, and whether it repeats the page before it."""
    held = pages.groupBy("source", "page").agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.col("key").cast("string"))), "\n"), 256).alias("digest"))
    before = F.lag("digest").over(Window.partitionBy("source").orderBy("page"))
    return held.withColumn("repeats", F.coalesce(before == F.col("digest"), F.lit(False)))


def paging_params(first: Column, second: Column) -> Column:
    """Parameters whose values differ between the addresses of page 1 and page 2, in the order of page 1; "/path" where none does
    but the path has a number."""
    query = lambda url: F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = lambda url: F.transform(F.filter(F.split(query(url), "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v")))
    path = lambda url: F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    moved = F.filter(pairs(first), lambda a: F.exists(pairs(second), lambda b: (b["k"] == a["k"]) & (b["v"] != a["v"])))
    names = F.transform(moved, lambda a: a["k"])
    by_path = (path(first) != path(second)) & path(second).rlike(r"/[0-9]+(/|$)")
    return F.when(F.size(names) > 0, names).when(by_path, F.array(F.lit("/path"))).otherwise(F.array().cast("array<string>"))


def attachments_changed(before: Column, after: Column) -> Column:
    """Whether two sets of attachments differ; nothing known before is no change."""
    return F.coalesce((F.size(F.array_except(before, after)) > 0) | (F.size(F.array_except(after, before)) > 0), F.lit(False))


def merged_attachments(printed: Column, files: Column) -> Column:
    """Printed ones, then files; of one address the first stays. Both are arrays of (name, url)."""
    every = F.concat(F.coalesce(printed, files), F.when(printed.isNotNull(), files).otherwise(F.slice(files, 1, 0)))
    urls = F.transform(every, lambda x: x["url"])
    return F.filter(every, lambda x, i: F.array_position(urls, x["url"]) == i + 1)


def filled(base: DataFrame, detail: DataFrame) -> DataFrame:
    """base (id, title, body, apply_start, apply_end, status) with what its detail page read. An empty body is filled, a period is
    taken when both ends are there, a page that is gone closes the row."""
    d = detail.select("id", F.col("body").alias("d_body"), F.col("start").alias("d_start"), F.col("end").alias("d_end"), "gone")
    whole = F.col("d_start").isNotNull() & F.col("d_end").isNotNull()
    return base.join(d, "id", "left").select(
        "id",
        F.coalesce(F.nullif("body", F.lit("")), "d_body", "body").alias("body"),
        F.when(whole, F.col("d_start")).otherwise(F.col("apply_start")).alias("apply_start"),
        F.when(whole, F.col("d_end")).otherwise(F.col("apply_end")).alias("apply_end"),
        F.when(F.coalesce("gone", F.lit(False)), "closed").otherwise(F.col("status")).alias("status"),
    )


def directory_status(directory: DataFrame, connected: DataFrame, caps: DataFrame, runs: DataFrame) -> DataFrame:
    """directory (source, listed) with its state: as listed until connected; a connected one that is listed blocked or excluded,
    and saved nothing, stays so; an error without a saved row is an error. hit_cap: a cap that the last run didn't pass."""
    own = connected.select("source", F.lit(True).alias("on")).distinct()
    rows = directory.join(own, "source", "left").join(caps.select("source", "hit", "cap_at"), "source", "left").join(runs.select("source", "saved", "error", "ran_at"), "source", "left")
    saved = F.coalesce("saved", F.lit(0))
    live = F.when(F.col("listed").isin("blocked", "excluded") & (saved <= 0), F.col("listed")).when(F.coalesce("error", F.lit(False)) & (saved == 0), "error").otherwise("connected")
    cap = F.when(~F.coalesce("hit", F.lit(False)), False).when(F.col("ran_at").isNull(), True).when(F.col("cap_at").isNull(), None).otherwise(F.col("cap_at") >= F.col("ran_at"))
    return rows.select("source", F.when(F.coalesce("on", F.lit(False)), live).otherwise(F.col("listed")).alias("status"), cap.alias("hit_cap"))


def merged_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts (source, n) of two kinds of rows, added up."""
    return left.unionByName(right).groupBy("source").agg(F.sum("n").alias("n"))


def outcome(results: DataFrame) -> DataFrame:
    """results (run_id, failed): ok, partial or all-failed; and the time a ledger keeps: the previous one where all failed."""
    bad = F.count_if("failed")
    return results.groupBy("run_id").agg(F.when(bad == F.count("*"), "all-failed").when(bad > 0, "partial").otherwise("ok").alias("outcome"))


def structure_progress(rows: DataFrame, version: int = 4) -> DataFrame:
    """rows (status, version): one row of counts; done and needs_review count from this version on, the rest is pending."""
    deep, s = F.coalesce(F.col("version") >= version, F.lit(False)), F.col("status")
    done, review, failed = (s == "done") & deep, (s == "needs_review") & deep, s == "failed"
    return rows.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(review).alias("needs_review"), F.count_if(failed).alias("failed"), F.count_if(~(done | review | failed)).alias("pending"))
