import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from eligo.functions import korean
from eligo.operators import evaluate, grouping, ledgers, totals
from eligo.operators.html_rows import rows_of
from eligo.plans import deadline, funding
from eligo.streaming.failures import in_a_row, stream_alerts


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "won"),
    [("최대 1억 2,000만원", 120_000_000), ("3천만 원", 30_000_000), ("1.5억원", 150_000_000), ("금액 없음", None), (None, None), ("", None), ("5백만", 5_000_000)],
)
def test_won_of(spark, text, won):
    assert one(spark, korean.won_of(F.col("t")), t=text) == won


@pytest.mark.parametrize(("won", "words"), [(None, "—"), (0, "—"), (-5, "—"), (9_999, "9,999원"), (15_000, "2만원"), (100_000_000, "1억원"), (123_450_000, "1억 2,345만원"), (1_200_000_000_000, "12,000억원")])
def test_format_won(spark, won, words):
    assert spark.createDataFrame([(won,)], "w long").select(korean.format_won(F.col("w")).alias("x")).first().x == words


def test_periods(spark):
    df = spark.createDataFrame([("20260801 ~ 2026-09-30",), ("상시",), ("20260231~20260301",), (None,)], "t string")
    start, end = korean.period_bounds(F.col("t"))
    rows = df.select(start.alias("s"), end.alias("e")).collect()
    assert rows[0].s == dt.datetime(2026, 7, 31, 15) and rows[0].e == dt.datetime(2026, 9, 30, 14, 59, 59)
    assert rows[1].s is None and rows[1].e is None and rows[2].s is None and rows[3].e is None


def test_dedup_key_ignores_marks(spark):
    assert one(spark, korean.dedup_key_of(F.col("a"), F.col("b")), a="(Seoul) 자금·융자 – 1", b="A. B") == "seoul자금융자1|ab"


CONDITION = "id long, key string, op string, values array<string>, number double, flag boolean, machine_readable boolean"
COMPANY = "company_id long, region string, district string, industry string, org_types array<string>, founded date, revenue long, employees long, scale string, tax_delinquent boolean, has_cert boolean, has_patent boolean, credit long, has_loan boolean, loan_uses array<struct<agency:string,name:string,sido:string,status:string>>, loan_uses_complete boolean, bizno string, is_corporation boolean"
NOW = "2024-06-01"


def graded(spark, conditions, companies, **kw):
    conds = spark.createDataFrame(conditions, CONDITION)
    firms = spark.createDataFrame(companies, COMPANY)
    anns = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    return {(r.id, r.company_id): (r.grade, r.score, r.fit) for r in evaluate.grades(anns, conds, firms, F.lit(NOW).cast("timestamp_ntz"), **kw).collect()}


def test_unknown_never_passes(spark):
    nothing = (1, *[None] * 17)
    busan = (2, "부산", None, None, None, None, 5, *[None] * 11)
    conds = [
        (1, "region", "in", ["서울"], None, None, True),
        (2, "region", "in", ["서울"], None, None, False),
        (3, "revenueMaxKrw", "lte", None, 5.0, None, True),
        (4, "revenueMaxKrw", "gte", None, 5.0, None, True),
        (5, "region", "in", ["전국"], None, None, True),
        (6, "other", "eq", None, None, None, True),
        (9, "region", "in", ["서울"], None, None, True),
        *[(3, "revenueMaxKrw", "lte", None, 5.0, None, True)] * 2,
    ]
    for kw in ({}, {"most_distinct": 0}):  # by arrays of verdicts, and pair by pair
        got = graded(spark, conds, [nothing, busan], **kw)
        assert len(got) == 14
        assert got[1, 1] == ("uncertain", 50, "unverified") and got[1, 2] == ("impossible", 10, "excluded")
        assert got[2, 2] == ("uncertain", 50, "unverified") and got[3, 2] == ("possible", 95, "fit") and got[4, 2] == ("uncertain", 50, "unverified")
        assert got[5, 2] == ("possible", 65, "unverified") and got[6, 2] == ("uncertain", 50, "unverified") and got[7, 1] == ("uncertain", 40, "unverified")


def test_companies_in_blocks(spark, monkeypatch):
    firms = [(i, "부산" if i % 2 else "서울", *[None] * 16) for i in range(40)]
    conds = [(i, "region", "in", ["서울"], None, None, True) for i in range(1, 5)]
    want = graded(spark, conds, firms)
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 1_000)
    assert graded(spark, conds, firms) == want and len(want) == 280


def test_blank_key_is_its_own_group(spark):
    rows = spark.createDataFrame([(1, ""), (2, " "), (3, None), (4, "k"), (5, "k")], "id long, dedup_key string")
    assert grouping.keyed(rows).select("grp").distinct().count() == 4


def test_pages_stop_at_streak(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 1, 1), ("c", 1, 1), ("c", 1, 1), ("c", 2, 2)], "source string, page int, key int")
    got = {r.source: (r.last_page, r.stopped, r.n_keys) for r in ledgers.stop_pages(rows).collect()}
    assert got == {"a": (3, True, 1), "b": (1, False, 1), "c": (2, False, 2)}


def test_stream_equals_batch(spark, tmp_path):
    runs = [(s, s * 100 + i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), (i * 7 + s) % 5 != 0) for s in range(4) for i in range(20)]
    df = spark.createDataFrame(runs, "source long, run_id long, run_at timestamp, failed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_alerts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.source, r.run_id) for r in spark.table("alerts").collect())
    assert got == sorted((r.source, r.run_id) for r in ledgers.alerts(df).collect()) and got


def test_failures_in_a_row_go_on_from_the_state():
    for failed, before in (([1, 1, 0, 1], 2), ([0, 0], 5), ([1], 0), ([1, 1, 1], 0)):
        n, want = before, []
        for f in failed:
            n = n + 1 if f else 0
            want.append(n)
        assert in_a_row(np.array(failed, bool), before).tolist() == want


def test_hot_browse_group_keeps_its_first_ids(spark):
    rows = spark.createDataFrame([(i, "k", "open", dt.datetime(2024, 1, 1), None if i % 2 else dt.datetime(2024, 2, 1)) for i in range(200)], "id long, dedup_key string, status string, apply_start timestamp, apply_end timestamp")
    r = grouping.browse(rows, "open").first()
    assert (r.n, r.rep_id) == (200, 0) and r.ids == ",".join(str(i) for i in range(0, 100, 2))
    assert grouping.browse(rows.limit(0), "open").count() == 0


def test_search_terms_and_wildcards(spark):
    assert funding.search("A  b　C") == ["a", "b", "c"]
    for bad in ("x" * 101, "a\x07"):
        with pytest.raises(ValueError):
            funding.search(bad)
    rows = spark.createDataFrame([(1, "50% off_now"), (2, "500 off now")], "id long, title string")
    found = grouping.browse_rows(rows, text="50% OFF_", fields=("title",)).collect()
    assert [r.id for r in found] == [1]


def test_scope_of_no_keys_is_empty(spark):
    firms = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "company_id long, readers array<string>")
    assert deadline.in_scope(firms, keys=[]).count() == 0 and deadline.in_scope(firms).count() == 2
    assert [r.company_id for r in deadline.in_scope(firms, reader="b").collect()] == [2]


def test_html_list_rows():
    page = "<table><tr><th>번호</th></tr>" + "".join(f"<tr><td>{i}<td><a href='/v?id={i}'>공고 {i}호 &amp; 안내</a><td>2026.8.{i}</tr>" for i in range(1, 5)) + "</table>"
    menu = "<ul>" + "".join(f"<li><a href='/m{i}'>메뉴 항목 {i}</a></li>" for i in range(9)) + "</ul>"
    assert rows_of(menu + page) == [(f"공고 {i}호 & 안내", f"/v?id={i}", f"2026.8.{i}") for i in range(1, 5)]
    assert [r[1] for r in rows_of(menu)] == [f"/m{i}" for i in range(9)]
    assert rows_of(None) == [] and rows_of("<ul><li><a href='x'>하나뿐</a></ul>") == [] and rows_of("<li><a href=1>a</a>" * 5) == []


def test_deadline_query_is_checked():
    assert deadline.parse_query({}) == {"view": "list", "scope": None, "days": 30, "hideEmpty": True}
    assert deadline.parse_query({"view": "company", "customerKey": "b:12", "days": "7", "includeProgress": "1"}) == {"view": "company", "days": 7, "includeUnstructured": False, "includeProgress": True, "customerKey": "b:12"}
    for bad in ({"view": "x"}, {"days": "8"}, {"hideEmpty": "yes"}, {"view": "company", "customerKey": "c:1"}, {"view": "bucket"}, {"view": "export", "category": "x" * 101}, {"scope": "none"}):
        with pytest.raises(ValueError):
            deadline.parse_query(bad)


def test_totals_equal_the_pairs(spark, monkeypatch):
    """By the matrix of verdicts, and pair by pair where it would be too large or a group is hot."""
    keys = [("region", "in", ["서울"], None, None, True), ("region", "in", ["전국"], None, None, True), ("revenueMaxKrw", "lte", None, 5.0, None, True), ("employeeMin", "gte", None, 3.0, None, True), ("other", "eq", None, None, None, True)]
    conds = spark.createDataFrame([(i, *keys[(i * k) % 5]) for i in range(1, 40) for k in range(i % 4)], CONDITION)
    firms = spark.createDataFrame([(i, ("부산", "서울", None)[i % 3], None, None, None, None, (4, 9, None)[i % 3], i, *[None] * 10) for i in range(7)], COMPANY)
    anns = spark.createDataFrame([(i, f"s{i % 3}", f"k{i % 11}", i % 2 == 0, None if i % 5 == 0 else i * 10, i) for i in range(1, 45)], "id long, source string, dedup_key string, even boolean, won long, checks long")
    now = F.lit(NOW).cast("timestamp_ntz")
    places = grouping.placed(anns.withColumn("apply_end", F.lit(None).cast("timestamp_ntz")))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    by_even = lambda: rows(totals.cells(anns, conds, firms, now, {"even": F.col("even")}, F.col("won")))
    picked = lambda: rows(totals.representatives(places, conds, firms, now))
    pairs = evaluate.grades(anns.select("id", "even", "won"), conds, firms, now)
    want = rows(pairs.groupBy("company_id", "even", "grade", "fit").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.max("won").alias("largest")))
    reps = rows(grouping.representatives(evaluate.grades(places.select("id", "grp", "place"), conds, firms, now), places, ["company_id"]))
    assert by_even() == want and picked() == reps and len(reps) == 77
    monkeypatch.setattr(totals, "PAIRS", 10)
    monkeypatch.setattr(totals, "CELLS", 1)
    assert by_even() == want and picked() == reps
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 100)
    assert by_even() == want
    monkeypatch.undo()
    none = totals.cells(anns.limit(0), conds, firms, now)
    assert none.count() == 0 and totals.cells(anns, conds.limit(0), firms, now).agg(F.sum("n")).first()[0] == 44 * 7
