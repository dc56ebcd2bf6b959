"""Steps whose work has to stay in proportion to the input."""

import pytest
from pyspark.sql import functions as F

from eligo import cases, queries
from eligo.operators import collect, evaluate, totals

SF = "/root/testdata/sf0.001"


def test_sweep_is_dealt_out(spark):
    """no row holds all numbers."""
    plan = collect.planned_ids(spark.createDataFrame([("SI00000700",)], "id string"), spark)
    assert "sequence(" not in plan._jdf.queryExecution().toString()
    assert plan.count() == 900


@pytest.mark.parametrize("name", ["grade_and_score", "group_blocks", "glance", "diagnose_summary"])
def test_totals_never_make_pairs(spark, monkeypatch, name):
    """companies whose verdicts are too large for one broadcast come in blocks, with the same result."""
    rows = lambda: sorted(tuple(map(str, r)) for r in queries.QUERIES[name](spark, SF).collect())
    want = rows()

    def pairs(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(evaluate, "grades", pairs)
    monkeypatch.setattr(totals, "TILE", 3)
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 4_000)
    assert rows() == want


def test_companies_of_equal_facts_meet_a_condition_once(spark):
    """verdicts are worked out by facts, not by company."""
    from eligo.sources import bridge

    conditions, companies = bridge.conditions(spark, SF).where("key = 'region'"), bridge.companies(spark, SF)
    many = companies.crossJoin(spark.range(30).withColumnRenamed("id", "copy")).withColumn("company_id", F.col("copy") * 1_000_000 + F.col("company_id")).drop("copy")
    one, all_ = (evaluate.by_facts(conditions, c, bridge.now())[0].count() for c in (companies, many))
    assert one == all_


def test_equal_sentences_are_read_once(spark):
    """a rule's expression meets distinct sentences, every order stays."""
    rows, met = spark.createDataFrame([(i, None if i % 3 == 0 else f"x{i % 3}") for i in range(60)], "id long, x string"), []

    def found(once):
        met.append(once.count())
        return once.select("__told", F.upper("x").alias("y"))

    got = {r.id: r.y for r in cases.by_distinct(rows, "id", found).collect()}
    assert met == [3] and got == {i: None if i % 3 == 0 else f"X{i % 3}" for i in range(60)}


def test_toxicity_is_fitted_off_the_driver(spark, monkeypatch):
    """Of the sample nothing comes to the driver but the weights."""
    from eligo.llm import toxicity

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    real = type(docs).collect

    def collect(df):
        assert "text" not in df.columns
        return real(df)

    monkeypatch.setattr(type(docs), "collect", collect)
    assert toxicity.train(docs, labels).weights.any()


def test_first_rows_never_make_pairs(spark, monkeypatch):
    """the first rows of a group and fit without a pair, also where companies come in blocks."""
    rows = lambda: sorted(tuple(map(str, r)) for r in queries.QUERIES["top_n_per_verdict"](spark, SF).collect())
    want = rows()

    def pairs(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(evaluate, "grades", pairs)
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 4_000)
    assert rows() == want and len(want) > 1000


@pytest.mark.parametrize("chunk", [7, 1000])
def test_first_rows_are_those_of_all_pairs(monkeypatch, chunk):
    """rows that are passed over unread are never among the first."""
    import numpy as np
    import pyarrow as pa

    rng, n, firms = np.random.default_rng(chunk), 600, 9
    code = rng.choice([1, 2, 3], (12, firms), p=[0.7, 0.15, 0.15])
    strong = np.arange(12) % 4 != 0
    known = totals.Profiles(np.arange(firms), code == 1, code == 2, strong)
    own = sorted((list(rng.choice(12, rng.integers(0, 5), replace=False)) for _ in range(n)), key=len, reverse=True)
    fixed, rank = rng.integers(0, 2, n), rng.permutation(n)
    monkeypatch.setattr(totals, "PAIRS", chunk * firms)
    lists = pa.array([[{"n": int(x), "k": 1} for x in xs] for xs in own], pa.list_(pa.struct([("n", pa.int32()), ("k", pa.int64())])))
    total = np.array([len(xs) for xs in own])
    batch = pa.RecordBatch.from_arrays([pa.array(["g"] * n), pa.array([0] * n, pa.int32()), lists, pa.array(fixed), pa.array(total), pa.array(rank), pa.array(rank + 5000)], names=list("gtofnri"))
    got = [tuple(r.values()) for b in totals._first_rows(known, 10, firms)([batch]) for r in b.to_pylist()]
    want = []
    for c in range(firms):
        of: dict[str, list] = {}
        for xs, f, r in zip(own, fixed, rank, strict=True):
            p, bad = sum(code[x, c] == 1 for x in xs), sum(code[x, c] == 2 for x in xs)
            fit = "excluded" if bad else "fit" if xs and p == len(xs) and not f and any(strong[x] for x in xs) else "unverified"
            of.setdefault(fit, []).append((-(50 + 15 * p - 40 * bad if len(xs) + f else 40), r))
        want += [(c, "g", fit, -s, r + 5000, i + 1) for fit, rows in of.items() for i, (s, r) in enumerate(sorted(rows)[:10])]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_equal_parts_of_a_strict_fit_are_told_once(spark, monkeypatch, few):
    """what is worked out grows with distinct values, whether they go to every task or meet the rows by a shuffle."""
    from eligo import strict_queries
    from eligo.operators import strict
    from eligo.sources import held

    pairs = strict_queries._pairs(spark, SF).limit(200)
    many = pairs.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn("id", F.col("id") * 20 + F.col("copy")).drop("copy")
    met, real = [], held.held

    def count(df):
        met.append(df.count())
        return real(df)

    monkeypatch.setattr(held, "held", count)
    monkeypatch.setattr(held, "FEW", few)
    one, all_ = (strict.verdicts(x).groupBy("loose", "strict", "blocked").count().collect() for x in (pairs, many))
    assert met[:4] == met[4:] and {tuple(r[:3]): r[3] * 20 for r in one} == {tuple(r[:3]): r[3] for r in all_}


def test_equal_notices_and_companies_are_reviewed_once(spark):
    """F8, F10: pairs that are reviewed don't grow with equal lines and equal companies; each is counted for its own company."""
    from eligo import review_queries
    from eligo.operators import review
    from eligo.sources import bridge

    firms = review.customers(evaluate.prepared_companies(bridge.companies(spark, SF).limit(4), bridge.now())).select(*review.COMPANY)
    copies = firms.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumn("company_id", F.col("copy") * 1000 + F.col("company_id")).drop("copy")
    pairs = review_queries._pairs(spark, SF).limit(60).drop("company_id")
    one, all_ = (review.once(pairs.crossJoin(c.select("company_id")), c) for c in (firms, copies))
    assert one[0].count() == all_[0].count() < 240
    assert all_[1].agg(F.sum("n")).first()[0] == 3 * 240


def test_words_of_location_are_tried_at_their_first_letters(spark):
    """no word is lost by it, at the text's ends and overlapping too."""
    import re

    from eligo.operators import extract

    words = [w.replace(r"\s*", " ") for w in extract.REGION_WORDS.split("|")]
    assert all(re.match(extract.REGION_FIRST, w) for w in words)
    texts = [f"{w} 경기도" for w in words] + [f"{'가 ' * 40}경기도 {w}" for w in words] + ["", "경기도", "관내 기업 부산"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", extract._places(F.col("t"))["values"].alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [["경기"]] * (2 * len(words)) + [None, None, ["부산"]]


def test_large_groups_are_picked_some_rows_at_once(monkeypatch):
    """a task never holds all pairs of a large group, and picks the same."""
    import numpy as np
    import pyarrow as pa

    rng, n, firms = np.random.default_rng(1), 500, 8
    code = rng.choice([1, 2, 3], (10, firms), p=[0.6, 0.2, 0.2])
    known = totals.Profiles(np.arange(firms), code == 1, code == 2, np.arange(10) % 3 != 0)
    lists = pa.array([[{"n": int(x), "k": 1} for x in rng.choice(10, rng.integers(0, 4), replace=False)] for _ in range(n)], pa.list_(pa.struct([("n", pa.int32()), ("k", pa.int64())])))
    groups = sorted(["large"] * 400 + [f"g{i % 30}" for i in range(n - 400)])
    batch = pa.RecordBatch.from_arrays([lists, pa.array(rng.integers(0, 2, n)), pa.array(groups), pa.array(np.arange(n) + 7), pa.array([1] * n)], names=list("ofgis"))
    real, met = totals.fits, []

    def fits(known, own, fixed):
        met.append(len(own))
        return real(known, own, fixed)

    def picked(pairs):
        monkeypatch.setattr(totals, "PAIRS", pairs)
        return sorted((r["grp"], r["group_count"], tuple(tuple(x.values()) for x in r["reps"])) for b in totals._picks(known)([batch]) for r in b.to_pylist())

    want = picked(10**9)
    monkeypatch.setattr(totals, "fits", fits)
    assert picked(20 * firms) == want and max(met) <= 20


def test_tables_of_near_texts_are_matched_together(spark, monkeypatch):
    """the driver plans a few index joins, not one for each table of fingerprints, and meets their links with the texts once."""
    from eligo.llm import near

    met, real = [], near.links

    def links(prints, distance):
        met.append(sorted(r.table for r in prints.select("table").distinct().collect()))
        return real(prints, distance)

    monkeypatch.setattr(near, "links", links)
    rows = spark.createDataFrame([(i, i, " ".join(f"w{j}" for j in range(40)) + f" x{i % 3}") for i in range(9)], "a long, b long, text string")
    assert len({r.root for r in near.verified_groups(rows, ("a", "b")).collect()}) == 1
    assert met == [[0, 1, 2, 3], [4, 5, 6, 7]]


@pytest.mark.parametrize("pairs", [40, 10**9])
def test_a_group_is_told_by_its_rows(monkeypatch, pairs):
    """F1 of round 4: a group has an entry for each row and fit that stands for companies, not one for each company."""
    import numpy as np
    import pyarrow as pa

    rng, n, firms = np.random.default_rng(2), 300, 50
    code = rng.choice([1, 2, 3], (10, firms), p=[0.7, 0.1, 0.2])
    known = totals.Profiles(np.arange(firms) * 3, code == 1, code == 2, np.arange(10) % 3 != 0)
    own = [list(rng.choice(10, rng.integers(0, 4), replace=False)) for _ in range(n)]
    fixed, groups = rng.integers(0, 2, n), sorted([*["large"] * 100, *(f"g{i % 90}" for i in range(n - 100))])
    lists = pa.array([[{"n": int(x), "k": 1} for x in xs] for xs in own], pa.list_(pa.struct([("n", pa.int32()), ("k", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([lists, pa.array(fixed), pa.array(groups), pa.array(np.arange(n) + 7), pa.array([1] * n)], names=list("ofgis"))
    monkeypatch.setattr(totals, "PAIRS", pairs)
    got = {r["grp"]: r for b in totals._picks(known)([batch]) for r in b.to_pylist()}
    for group, r in got.items():
        rows = [i for i in range(n) if groups[i] == group]
        told = {c: (x["rep_id"], x["fit"]) for x in r["reps"] for c in x["company_ids"]}
        assert len(r["reps"]) <= min(firms, 2 * len(rows) + 1) and r["group_count"] == len(rows)
        for c in range(firms):
            fits = ["f" if any(code[x, c] == 2 for x in own[i]) else "p" if own[i] and not fixed[i] and all(code[x, c] == 1 for x in own[i]) and any(known.strong[x] for x in own[i]) else "u" for i in rows]
            first = next(k for k in "fpu" if k in fits)
            assert told.pop(3 * c) == (rows[fits.index(first)] + 7, "fpu".index(first))
        assert not told
    assert len(got) == 91


@pytest.mark.parametrize(("numbers", "grid", "rows"), [(1 << 24, 1 << 20, 1 << 16), (4000, 10, 40), (1 << 24, 10, 1 << 16)])
def test_companies_of_equal_classes_are_summed_once(monkeypatch, numbers, grid, rows):
    """F2, F3, F4, F5 of round 4: sums over signatures are worked out for combinations of classes, not for companies."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    for name, value in (("NUMBERS", numbers), ("GRID", grid), ("ROWS", rows)):
        monkeypatch.setattr(totals, name, value)
    rng, firms = np.random.default_rng(3), 300
    sizes, classes = [3, 4, 5], [2, 3, 4]
    kind, column, strong = np.repeat(np.arange(3), sizes), np.concatenate([np.arange(x) for x in sizes]), np.arange(12) % 3 != 0
    code = [rng.choice([1, 2, 3], (c, n), p=[0.6, 0.2, 0.2]) for c, n in zip(classes, sizes, strict=True)]
    of = [rng.integers(0, c, firms).astype(np.int32) for c in classes]
    known = totals.Firms(np.arange(firms) * 2, of, [c == 1 for c in code], [c == 2 for c in code], kind, column, strong)
    own = [sorted(Counter(rng.choice(12, rng.integers(0, 6)).tolist()).items()) for _ in range(150)]
    own.sort(key=lambda x: sorted({int(kind[n]) for n, _ in x}))
    fixed, weight, value = rng.integers(0, 2, 150), rng.integers(1, 4, 150), rng.integers(-50, 50, 150)
    lists = pa.array([[{"n": n, "k": k} for n, k in x] for x in own], pa.list_(pa.struct([("n", pa.int32()), ("k", pa.int64())])))
    shape = [sum(1 << i for i in {int(kind[n]) for n, _ in x}) for x in own]
    schema = pa.schema([("company_id", pa.int64()), ("grade", pa.string()), ("fit", pa.string()), ("n", pa.int64()), ("score", pa.int64())])
    batch = pa.RecordBatch.from_arrays([lists, pa.array(fixed), pa.array(weight), pa.array(shape)], names=list("ofws"))
    sides, real = [], totals._Sums._side

    def side(self, kinds):
        found = real(self, kinds)
        sides.append((len(found[0][0]) if kinds else 1, np.prod([classes[i] for i in kinds])))
        return found

    monkeypatch.setattr(totals._Sums, "_side", side)
    got = {tuple(r.values())[:3]: (r["n"], r["score"]) for b in totals._cells(known, schema, 0)([batch.slice(0, 70), batch.slice(70)]) for r in b.to_pylist()}
    assert sides and all(n <= most < firms for n, most in sides)
    want, most = {}, {}
    for c in range(firms):
        for x, f, w, v in zip(own, fixed.tolist(), weight.tolist(), value.tolist(), strict=True):
            told = [(int(code[kind[n]][of[kind[n]][c], column[n]]), k) for n, k in x]
            p, bad, u = (sum(k for t, k in told if t == y) for y in (1, 2, 3))
            u += f
            grade = "impossible" if bad else "possible" if p + u and not u else "uncertain"
            fit = "excluded" if bad else "fit" if not u and p and any(strong[n] for n, _ in x) else "unverified"
            n, s = want.get((2 * c, grade, fit), (0, 0))
            want[2 * c, grade, fit] = (n + w, s + w * (50 + 15 * p - 40 * bad if p + bad + u else 40))
            if not bad:
                most[2 * c] = max(v, most.get(2 * c, v))
    assert got == want
    order = np.argsort(-value, kind="stable")
    batch = pa.RecordBatch.from_arrays([lists.take(pa.array(order)), pa.array(fixed[order]), pa.array(value[order])], names=list("ofv"))
    schema = pa.schema([("company_id", pa.int64()), ("largest", pa.int64())])
    assert {r["company_id"]: r["largest"] for b in totals._largest(totals.NOT_EXCLUDED)(known, schema, 0)([batch.slice(0, 5), batch.slice(5)]) for r in b.to_pylist()} == most


@pytest.mark.parametrize("size", [1, 3, 100])
def test_announcements_meet_their_conditions_as_numbers(size):
    """F3 of round 4: also where ids repeat, are null or aren't announced, and where a batch ends within an id."""
    import numpy as np
    import pyarrow as pa

    rows = [(None, 1, False), (None, None, True), (1, 2, False), (1, None, False), (1, 2, False), (1, None, True), (2, 0, False), (3, None, True), (4, 1, False), (4, None, True), (4, 0, False), (4, None, True)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([f"x{i}" for i in range(len(rows))])], names=["id", "n", "__announced", "by"])
    own = pa.list_(pa.struct([("n", pa.int32()), ("k", pa.int64())]))
    schema = pa.schema([("own", own), ("fixed", pa.int64()), ("shape", pa.int64()), ("by", pa.string())])
    found = totals._signed(np.array([0, 2, 5]), schema)([batch.slice(x, size) for x in range(0, len(rows), size)])
    got = [([tuple(x.values()) for x in r["own"]], r["fixed"], r["shape"], r["by"]) for b in found for r in b.to_pylist()]
    assert got == [([], 0, 0, "x1"), ([(2, 2)], 1, 32, "x5"), ([], 0, 0, "x7"), ([(0, 1), (1, 1)], 0, 5, "x9"), ([(0, 1), (1, 1)], 0, 5, "x11")]


def test_places_of_equal_titles_are_read_once(spark, monkeypatch):
    """F5 of round 4: a title's places are read once, and each pair of places is decided once for all companies."""
    from eligo.sources import bridge, held

    met, real, decided = [], held.held, []

    def count(df):
        (met if "bound" in df.columns else []).append(df.count())
        return real(df)

    def decisions(df):
        decided.append(df.count())
        return real(df)

    monkeypatch.setattr(held, "held", count)
    monkeypatch.setattr(queries, "held", decisions)
    queries.diagnose_summary(spark, SF)
    rows = bridge.announcements(spark, SF)
    titles = rows.select("sido", "title").distinct().count()
    assert met == [titles] and titles < rows.count() and decided[0] <= 17 * 2 * 10
