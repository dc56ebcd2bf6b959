"""The Jaccard join against all pairs of plain sets."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from eligo.llm import jaccard, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    n = min(k, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, percent=85):
    """(id, size, smallest id reachable, links) of each row, rows of one id being rows of their own."""
    sets = [shingles(t) for _, t in rows]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    links = []
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in at[x]:
                common[j] = common.get(j, 0) + 1
        links.append([j for j, c in common.items() if j != i and 100 * c >= percent * (len(s) + len(sets[j]) - c)])
    root = [*range(len(rows))]
    while True:
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    smallest = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return [(i, len(s), smallest.get(r), len(x)) for (i, _), s, r, x in zip(rows, sets, root, links, strict=True)]


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, b"x") for i, t in rows], "doc_id long, text string, n int, a string, component_id int, bits binary")


def near_texts(n, seed=7):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        own = [word() for _ in range(rng.choice((5, 30, 60, 120, 400)))]
        at = rng.randrange(len(own))
        texts.append(own[:at] + passage + own[at:] if rng.random() < 0.6 else own)
        for _ in range(rng.choice((0, 0, 1, 3))):  # chains of edits
            t = [*texts[-1]]
            for _ in range(rng.randint(0, max(1, len(t) // 90))):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
    return [" ".join(t) for t in texts]


def rows_of():
    odd = [None, "", " \n\t", "one", "ONE", "one two", "one two three four", "One\ttwo\nthree  four", "é two three four", "É two three four", "x " * 30_000, "a b c d e f g h " * 3_000, "a b c d e f g h " * 2_999]
    rows = [*enumerate([*near_texts(120), *odd])]
    return [*rows, (3, rows[9][1]), (3, "own text of a repeated id"), (None, rows[9][1]), (None, "nobody named this text"), (None, "nobody named this text"), (None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_join(spark, small, monkeypatch):
    """small: every tile is cut into blocks, large ones are walked link by link, every table is joined by a shuffle."""
    if small:
        for name, value in (("BLOCK_ROWS", 3), ("BLOCK_SHINGLES", 200), ("SMALL", 1), ("PAIRS", 2), ("BROADCAST_ROWS", 0), ("HOT_ROWS", 0), ("HOT_MEAN", 0)):
            monkeypatch.setattr(jaccard, name, value)
    rows = rows_of()
    want = brute(rows)
    assert sum(w[3] > 0 for w in want) > 60
    got = jaccard.jaccard_groups(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert plain(got.collect()) == plain(want)


def test_empty_tables(spark):
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0
    assert plain(jaccard.jaccard_groups(frame(spark, [(5, None), (4, "")])).collect()) == plain([(5, 0, 5, 0), (4, 0, 4, 0)])


def test_large_group_over_batches(spark):
    """Groups go on over many batches of a few rows."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(90):
        t = [*base]
        for _ in range(2):
            t[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = [*enumerate(texts)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = jaccard.jaccard_groups(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert plain(got) == plain(brute(rows))


def test_op11_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(queries.QUERIES["op11_ngram_jaccard_join"](spark, SF).collect()) == plain(brute(rows))


@given(st.sets(st.integers(0, 3000), min_size=1), st.sets(st.integers(0, 3000), min_size=1), st.integers(0, 2600), st.integers(60, 95))
def test_bitmaps_never_reject_a_link(x, y, more, percent):
    """Sets of any size, so that maps of one size and of two meet."""
    x, y = x | {*range(more)}, y | {*range(more)}
    word = jaccard.mix(np.arange(3001).astype(np.uint64))
    sets = [np.sort(word[[*s]]) for s in (x, y)]
    n, maps = np.array([len(x), len(y)]), jaccard.Maps([jaccard.bitmap(s) for s in sets])
    common = jaccard.intersections(sets[0], np.concatenate(sets), np.r_[0, np.cumsum(n)], np.array([1]))
    assert common.tolist() == [len(x & y)]
    assert abs(maps.level[0] - maps.level[1]) > 1 or maps.most(n, np.array([0]), np.array([1]))[0] >= len(x & y)
    if 100 * len(x & y) >= percent * len(x | y):
        assert jaccard.allowed(n, maps, np.array([0]), np.array([1]), percent).all()
