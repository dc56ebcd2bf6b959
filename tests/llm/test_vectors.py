"""Clustering and codes of vectors against brute force on integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from eligo.llm import centroids, codes, common

SCHEMA = "cluster string, vec_id long, embedding array<double>, label string, code int, error string"


def frame(spark, rows):
    return spark.createDataFrame([("clash", i, v, label, 1, "clash") for i, v, label in rows], SCHEMA)


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def far(x, m):
    return sum((a - b) ** 2 for a, b in zip(x, m, strict=True))


def floors(factor, v):
    return [math.floor(factor * x) for x in v]


def means(kept, at, old):
    groups = [[x for x, c in zip(kept, at, strict=True) if c == k] for k in range(len(old))]
    return [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else m for g, m in zip(groups, old, strict=True)]


def rows_of(width, n=60, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-6, 6, width) / 7 + (i % 3)).tolist(), "abc"[i % 3] if i % 5 else None) for i in range(n)]
    rows += [(3, rows[3][1], "a"), (3, rows[4][1], "a"), (None, rows[5][1], None), (None, [0.0] * width, "z")]  # repeated and null ids, equal vectors
    rows += [(100, None, "a"), (101, [], "a"), (102, [1.0] * (width - 1) + [None], "a"), (103, [1.0] * (width - 1) + [math.nan], "a"), (104, [1.0] * (width - 1) + [-math.inf], "a"), (105, [1.0] * (width - 1), "b")]
    return rows


def test_clusters(spark):
    rows = rows_of(6)
    kept = [(i, v) for i, v, _ in rows if v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    for k, rounds in ((7, 3), (500, 1)):
        x = [floors(256, v) for _, v in kept]
        order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"2:{kept[r][0]}".encode()).hexdigest() if kept[r][0] is not None else "", kept[r][1]))
        m = [x[r] for r in order[:k]]
        for _ in range(rounds):
            m = means(x, [min(range(len(m)), key=lambda c: (far(v, m[c]), c)) for v in x], m)
        at = [min(range(len(m)), key=lambda c: (far(v, m[c]), c)) for v in x]
        d = [far(v, m[c]) for v, c in zip(x, at, strict=True)]
        sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in m]
        want = [(i, c, e, sum(f for f, b in zip(d, at, strict=True) if b == c), sum(d), sha[c]) for (i, _), c, e in zip(kept, at, d, strict=True)]
        assert plain(centroids.cluster(frame(spark, rows), k, rounds, dimensions=6).collect()) == plain(want)
    assert centroids.cluster(frame(spark, []), 7, 2).count() == 0
    assert centroids.cluster(frame(spark, rows), 7, 2).count() == 0  # none has 64 components
    with pytest.raises(ValueError):
        centroids.cluster(frame(spark, [(1, [1e9] * 4, "a")]), 2, 1, dimensions=4)


@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=25), st.integers(1, 9), st.randoms())
def test_sort_means_is_exact_from_any_assignment(x, k, rng):
    m = np.array([rng.choice(x) if rng.random() < 0.5 else [rng.randint(-9, 9) for _ in range(3)] for _ in range(k)], np.int64)
    before = np.array([rng.randrange(k) for _ in x])
    c, d = centroids.nearest(np.array(x, np.int64), m, before)
    want = [min((far(v, q), i) for i, q in enumerate(m.tolist())) for v in x]
    assert [*zip(d.tolist(), c.tolist(), strict=True)] == want


@given(st.integers(0, 26), st.randoms())
def test_screening_is_exact_at_any_size(bits, rng):
    """Ties and near ties that float32 can't tell apart."""
    base = [rng.randint(-(1 << bits), 1 << bits) for _ in range(8)]
    near = lambda: [b + rng.choice((-1, 0, 0, 1)) for b in base]
    x, m = [near() for _ in range(12)], [near() for _ in range(16)]
    i, d = codes.nearest(np.array(x, np.int64), np.array(m, np.int64))
    assert [*zip(d.tolist(), i.tolist(), strict=True)] == [min((far(v, q), k) for k, q in enumerate(m)) for v in x]


@pytest.mark.parametrize("entries", [5, 200])
def test_codes(spark, entries, monkeypatch):
    rows = rows_of(6)
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = sorted((r for r in kept if len(r[1]) == 6), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[floors(4096, v[2 * j : 2 * j + 2]) for _, v, _ in whole] for j in range(3)]
    books = [p[:entries] for p in parts]
    near = lambda v, m: min((far(v, c), i) for i, c in enumerate(m))
    for _ in range(2):
        books = [means(p, [near(v, m)[1] for v in p], m) for p, m in zip(parts, books, strict=True)]
    found = [[near(v, m) for v in p] for p, m in zip(parts, books, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for m in books for c in m for x in c).encode()).hexdigest()
    coded = [(i, label, bytes(f[r][1] for f in found).hex(), sum(f[r][0] for f in found)) for r, (i, _, label) in enumerate(whole)]
    coded += [(i, label, None, None) for i, v, label in kept if len(v) != 6]
    want = [(i, code, error, sum(e or 0 for _, other, _, e in coded if other == label), sha) for i, label, code, error in coded]
    run = lambda: codes.compress(frame(spark, rows), parts=3, entries=entries, rounds=2).collect()
    assert plain(run()) == plain(want)
    for name, value in (("LOOKUP_ROWS", 0), ("HOT", 4)):  # labels met by a join, hot ones dealt out
        monkeypatch.setattr(common, name, value)
    assert plain(run()) == plain(want)


def test_codes_of_an_empty_table(spark):
    assert codes.compress(frame(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in codes.compress(frame(spark, [(1, [0.5] * 3, "a")])).collect()] == [(1, None, None, None)]
