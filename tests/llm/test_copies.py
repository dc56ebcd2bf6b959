"""Line dedup, SimHash and fingerprints against brute force."""

import hashlib
import random
import unicodedata

import duckdb
import numpy as np
import pytest
import xxhash

from eligo.llm import fingerprint, line_dedup, queries, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, h1 string, part int, component_id long, fp string"
LINE = "A line that is long enough to count, as it is said"
TEXTS = [None, "", " \n\t", LINE, "  " + LINE.upper() + "\t\nown words", LINE + "\n" + LINE + "\nshort", "x " * 30_000, LINE + "\nänderung " + "é" * 20, "é" * 20, "É" * 20 + "\n" + "é" * 20, "one", "one", "one two three four"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, texts=TEXTS, more=()):
    rows = [*enumerate(texts), *more]
    return spark.createDataFrame([(i, t, "clash", 1, 2, "clash") for i, t in rows], SCHEMA)


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


def test_line_dedup(spark):
    more = [(None, LINE), (5, LINE + "\nanother text of one id"), (3, LINE)]
    rows = [*enumerate(TEXTS), *more]
    held = {}
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None and t is not None else ():
            held.setdefault(key(x), set()).add(i)
    gone = lambda i, x: i is not None and len(k := key(x)) >= 20 and len(held[k]) >= 3 and i != max(held[k])
    want = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]
    found = line_dedup.with_bitmaps(frame(spark, more=more))
    assert found.columns == [*SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(", "), "keep_bitmap"]
    got = [(r.doc_id, r.text if r.text is None or r.keep_bitmap is None else "\n".join(line_dedup.kept_lines(r.text, r.keep_bitmap)[0])) for r in found.collect()]
    assert plain(got) == plain(want)
    assert line_dedup.with_bitmaps(frame(spark, [])).count() == 0


def test_line_dedup_streams_a_hot_line_over_batches(spark):
    """Batches of two rows: a hash goes on over many of them, and is decided as by all rows at once."""
    rng = random.Random(8)
    pool = [f"{LINE} number {i % 7}" for i in range(7)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    held = {}
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            held.setdefault(x.lower(), set()).add(i)
    want = {i: [len(held[x.lower()]) < 3 or i == max(held[x.lower()]) for x in t.split("\n")] for i, t in enumerate(texts)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = line_dedup.with_bitmaps(frame(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.doc_id: [b == "1" for b in line_dedup.keep_bits(r.keep_bitmap, len(r.text.split("\n")))] for r in rows} == want


def roots(fps, distance=3):
    """Smallest index reachable, by comparing all pairs."""
    fps, label = np.array(fps, np.uint64), np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def bits(text, k):
    words = (text or "").translate(LOWER).split()
    if not words:
        return 0
    n = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts = [*TEXTS, *base, *(t.replace("w7", "W8", 1) for t in base), *(t + " tail" for t in base)]
    fps = [bits(t, 3) for t in texts]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(frame(spark, texts), words_per_shingle=3).collect()}
    assert got == {i: x for i, x in enumerate(zip(fps, roots(fps), strict=True))}
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_simhash_of_null_and_repeated_ids(spark):
    """Rows go by their texts; a group in which no row has an id is a group none the less."""
    docs = frame(spark, ["one two three four five", "other words that are quite far away"], more=[(0, "one two three four five"), (0, "other words that are quite far away"), (None, "one two three four five"), (None, "nobody named this one"), (None, "nobody named this one")])
    rows = [(r.doc_id, r.component_id, r.root) for r in simhash.near_groups(docs, words_per_shingle=3).collect()]
    assert len(rows) == 7 and len({r[2] for r in rows}) == 3
    assert sorted((str(i), str(c)) for i, c, _ in rows) == sorted([("0", "0"), ("1", "0"), ("0", "0"), ("0", "0"), ("None", "0"), ("None", "None"), ("None", "None")])


def test_simhash_links_of_large_buckets(spark):
    """Over BUCKET rows share a segment, chains run through them, and nothing is lost."""
    rng = random.Random(5)
    fps = []
    for _ in range(120):
        fps.append(0xABCD1234 << 32 | rng.getrandbits(32))
        for _ in range(4):
            fps.append(fps[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps = [*dict.fromkeys(fps)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    place = {f: i for i, f in enumerate(signed)}
    for levels in (0, 2):  # by pairs of blocks alone, and by the values of the other bits first
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), levels=levels)
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in edges.collect())
        got = {place[r.node]: r.component for r in simhash.components(edges).collect()}
        same = {}
        for i, root in enumerate(roots(fps)):
            same.setdefault(root, set()).add(got.get(i, signed[i]))
        assert all(len(x) == 1 for x in same.values()) and len({*map(min, same.values())}) == len(same)


def test_simhash_links_of_several_tables(spark):
    """Tables that are matched at once don't mix: the same fingerprints in two of them link in both, others in neither."""
    rng = random.Random(6)
    fps = []
    for _ in range(90):
        fps.append(0x1234ABCD << 32 | rng.getrandbits(32))
        for _ in range(3):
            fps.append(fps[-1] ^ 1 << rng.randrange(64))
    fps = [*dict.fromkeys(fps)]
    held = {0: fps, 1: fps[::3], 2: [fps[0] ^ 1 << 50, *fps[1::2]], 3: [0]}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    for levels in (0, 2):
        found = simhash.links(spark.createDataFrame([(t, signed(f)) for t, own in held.items() for f in own], "table int, fp long"), levels=levels).collect()
        for t, own in held.items():
            place, first = {signed(f): i for i, f in enumerate(own)}, [*range(len(own))]
            for r in found:
                if r.table == t:
                    a, b = first[place[r.a]], first[place[r.b]]
                    assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
                    first = [min(a, b) if x in (a, b) else x for x in first]
            want = [*roots(own)]
            assert len({*zip(first, want, strict=True)}) == len({*first}) == len({*want})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999), (999, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 999: 999, 1000: 999}


def folded(text):
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text or "").casefold()).split()).encode()


def test_fingerprints(spark):
    texts = [*TEXTS, "Straße  ONE", "STRASSE one", "été", "été", "tail"]
    rows = [(i, t or "") for i, t in enumerate(texts)]
    want = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        prints = [xxhash.xxh3_128_hexdigest(folded(x)) for x in (t, edited)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, float(folded(t) == folded(edited)), float(folded(t) == folded(after))))
    assert plain(fingerprint.against_next(frame(spark, texts)).collect()) == plain(want)
    assert fingerprint.against_next(frame(spark, [])).count() == 0
    assert plain(fingerprint.against_next(frame(spark, ["alone"])).select("near_edited", "near_next").collect()) == [("0.0", "1.0")]


def test_exact_groups(spark):
    got = {r.group_id: r.n_docs for r in fingerprint.exact_groups(frame(spark, ["Straße  ONE", "STRASSE one ", "b", None, "", " "])).collect()}
    assert got == {0: 2, 2: 1, 3: 3}


def test_fingerprints_name_the_class_of_every_row(spark):
    """Copies far apart meet; repeated and null ids are rows of their own."""
    texts = ["Straße  ONE", "b", None, "c", "STRASSE one ", "", "été", " ", "e\u0301te\u0301"]
    rows = [*enumerate(texts), (3, "c"), (None, "b"), (None, "own"), (None, "null ids"), (None, "NULL ids")]
    docs = frame(spark, texts, more=rows[len(texts) :])
    held = {}
    for i, t in rows:
        held.setdefault(folded(t), []).append(i)
    want = [(i, len(t or ""), min((x for x in held[folded(t)] if x is not None), default=None), len(held[folded(t)])) for i, t in rows]
    assert plain(fingerprint.fingerprints(docs).select("doc_id", "n_chars", "group_id", "n_docs").collect()) == plain(want)
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_op9_has_the_classes_of_the_whole_table(spark):
    texts = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        texts.setdefault(folded(r.text), []).append(r.doc_id)
    got = {r.doc_id: (r.group_id, r.n_docs) for r in queries.QUERIES["op9_document_fingerprints"](spark, SF).collect()}
    assert got == {i: (min(ids), len(ids)) for ids in texts.values() for i in ids} and any(len(ids) > 1 for ids in texts.values())
