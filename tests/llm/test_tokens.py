"""Token files, packing and pieces against the tokenizer library and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from eligo.llm import packing, pieces, token_files, tokens

SCHEMA = "doc_id long, text string, part int, rank string, length string, ids int"
TEXTS = [None, "", "  ", "Hello, World!! don't 12.5 été ÉTÉ İstanbul", "x" * 500, "naïve Zürich. <|endoftext|> a b\x1cc 你好。", "word " * 9000, "word " * 4095, "word " * 4096, "Hi", "Hi"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, "clash", "clash", 5) for i, t in enumerate(texts)], SCHEMA)


def ids_of(texts):
    known = Tokenizer.from_file(tokens.vocabulary())
    return [[*known.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_token_files(spark):
    at = token_files.shared_folder(spark, "test-token-files")
    token_files.write_token_files(frame(spark), at)
    want, start = {}, 0
    for i, ids in enumerate(ids_of(TEXTS)):
        want[i] = (start, np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_token_files(spark, at).collect()} == want
    assert {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_token_files(spark, at, [3, 9]).collect()} == {i: want[i] for i in (3, 9)}
    assert token_files.read_token_files(spark, at, []).count() == 0


def test_token_files_with_a_dictionary(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(200)) for _ in range(300)]
    dictionary = token_files.train_dictionary(frame(spark, texts).select("doc_id", "text"), tokens.vocabulary(), size=2_000)
    frames = token_files.Frames(dictionary)
    own = np.array(ids_of(texts[:1])[0], np.uint32)
    assert dictionary and frames.ids(frames.frame(own)).tolist() == own.tolist()
    assert len(frames.frame(own)) < len(token_files.Frames(b"").frame(own))


def test_empty_table(spark):
    at = token_files.shared_folder(spark, "test-token-files")
    token_files.write_token_files(frame(spark, []), at)
    assert token_files.read_token_files(spark, at).count() == 0
    assert packing.pack(frame(spark, [])).count() == 0
    assert pieces.encode(frame(spark, [])).count() == 0


def test_pack(spark):
    rows = packing.pack(frame(spark)).collect()
    want = sorted((i, k, 4096 * k, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for i, ids in enumerate(ids_of(TEXTS)) for k, at in enumerate(range(0, len(ids), 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 120))]
        used, seen = defaultdict(list), Counter()
        for s in packing.plan(Counter(lengths), 40):
            for k in range(s.bins * s.each):
                used[s.sequence + k // s.each].append((s.offset + k % s.each * s.length, s.length))
                seen[s.length] += 1
        assert seen == Counter(lengths)
        for held in used.values():
            ends = [0, *np.cumsum([n for _, n in sorted(held)])]
            assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 40
        assert len(used) == best_fit(lengths, 40)


def test_n_best_is_exact():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 6)
        edges = [[], *([(i, -rng.random(), (i, j)) for i in range(j) if rng.random() < 0.8 or i == j - 1] for j in range(1, n + 1))]

        def paths(j, edges=edges):
            return [(0.0, [])] if j == 0 else [(s + t, [*p, label]) for i, t, label in edges[j] for s, p in paths(i)]

        want = sorted(paths(n), key=lambda x: -x[0])[:4]
        got = pieces.n_best(edges, 4)
        assert [p for _, p in got] == [p for _, p in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_pieces(spark):
    texts = [*TEXTS, " lead", "two  spaces", "tail ", "🙂 byte", "ab" * 10_000]
    encoded = pieces.encode(frame(spark, texts))
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    model = pieces.Pieces.of(pieces.vocabulary())
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert (rows[i].scores == [0.0] and rows[i].ids == []) if not t else sorted(rows[i].scores, reverse=True) == rows[i].scores
        if t and len(t) < 60:  # against the lattice of the whole text at once
            whole = pieces.n_best(model.lattice("▁" + t.replace(" ", "▁")), 3)
            assert np.allclose(rows[i].scores, [s for s, _ in whole])
        score_of = {k: s for s, (k,) in model.scores.values()} | dict.fromkeys(model.bytes.values(), pieces.BYTE_SCORE)
        own = [pieces.changed(rows[i].ids, [(c.at, c.n, c.ids) for c in a]) for a in rows[i].alternatives]
        assert [sum(score_of[x] for x in ids) for ids in own] == rows[i].scores and len({*map(tuple, own)}) == len(own)
        assert {model.decode(ids) for ids in own} == {t or ""}


def test_edges_of_long_atoms_are_the_same():
    model = pieces.Pieces.of(pieces.vocabulary())
    for text in ("▁" + "aab" * 900, "▁🙂" * 3):
        forward, into = model.edges(text)
        late = pieces.Lattice(model, text)
        assert [sorted(late[j]) for j in range(len(late))] == [sorted(x) for x in into]
        assert pieces.n_best(into, 3, forward) == pieces.n_best(late, 3, forward)


def test_digests_of_every_segmentation(spark):
    texts = ["", None, "Hi there", "two  spaces", "naive words", "a b", " lead"]
    rows = {r.doc_id: r for r in pieces.digests(frame(spark, texts)).collect()}
    model = pieces.Pieces.of(pieces.vocabulary())
    for i, t in enumerate(texts):
        assert len(rows[i].best) == rows[i].n_best and {b.decoded_crc32 for b in rows[i].best} == {zlib.crc32((t or "").encode())}
        if t:
            whole = pieces.n_best(model.lattice("▁" + t.replace(" ", "▁")), 3)
            assert np.allclose([b.score for b in rows[i].best], [s for s, _ in whole])
            for b in rows[i].best:
                same = [zlib.crc32(np.array([x for label in p for x in label], "<u4").tobytes()) for s, p in pieces.n_best(model.lattice("▁" + t.replace(" ", "▁")), 12) if np.isclose(s, b.score)]
                assert b.ids_crc32 in same
