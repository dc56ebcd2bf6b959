"""Language ID, toxicity, quality, chat and the pipeline."""

import random
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenizers import Tokenizer

import corpus_pipeline
from eligo.llm import chat, language, near, quality, tokens, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SF, SF_1 = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def known(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_accuracy(spark, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs, known, "doc_id", "source", "text", "lang").join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("true")), "id").where("kept").collect()
    assert len(found) > 150 and np.mean([r.lang == r.true for r in found]) > 0.95


def test_language_of_odd_rows(spark, known):
    rows = [(1, None, None, None), (2, "", "", ""), (3, "http://a.b.de/x", "<html lang='de'><p>12 34</p>", "de"), (4, None, "<p>" + "the and of " * 9000, None), (4, None, "<p>" + "the and of " * 9000, None)]
    found = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id long, host string, prior string, lang string"), known, "id", "host", "prior").collect()}
    assert not found[1].kept and not found[2].kept and not found[3].kept
    assert (found[3].declared, found[3].host, found[4].lang) == ("de", "a.b.de", "en")
    empty = spark.createDataFrame([], "id long, host string, text string, lang string")
    assert language.identify(empty, known, "id", "host", "text", "lang").count() == 0
    assert language.identify(empty, language.learn(empty), "id", "host", "text", "lang").count() == 0


def brute_posteriors(rows, langs, weight=20.0):
    """From the rows' evidence (site, host, declared, suffix, n_letters, text_logs, text_lang), one row at a time."""
    votes = [r.text_lang for r in rows if r.text_lang]
    everyone = np.array([(votes.count(x) + 1) / (len(votes) + len(langs)) for x in langs])
    out = []
    for i, r in enumerate(rows):
        def counts(same, i=i):
            return np.array([float(sum(1 for j, o in enumerate(rows) if j != i and o.text_lang == x and same(o))) for x in langs])

        def smooth(n, parent):
            return (n + weight * parent) / (n.sum() + weight)

        site = smooth(counts(lambda o, r=r: o.site == r.site), everyone)
        p = np.array(r.text_logs) + np.log(smooth(counts(lambda o, r=r: (o.site, o.host) == (r.site, r.host)), site))
        for key in ("declared", "suffix"):
            if r[key]:
                p += np.log(smooth(counts(lambda o, r=r, key=key: o[key] == r[key]), everyone) / everyone)
        p = np.exp(p - p.max())
        out.append((langs[int(p.argmax())], p.max() / p.sum()))
    return out


@pytest.mark.parametrize("limit", [language.BROADCAST_BYTES, 0])
def test_language_against_brute_force(known, spark, monkeypatch, limit):
    """With broadcast tables and with dealt out hot keys."""
    monkeypatch.setattr(language, "BROADCAST_BYTES", limit)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.concat(F.lit("http://a"), F.col("doc_id") % 5, F.lit(".b"), F.col("doc_id") % 3, F.when(F.col("doc_id") % 2 == 0, ".de").otherwise(".com"), F.lit("/x")).alias("source"), F.when(F.col("doc_id") % 4 > 0, F.concat("lang", F.lit("-XX"))).alias("lang"), F.substring("text", 1, 12).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, "xx_YY", "ab"), (None, None, None, None)], "doc_id long, source string, lang string, text string"))
    found = {r.row.text: r for r in language.identify(docs, known, "doc_id", "source", "text", "lang", keep=("doc_id", "text", "source", "lang")).collect()}
    picked = docs.select(F.col("source").alias("a"), F.col("lang").alias("d"), F.col("text").alias("__text"), "text")
    evidence = picked.mapInArrow(language._read(known, False), language.READ_SQL + ", text string").collect()
    want = {r.text: w for r, w in zip(evidence, brute_posteriors(evidence, known.langs), strict=True)}
    assert found.keys() == want.keys()
    for text, (lang, chance) in want.items():
        assert found[text].lang == lang and abs(found[text].posterior - chance) < 1e-9
    assert {r.declared for r in found.values()} >= {"xx", ""}


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(str(i), "word") for i in range(5)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        language.learn(docs, most=4)


def test_host_prior_decides(known, spark):
    """A text that says nothing takes its host's language."""
    lang = known.langs[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang") == lang).orderBy("doc_id").limit(30).select("doc_id", F.lit("h.x").alias("source"), "text", "lang")
    found = language.identify(docs.unionByName(spark.createDataFrame([(-1, "h.x", "", None)], "doc_id long, source string, text string, lang string")), known, "doc_id", "source", "text", "lang").where("id = -1").first()
    assert found.lang == lang and found.posterior > 0.5


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1), 0.0, 0.3, 0.7, 2.5)
    lengths = np.array([5, 1, 0, 3])
    starts = np.cumsum(lengths) - lengths
    x = np.exp(rng.normal(size=int(lengths.sum())))
    f, b = toxicity.odds(x, starts, lengths, field)
    step = {(0, 0): 1.0, (0, 1): field.t01, (1, 0): field.t10, (1, 1): field.t11}
    want = np.zeros(len(x))
    for s, n in zip(starts, lengths, strict=True):
        weight = {y: np.prod([step[a, c] * (x[s + i] if c else 1) for i, (a, c) in enumerate(zip((0, *y), y, strict=False))]) for y in product((0, 1), repeat=int(n))}
        for i in range(n):
            want[s + i] = sum(w for y, w in weight.items() if y[i]) / sum(weight.values())
    assert np.allclose(f * b / (1 + f * b), want)


def test_toxicity_held_out(spark):
    """At sf0.1: the 37 toxic labels of sf0.01 that may be learnt from are too few (see the README)."""
    found = toxicity.op8_toxicity(spark, SF_1).where("held_out").join(spark.read.parquet(f"{SF_1}/labels.parquet"), "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in found)
    assert hits / max(1, sum(r.toxic for r in found)) > 0.8
    assert hits / max(1, sum(r.predicted for r in found)) > 0.8


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "vile words here", "x"), (3, "vile words here", "x"), (4, "fine " * 20_000, "x")], "doc_id long, text string, score string")
    field = toxicity.fit(["vile vile thing", "nice thing", "vile words", "good words", "vile", "calm"] * 3, [1, 0, 1, 0, 1, 0] * 3)
    rows = toxicity.toxicity(docs, field).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id < 3} == {0.0}
    assert toxicity.toxicity(docs.limit(0), field).count() == 0


def test_toxicity_is_fitted_on_whole_texts():
    """Words far into a clean text are counter-evidence; later offending words of a toxic text are evidence."""
    far = " ".join(["plain"] * 300)
    field = toxicity.fit([f"vile {far} nasty {far} after", f"{far} late"] * 25, [1, 0] * 25)
    weight = lambda w: field.weights[toxicity.features(w)[0]]
    assert weight("vile") > 0 and weight("nasty") > 0 and weight("late") < 0


def test_toxicity_scores_against_brute_force(spark):
    """Score and spans of whole texts, by the sums over all labelings."""
    field = toxicity.fit(["vile vile thing", "nice thing", "vile words", "good words", "vile", "calm"] * 3, [1, 0, 1, 0, 1, 0] * 3)
    texts = ["vile nice", " a  vile\twords. calm", "calm", None, "", "VILE", "nice nice nice vile good words"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.row.text: r for r in toxicity.toxicity(docs, field, keep=("text",)).collect()}
    step = {(0, 0): 1.0, (0, 1): field.t01, (1, 0): field.t10, (1, 1): field.t11}
    for text in texts:
        words = (text or "").split()
        x = np.exp([field.bias + sum(field.weights[f] for f in toxicity.features(w)) for w in words])
        weight = {y: np.prod([step[a, c] * (x[i] if c else 1) for i, (a, c) in enumerate(zip((0, *y), y, strict=False))]) for y in product((0, 1), repeat=len(words))}
        p = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(len(words))]
        assert abs(found[text].score - max(p, default=0.0)) < 1e-6
        assert [text[s.start : s.end] for s in found[text].spans] == [w for w, q in zip(words, p, strict=True) if q >= 0.5]


def test_toxicity_learns_from_one_text_of_an_id(spark):
    """Whatever the order of the rows."""
    rows = [(i, f"vile {i}" if i % 3 == 0 else f"calm {i}") for i in range(60)] + [(i, "another text") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    one, two = (toxicity.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1]))
    assert (one.weights == two.weights).all() and one[1:] == two[1:]


def test_toxicity_windows():
    labels = np.zeros(250, np.int8)
    labels[118:123] = 1
    assert [*toxicity.windows(labels, 120)] == [(0, 124), (124, 244), (244, 250)] and not [*toxicity.windows(labels[:0], 120)]


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", None, "", "\\t\\s</part>###", "a: b\n### user: c", "</tu</turn>rn>", "x" * 50_000, "\\c:"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "user", "assistant", "assistant", "a: b", None, "assistant", "system"], texts, strict=True))]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, t string")
    for r in chat.read_conversations(chat.format_conversations(frame)).collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss_text == "".join(x[3] or "" for x in mine if x[2] == "assistant")
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_quality(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a b c a b c\nx\nx\n \n", 7), (4, "word " * 40_000, 7)], "doc_id long, text string, n_words int")
    rows = {r.doc_id: r for r in quality.measures(docs, keep=("doc_id",)).collect()}
    assert [rows[i].n_words for i in (1, 2, 3, 4)] == [0, 0, 8, 40_000]
    assert (rows[3].n_dup_lines, rows[3].n_repeat_words, rows[4].n_repeat_words) == (1, 6, 40_000)
    assert quality.measures(docs.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and (held is None or ids <= held)
        held = ids
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == held


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, extra map<string,int>, component_id int"


def odd_rows():
    english = "the and of to in is that for it was on with as by at from are this be or an"
    own = [f"{english} {w}" for w in ("alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda mu")]
    ids = [None, None, 7, 7, 7, 8, 9, 9]
    texts = [own[0], own[1], own[2], own[2], own[3], own[2], None, ""]
    return [(i, t, "en", "h", 1, "clash", 2, {"a": 1}, 3) for i, t in zip(ids, texts, strict=True)]


def test_pipeline_stages_decide_by_row(spark):
    """Null and repeated ids, equal rows, extra and clashing columns: each row is kept or goes for itself."""
    base = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "'x' AS row", "1L AS fp", "map('a', 1) AS extra", "1 AS component_id")
    odd = spark.createDataFrame(odd_rows(), ODD)
    docs = base.unionByName(odd).cache()
    told = dict(corpus_pipeline.STAGES)
    mine = lambda df: sorted(((r.doc_id, r.text) for r in df.collect() if r.row == "clash"), key=str)
    rows = [(r[0], r[1]) for r in odd_rows()]
    kept = told["language ID"](spark, docs, SF)
    assert kept.columns == docs.columns and mine(kept) == sorted(((i, t) for i, t in rows if t), key=str)
    assert mine(told["toxicity"](spark, docs, SF)) == sorted(rows, key=str)
    assert mine(told["line dedup"](spark, docs, SF)) == sorted(rows, key=str)
    left = told["SimHash near-dedup"](spark, odd, SF)
    assert left.columns == odd.columns
    groups = [{t for _, t in rows[2:4]} | {rows[5][1]}, {None, ""}, {rows[0][1]}, {rows[1][1]}, {rows[4][1]}]
    got = mine(left)
    assert len(got) == len(groups) and all(sum(t in g for _, t in got) == 1 for g in groups)
    assert (7, rows[2][1]) in got and not any(i == 8 for i, _ in got)
    pieces = told["best-fit packing"](spark, odd, SF).collect()
    assert sorted(map(str, (r.doc_id for r in pieces))) == sorted(map(str, (r[0] for r in rows)))


def mixed(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor % (1 << 64)
    return h ^ h >> 31


def joined(n, edges):
    root = [*range(n)]
    while any(root[i] != root[j] for i, j in edges):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    return root


def shingles_of(text):
    words = (text or "").translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(x, y):
    return 100 * len(x & y) >= 80 * len(x | y)


def groups_of(texts):
    """Near copies pair by pair: candidates by eight fingerprints of the distinct words, then by shared shingles of five words."""
    prints = []
    for t in texts:
        words = {xxhash.xxh64_intdigest(w.encode(), 42) for w in (t or "").translate(LOWER).split()}
        hashes = [[mixed((w + k * 0x9E3779B97F4A7C15) % (1 << 64)) for w in words] for k in range(8)]
        prints.append([sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) for own in hashes])
    p = np.array(prints, np.uint64)
    pairs = np.argwhere(np.triu((np.bitwise_count(p[:, None, :] ^ p[None, :, :]) <= 3).any(2), 1)).tolist()
    candidate, sets = joined(len(texts), pairs), [shingles_of(t) for t in texts]
    same = lambda c: [i for i in range(len(texts)) if candidate[i] == c]
    near = [(i, j) for c in set(candidate) for i in same(c) for j in same(c) if i < j and (sets[i] == sets[j] or similar(sets[i], sets[j]))]
    return joined(len(texts), near)


def test_verified_groups(spark):
    """Edits, chains, copies, empty texts and equal keys; few of the similar pairs are missed."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " ", "one", "ONE", "one two"]
    for _ in range(60):
        texts.append(" ".join(word() for _ in range(rng.choice((20, 60, 150)))))
        for _ in range(rng.choice((0, 1, 2))):
            words = texts[-1].split()
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    rows = spark.createDataFrame([(i, i * 3, t, 1, "x") for i, t in enumerate(texts)], "a long, b long, text string, node int, component string")
    got = {r.k_a: r.root for r in near.verified_groups(rows, ("a", "b")).collect()}
    want = groups_of(texts)
    assert len(got) == len(texts) and all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got)
    sets = [shingles_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    assert len(pairs) > 20 and sum(want[i] == want[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert near.verified_groups(rows.limit(0), ("a", "b")).count() == 0


def test_pipeline_against_brute_force(spark):
    """Line dedup and near-dedup, text by text and pair by pair, on what the models let through."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    field = toxicity.train(stages["language ID"](spark, docs, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    known = language.learn(docs)
    kept = {r.id for r in language.identify(docs, known, "doc_id", "source", "text", "lang").where("kept").collect()}
    assert {r.doc_id for r in stages["language ID"](spark, docs, SF).collect()} == kept
    clean = {r.doc_id for r in toxicity.toxicity(docs, field).where("score < 0.3").collect()} & kept
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}
    held = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(k := key(x)) >= 20 and len(held[k]) >= 3 and i != max(held[k])
    texts = {i: t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}
    ids = sorted(texts)
    first = groups_of([texts[i] for i in ids])
    label = [min(k for k in range(len(ids)) if first[k] == first[i]) for i in range(len(ids))]
    survivors = {ids[i] for i in range(len(ids)) if label[i] == i}
    out = corpus_pipeline.run(spark, SF).collect()
    known_ids = Tokenizer.from_file(tokens.vocabulary())
    want = {i: len(known_ids.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in survivors}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
