"""Toxicity: a linear-chain conditional random field over words with two states (clean, offending).

Only documents are labelled, so words are labelled first: a word is offending where one of its features (the word, its
first letters) is found in toxic documents far more often than in clean ones. The field is fitted to those labels on a
bounded sample of labelled documents; forward-backward marginals give spans and document scores over whole texts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eligo.llm.common import id_and_text, slices, table
from eligo.llm.simhash import fingerprint

DIMENSIONS = 1 << 17
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_"
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
RESULT = pa.schema([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
FIELD_SQL = "weights binary, kind string, bias double, t01 double, t10 double, t11 double"
RESULT_SQL = "score double, spans array<struct<start:int,end:int>>"


class Field(NamedTuple):
    """Weights of hashed features for the offending state, its bias, and odds of moves between states (clean to clean is 1)."""

    weights: np.ndarray
    bias: float
    t01: float
    t10: float
    t11: float


def names(word: str) -> list[bytes]:
    core = (word.strip(_STRIP) or word).lower()
    return [b"w " + core.encode("utf-8", "replace"), *(b"p " + core[:k].encode("utf-8", "replace") for k in (4, 5, 6) if len(core) >= k)]


def features(word: str) -> list[int]:
    return [zlib.crc32(n) % DIMENSIONS for n in names(word)]


def emissions(words: list[str], field: Field) -> np.ndarray:
    found = [features(w) for w in words]
    size = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((f for fs in found for f in fs), np.int64, int(size.sum()))
    return field.bias + (np.add.reduceat(field.weights[flat], np.cumsum(size) - size) if len(found) else np.zeros(0))


def odds(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds (with the word's own evidence) and backward odds of the offending state for all sequences at once.
    x holds exp(emission) of all words, sequence after sequence."""
    forward, backward = np.empty_like(x), np.ones_like(x)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1 if len(lengths) else 1), "right")  # sequences of over t words
    r = np.zeros(len(starts))
    for t, k in enumerate(live.tolist()):
        at = starts[:k] + t
        r = x[at] * field.t01 if t == 0 else x[at] * (field.t01 + field.t11 * r[:k]) / (1 + field.t10 * r[:k])
        forward[at] = r
    b = np.zeros(0)
    for t in range(len(live) - 1, 0, -1):
        k = live[t]
        b = np.concatenate([b, np.ones(k - len(b))])
        at = starts[:k] + t
        backward[at] = b
        y = x[at] * b
        b = (field.t10 + field.t11 * y) / (1 + field.t01 * y)
    if len(live):
        b = np.concatenate([b, np.ones(live[0] - len(b))])
        backward[starts[: live[0]]] = b
    return forward, backward


def label_words(texts: list[list[str]], toxic: np.ndarray, least: int = 3, log_odds: float = 3.8) -> list[np.ndarray]:
    """1 for the offending words of toxic documents, by document frequencies of features."""
    bad, good = Counter(), Counter()
    for words, t in zip(texts, toxic, strict=True):
        if t:
            bad.update({n for w in set(words) for n in names(w)})
    often = {n: c for n, c in bad.items() if c >= least}
    del bad
    for words, t in zip(texts, toxic, strict=True):  # of clean texts only what may tell is counted
        if not t:
            good.update({n for w in set(words) for n in names(w) if n in often})
    n_bad, n_good = int(toxic.sum()), int(len(toxic) - toxic.sum())
    gap = np.log(n_good + 1) - np.log(n_bad + 1)
    telling = {n for n, c in often.items() if np.log((c + 0.5) / (good[n] + 0.5)) + gap >= log_odds}
    memo: dict[str, int] = {}
    for words, t in zip(texts, toxic, strict=True):
        if t:
            for w in words:
                if w not in memo:
                    memo[w] = int(any(n in telling for n in names(w)))
    return [np.array([memo.get(w, 0) if t else 0 for w in words], np.int8) for words, t in zip(texts, toxic, strict=True)]


def windows(labels: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """[start, end) of successive pieces that cover every word. None begins right after an offending word, as each piece is
    learnt as if it came after a clean one."""
    start = 0
    while start < len(labels):
        end = min(start + window, len(labels))
        while end < len(labels) and labels[end - 1]:
            end += 1
        yield start, end
        start = end


def fit(texts: list[str], toxic: list[int], window: int = 120, rounds: int = 60, rate: float = 0.5, penalty: float = 1e-6) -> Field:
    """Maximum likelihood by Adagrad over whole texts, cut into windows. Only toxic texts without a word that is labelled
    offending teach nothing: which of their words offend is unknown."""
    pool: dict[str, str] = {}  # one string for each distinct word
    words = [[pool.setdefault(w, w) for w in _WORD.findall(t or "")] for t in texts]
    labels = label_words(words, np.array(toxic, bool))
    used = [(w, y) for w, y, t in zip(words, labels, toxic, strict=True) if y.any() or not t]
    field = Field(np.zeros(DIMENSIONS), -4.0, 1.0, 1.0, 1.0)
    lengths = np.array([b - a for _, y in used for a, b in windows(y, window)], np.int64)
    if not len(lengths):
        return field
    starts = np.cumsum(lengths) - lengths
    y = np.concatenate([y for _, y in used]).astype(float)
    numbers: dict[str, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for ws, _ in used for w in ws), np.int64, len(y))
    held, size = array("q"), np.empty(len(numbers), np.int64)  # no list of a word's features outlives it
    for i, w in enumerate(numbers):
        held.extend(own := features(w))
        size[i] = len(own)
    flat = np.frombuffer(held, np.int64) if held else np.zeros(0, np.int64)
    first, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    inner = np.ones(len(y), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pairs = [float((a * b).sum()) for a, b in ((1 - y[at - 1], y[at]), (y[at - 1], 1 - y[at]), (y[at - 1], y[at]))]
    pairs[0] += float(y[starts].sum())  # a sequence begins as if after a clean word
    w, extra = np.zeros(DIMENSIONS), np.array([-4.0, 0.0, 0.0, 0.0])
    sum_w, sum_extra = np.full(DIMENSIONS, 1e-8), np.full(4, 1e-8)
    scale = max(1.0, y.sum())
    for _ in range(rounds):
        field = Field(w, float(extra[0]), *map(float, np.exp(extra[1:])))
        x = np.exp(np.clip(np.add.reduceat(w[flat], first) + field.bias, -30, 30))[codes]
        f, b = odds(x, starts, lengths, field)
        p = f * b / (1 + f * b)
        q01, q10, q11 = field.t01 * x[at] * b[at], f[at - 1] * field.t10, f[at - 1] * field.t11 * x[at] * b[at]
        total = 1 + q01 + q10 + q11
        expected = [float((q01 / total).sum() + p[starts].sum()), float((q10 / total).sum()), float((q11 / total).sum())]
        slope = np.bincount(flat, np.bincount(codes, y - p, len(size))[owner], DIMENSIONS) / scale - penalty * w
        slope_extra = np.array([(y - p).sum(), *(o - e for o, e in zip(pairs, expected, strict=True))]) / scale
        sum_w += slope**2
        sum_extra += slope_extra**2
        w = w + rate * slope / np.sqrt(sum_w)
        extra = np.clip(extra + rate * slope_extra / np.sqrt(sum_extra), -8, 8)
    return Field(w.astype(np.float32), float(extra[0]), *map(float, np.exp(extra[1:])))


def without_copies(rows: list, distance: int = 12) -> list:
    """Of the sampled rows, the first of each near copy, so that a copied document's words don't look telling."""
    prints, kept = np.array([fingerprint(r.text, 2) for r in rows], np.uint64), []
    for i in range(len(rows)):
        if not len(kept) or np.bitwise_count(prints[kept] ^ prints[i]).min() > distance:
            kept.append(i)
    return [rows[i] for i in kept]


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1_000, clean_docs: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on labelled documents whose crc32(id) mod 4 is not 2: those with the smallest hashes of their ids, `toxic_docs`
    toxic and `clean_docs` clean ones at most, each with its whole text. An id with several labels is toxic where one says
    so; null labels are none; of several texts of an id the one of the smallest hash teaches."""
    held_in = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).where("toxic is not null")
    one = held_in.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = {}
    for toxic, most in ((1, toxic_docs), (0, clean_docs)):
        chosen |= {r.doc_id: toxic for r in one.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()}
    own = id_and_text(docs, id_col, text_col).where(F.col("doc_id").isin([*chosen]))
    rows = own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text"))
    found = rows.select("doc_id", "text").coalesce(1).mapInArrow(_fit_sample(chosen), FIELD_SQL).first()
    if found is None:
        return fit([], [])
    return Field(np.frombuffer(found.weights, np.float64).astype(found.kind), found.bias, found.t01, found.t10, found.t11)


def _fit_sample(chosen: dict[int, int]):
    """The bounded sample is fitted in one task: no text comes to the driver, only the weights do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [Row(doc_id=i, text=t) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        rows = without_copies(sorted(rows, key=lambda r: r.doc_id))
        field = fit([r.text for r in rows], [chosen[r.doc_id] for r in rows])
        kind = str(field.weights.dtype)
        yield pa.RecordBatch.from_pylist([{"weights": field.weights.astype(np.float64).tobytes(), "kind": kind, "bias": field.bias, "t01": field.t01, "t10": field.t10, "t11": field.t11}])

    return run


def scores_of(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each text's largest marginal (0 without words); p holds the texts' marginals one after another, ends where they end."""
    top, filled = np.zeros(len(ends) - 1), np.diff(ends) > 0
    if filled.any():
        top[filled] = np.maximum.reduceat(p, ends[:-1][filled])
    return top


def _score(field: Field, span_at: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", limit=8_000_000):
            texts = batch.column(0)
            lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")).cast(pa.large_string()))
            numbered = lists.flatten().dictionary_encode()
            e = emissions(numbered.dictionary.to_pylist(), field)
            x = np.exp(np.clip(e, -30, 30))[numbered.indices.to_numpy()]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            f, b = odds(x, ends[:-1], np.diff(ends), field)
            p = f * b / (1 + f * b)
            wordless = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))), 0).to_numpy(zero_copy_only=False)
            spans: list[list] = [[] for _ in range(len(texts))]
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(p >= span_at), "right") - 1).tolist():
                own = p[ends[i] : ends[i + 1]] >= span_at
                words = [m.span() for m in _WORD.finditer(texts[i].as_py())]
                spans[i] = [{"start": s, "end": t} for (s, t), o in zip(words, own, strict=False) if o]
            found = table(RESULT, [np.where(wordless, 0.0, scores_of(p, ends)), spans])
            yield pa.RecordBatch.from_arrays([*found.columns, *batch.columns[1:]], names=[*RESULT.names, *batch.schema.names[1:]])

    return run


def toxicity(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", span_at: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, spans) for each row of docs, null and repeated ids included, and its columns `keep` as a struct `row`.

    The score is the largest forward-backward marginal of the offending state over all words of the text, 0 without words.
    Spans are code points [start, end) of the words with a marginal of `span_at` or more."""
    picked = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("long").alias("doc_id"), *([F.struct(*keep).alias("row")] if keep else []))
    schema = StructType([*StructType.fromDDL(RESULT_SQL).fields, *picked.schema.fields[1:]])
    found = picked.mapInArrow(_score(field, span_at), schema)
    return found.select("doc_id", "score", "spans", *found.columns[3:])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
