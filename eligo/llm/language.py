"""Language ID by Bayesian evidence fusion: text likelihoods, the declared markup language, the address suffix and host
priors that are smoothed host -> site -> all, all of which are counts from grouped aggregations over the whole table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eligo.llm.common import cut, slices, table

#: Byte trigrams of lower-cased words are counted in so many buckets.
BUCKETS = 1 << 14
#: A text says no more than this many trigrams would: neighbours depend on each other.
MOST_EVIDENCE = 60.0
#: Rows of a hot key are dealt out over so many parts; a key is hot that has over one row in HOT.
SALT, HOT = 16, 200
#: Tables of priors and hints up to so many bytes are broadcast.
BROADCAST_BYTES = 32_000_000
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
READ_SQL = "host string, site string, suffix string, declared string, n_letters long, text_logs array<double>, text_lang string"
READ = pa.schema([("host", pa.string()), ("site", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("n_letters", pa.int64()), ("text_logs", pa.list_(pa.float64())), ("text_lang", pa.string())])
_DROPPED = re.compile(r"(?i)<(?:(script|style|nav|template)\b|!--)")
_ENDS = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style", "nav", "template")} | {"": re.compile("-->")}
_TAG = re.compile(r"(?s)<[^>]*>")
_HTML, _LANG = re.compile(r"(?i)<html\b"), re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class Likelihoods(NamedTuple):
    langs: list[str]
    logs: np.ndarray  # languages x BUCKETS


def page_text(html: str | None) -> str:
    """What stands outside tags, closed comments and closed scripts, styles, menus and templates. Each kind of end is looked for
    in vain once at most, so that broken markup takes no longer than its length."""
    html, kept, at, endless = html or "", [], 0, set()
    start = _DROPPED.search(html)
    while start:
        kind = (start[1] or "").lower()
        end = None if kind in endless else _ENDS[kind].search(html, start.end())
        if end:
            kept += [html[at : start.start()], " "]
            at = end.end()
        else:
            endless.add(kind)
        start = _DROPPED.search(html, max(at, start.end()))
    rest = "".join(kept) + html[at:]
    closed = rest.rfind(">") + 1
    return unescape(_TAG.sub(" ", rest[:closed]) + rest[closed:])


def declared_language(html: str | None) -> str | None:
    """The primary language of the first <html lang=...>."""
    html, at = html or "", 0
    while start := _HTML.search(html, at):
        at = html.find(">", start.end())
        at = len(html) if at < 0 else at
        if found := _LANG.search(html, start.end(), at):
            return found[1]
    return None


def _words(texts: pa.Array):
    """Texts' words as numbers, and for each distinct word its trigram buckets (two spaces between words)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))).cast(pa.large_string()))
    numbered = lists.flatten().dictionary_encode()
    words = numbered.dictionary.to_pylist()
    raw = np.frombuffer(("  " + "  ".join(words) + "  ").encode(), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words)) + 2
    grams = ((raw[:-2] * 65_599 + raw[1:-1] * 257 + raw[2:]) * 2_654_435_761 >> 13) % BUCKETS
    starts = np.cumsum(sizes) - sizes
    return lists, numbered.indices.to_numpy(), grams[: int(sizes.sum())], starts, words


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, limit=4_000_000):
        langs = batch.column(0).to_pylist()
        lists, codes, grams, starts, words = _words(batch.column(1))
        owner = np.repeat(np.array([*range(len(langs))]), np.diff(lists.offsets.to_numpy()))
        sizes = np.diff(np.r_[starts, len(grams)])
        for lang in {x for x in langs if x is not None}:
            own = np.array([x == lang for x in langs])[owner]
            weight = np.bincount(codes[own], minlength=len(words)).astype(float)
            totals[lang] = totals.get(lang, 0) + np.bincount(grams, np.repeat(weight, sizes), BUCKETS)
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield table(COUNTS, [[lang] * len(at), at.astype(np.int32), n[at].astype(np.int64)])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 1_000) -> Likelihoods:
    """Likelihoods from all texts with a language: counts by language and bucket.

    A model of over `most` languages isn't built: it raises ValueError, as a column of that many values is no language and
    none of them may be dropped unseen. Texts or languages that are null say nothing; an empty table knows no language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"over {most} languages in {lang_col}")
    place, n = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), BUCKETS))
    for r in counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toLocalIterator():  # BUCKETS numbers at most
        at = np.array(r.counts, np.int64)
        n[place[r.lang], at[:, 0]] = at[:, 1]
    return Likelihoods(langs, np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32) if langs else n)


def _parts(host: str | None) -> tuple[str, str, str]:
    host = (host or "").lower().rstrip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def _primary(declared: str | None) -> str:
    """The language of a tag: "de" of de-DE or de_AT."""
    return re.split("[-_]", (declared or "").strip().lower())[0]


def _read(known: Likelihoods, is_html: bool):
    """Address or host, declared, text or markup, columns to keep -> evidence, and the columns that are kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", limit=3_000_000):
            texts, declared = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            hosts = [m[1] if (m := _HOST.match(a or "")) else (a or "") for a in batch.column(0).to_pylist()]
            if is_html:
                declared = [declared_language(t) for t in texts]
                texts = [page_text(t) for t in texts]
            lists, codes, grams, starts, words = _words(pa.array(texts, pa.string()))
            word_logs = np.add.reduceat(known.logs[:, grams].astype(np.float64), starts, axis=1) if len(words) else np.zeros((len(known.langs), 0))
            letters = np.array([sum(map(str.isalpha, w)) for w in words], np.int64)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            add = lambda x, codes=codes, ends=ends: (c := np.r_[0, np.cumsum(x[codes])])[ends[1:]] - c[ends[:-1]]
            n_grams = add(np.diff(np.r_[starts, len(grams)]).astype(np.int64))
            logs = np.stack([add(row) for row in word_logs]) if len(known.langs) else np.zeros((0, len(texts)))
            logs = logs * np.minimum(1.0, MOST_EVIDENCE / np.maximum(n_grams, 1))
            logs = logs - logs.max(0, initial=-np.inf) if len(known.langs) else logs
            n_letters = add(letters)
            best = [known.langs[i] if n else None for i, n in zip(logs.argmax(0).tolist(), n_letters.tolist(), strict=True)] if len(known.langs) else [None] * len(texts)
            parts = [_parts(h) for h in hosts]
            found = table(READ, [*map(list, zip(*parts, strict=True)), [_primary(d) for d in declared], n_letters, logs.T.tolist(), best])
            yield pa.RecordBatch.from_arrays([*found.columns, *batch.columns[3:]], names=[*READ.names, *batch.schema.names[3:]])

    return run


def _votes(seen: DataFrame, key: list[str], langs: list[str]) -> DataFrame:
    """Key, the counts of the texts' languages under it in the order of langs, and their sum `votes`. Counts come together by
    key and language first, so that a hot key meets as one row for each language."""
    n = seen.where("text_lang is not null").groupBy(*key, "text_lang").agg(F.count("*").cast("double").alias("n"))
    held = n.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "n"))).alias("m"), F.sum("n").alias("votes"))
    return held.select(*key, F.transform(F.array(*[F.lit(x) for x in langs]), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0))).alias("counts"), "votes")


def _smooth(counts: Column, parent: Column, weight: float) -> Column:
    """Shares of the counts, drawn towards the parent's by `weight` counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda n, p: (n + weight * p) / (total + weight))


def _attach(rows: DataFrame, small: DataFrame, key: list[str], n_langs: int) -> DataFrame:
    """Left join by key with a table of votes: broadcast where it is known to be small, else rows of hot keys are dealt out."""
    small = cut(small)
    if small.count() * (16 * n_langs + 200) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), key, "left")
    votes = small.agg(F.sum("votes")).first()[0]
    hot = small.where(F.col("votes") * HOT > votes).select(*key, F.lit(SALT).alias("parts"))  # at most HOT keys
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = small.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [*key, "salt"], "left").drop("salt")


def identify(
    rows: DataFrame, known: Likelihoods, id_col: str, address_col: str, text_col: str, declared_col: str | None = None, host_weight: float = 20.0, hint_weight: float = 20.0, least: float = 0.5, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, lang, posterior, text_lang, declared, host, n_letters, kept) for each row, and its columns `keep` as a struct `row`.

    With declared_col the text is plain, without it the text is HTML and declares its language itself; of a tag like
    de-DE the part before the first - or _ counts. Posterior: text likelihood x host prior x P(declared | language) x
    P(suffix | language). A host's prior are its texts' languages, smoothed towards its site's by `host_weight` counts,
    and those towards all texts'. A hint says share(language | hint) / share(language), where the first is smoothed
    towards the second by `hint_weight` counts, so that a hint which was hardly seen says nothing. A row's own text is left
    out of all three. A row without a letter, or whose best language stays below `least`, is rejected (kept false); lang is
    "und" where nothing is known at all. Null texts, addresses and declarations are empty, null and repeated ids are rows
    like any other, and of equal posteriors the first language in alphabetic order is taken.
    """
    picked = rows.select(
        F.col(address_col).cast("string").alias("__address"),
        (F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")).alias("__declared"),
        F.col(text_col).cast("string").alias("__text"),
        F.col(id_col).cast("long").alias("id"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )
    carried = picked.select(*picked.columns[3:])
    seen = picked.mapInArrow(_read(known, declared_col is None), StructType([*StructType.fromDDL(READ_SQL).fields, *carried.schema.fields]))
    out = ["text_lang", "declared", "host", "n_letters", *carried.columns[1:]]
    if not known.langs:
        return seen.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), *out, F.lit(False).alias("kept"))
    seen, langs = cut(seen), known.langs
    votes = {r.text_lang: r.n for r in seen.groupBy("text_lang").agg(F.count("*").alias("n")).collect()}
    counts = [float(votes.get(x, 0)) for x in langs]
    everyone = F.array(*[F.lit((c + 1.0) / (sum(counts) + len(langs))) for c in counts])
    own = F.transform(F.array(*[F.lit(x) for x in langs]), lambda x: F.when(x == F.col("text_lang"), 1.0).otherwise(0.0))
    others = lambda name: F.zip_with(F.coalesce(name, F.array(*[F.lit(0.0)] * len(langs))), "own", lambda c, o: F.greatest(c - o, F.lit(0.0)))
    joined = seen.withColumn("own", own)
    for key in ("site", "host", "declared", "suffix"):
        by = ["site", "host"] if key == "host" else [key]
        joined = _attach(joined, _votes(seen, by, langs), by, len(langs)).withColumn("n_" + key, others("counts")).drop("counts", "votes")
    prior = _smooth(F.col("n_host"), _smooth(F.col("n_site"), everyone, host_weight), host_weight)
    logs = F.zip_with("text_logs", prior, lambda a, p: a + F.log(p))
    for key in ("declared", "suffix"):
        says = F.zip_with(_smooth(F.col("n_" + key), everyone, hint_weight), everyone, lambda p, q: F.log(p / q))
        logs = F.when(F.col(key) != "", F.zip_with(logs, says, lambda a, b: a + b)).otherwise(logs)
    top = joined.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    chance = 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("logs", F.col("best")).cast("int"))
    kept = (F.col("n_letters") > 0) & (F.col("posterior") >= least)
    return top.select("id", lang.alias("lang"), chance.alias("posterior"), *out).withColumn("kept", kept)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by text, markup, suffix and host; likelihoods come from all documents."""
    known = learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), known, "page_id", "url", "html")
    return found.select(F.col("id").alias("page_id"), "lang", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "host", "kept")
