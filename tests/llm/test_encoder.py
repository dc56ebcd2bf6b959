"""The encoder's runs against the tokenizers library, and what is done once where it was done often."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from eligo.llm import token_files, tokens

SIGNS = [*"abXY'’\"<|>$%#,.!(09 \t\n\x0b\x1c\x00\x7f\x85\xa0éÉßİΣςK²½٣🙂。你한ᄒ̸́‍﻿…”", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "n't", "''", "  ", "Word"]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, []

    def encode(self, word, **more):
        self.words.append(word)
        return self.tokenizer.encode(word, **more)


def test_odd_texts_are_encoded_as_by_the_library():
    rng = random.Random(3)
    known, encoder = Tokenizer.from_file(tokens.vocabulary()), tokens.WordEncoder(tokens.vocabulary())
    for _ in range(200):
        texts = [None, "", *("".join(rng.choices(SIGNS, k=rng.randint(0, 30))) for _ in range(6))]
        column = pa.array(["before", *texts], pa.string())[1:]
        ids, ends = encoder.encode_column(column)
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:], strict=False)] == [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode_column(pa.array([], pa.string()))] == [[], [0]]


def test_words_between_marks_do_not_go_to_the_library():
    encoder = tokens.WordEncoder(tokens.vocabulary())
    counted = encoder.tokenizer = Counted(encoder.tokenizer)
    text = "alpha### beta,%%% (gamma) 12.5 Été$$$ don't <|endoftext|> e-mail"
    assert encoder.encode(text).tolist() == counted.tokenizer.encode(text, add_special_tokens=False).ids
    assert counted.words == ["don't", "<|endoftext|>"]


def test_the_memory_of_runs_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 50)
    encoder = tokens.WordEncoder(tokens.vocabulary())
    text = " ".join(f"{'abcdefghij'[i % 10] * (i // 10 + 1)}'s {'klmnopqrst'[i % 10] * (i // 10 + 1)}" for i in range(200))
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.runs) <= 50 and len(encoder.older) <= 50


def test_digests_are_made_where_ids_are_read(spark, tmp_path):
    texts = [None, "", "alpha### don't", "beta beta"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = token_files.op6_token_id_output(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 1  # two would be two workers for a task
    known, want, start = Tokenizer.from_file(tokens.vocabulary()), [], 0
    for i, t in enumerate(texts):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, token_files.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, df.collect())) == want
