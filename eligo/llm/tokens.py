"""Token ids of whole texts by a public tokenizer whose pre-tokens never span white space.

Ids of a word (letters without white space between) don't depend on its neighbours, and neither do those of its runs: letters,
single digits, marks. A worker keeps a bounded memory of runs. A new run goes to the BPE model of the tokenizers library;
a word with a run that the library may cut, join or change in another way goes to the library as a whole.
"""

from __future__ import annotations

import os
import struct
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

WORD_BPE = "word_bpe_49k.json"
#: A worker remembers up to twice so many runs.
MEMORY = 200_000
_WHITE, _LETTER, _DIGIT, _MARK = range(4)
#: What a byte of UTF-8 is; all bytes beyond ASCII count as letters, and whether they are is asked once for each run.
_KIND = np.full(256, _MARK, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = _WHITE
_KIND[list(b"0123456789")] = _DIGIT
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: In place of a run's ids: the word around it goes to the library.
_ODD = b"?"


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    _held: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each Python worker, kept between tasks."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chars: dict[str, str] = {}

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(self.runs) >= MEMORY:
            self.older, self.runs = self.runs, {}
        self.runs[key] = ids
        return ids

    def _whole(self, word: str) -> bytes:
        """By the library; a space sets words apart from runs in the memory."""
        key = " " + word
        got = self.runs.get(key) or self.older.get(key)
        if got is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        return self._keep(key, got) if len(word) <= 20 else got

    def _low(self, run: str) -> str | None:
        """The run as the model takes it, lower-cased character by character; None if the word around it is odd: a lone
        apostrophe may begin an ending, "<|" a special token."""
        if run.isascii():
            return run if run != "'" and "<|" not in run and run.isprintable() else None
        if not run.isalpha() or "\u0130" in run or not is_normalized("NFC", run):
            return None
        chars, level = self.chars, self.level.pre_tokenize_str
        for c in run:
            if c not in chars:
                chars[c] = level(c.lower())[0][0]
        return "".join([chars[c] for c in run])

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Of distinct runs."""
        raws = [*map(self.runs.get, runs)]
        tokenize = self.model.tokenize
        for i in [i for i, got in enumerate(raws) if got is None]:
            run = runs[i]
            got = self.older.get(run)
            if got is None:
                low = self._low(run)
                ids = [t.id for t in tokenize(low)] if low is not None else None
                got = _ODD if ids is None else struct.pack(f"<{len(ids)}I", *ids)
            raws[i] = self._keep(run, got) if len(run) <= 100 else got
        return raws

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin, with the end last. Null is empty.

        Texts are cut into runs as bytes and the runs are numbered by Arrow, so that Python sees each run once.
        """
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind = _KIND[data]
        begins = np.ones(len(data) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[bounds] = True
        at = np.flatnonzero(begins)
        shown = kind[at[:-1]] != _WHITE
        start, stop = at[:-1][shown], at[1:][shown]
        places, body = np.r_[0, np.cumsum(stop - start)], _LOWER[data[kind != _WHITE]]
        numbered = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(places), pa.py_buffer(body)]).dictionary_encode()
        codes, raws = numbered.indices.to_numpy(), self._runs(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        odd = sizes == len(_ODD)
        if odd.any():
            codes = self._odd_words(data, bounds, start, stop, codes, raws, odd)
            sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        sizes //= 4
        spread = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], np.frombuffer(b"".join(raws), "<u4")).take(pa.array(codes))
        ends = np.r_[0, np.cumsum(sizes[codes])]
        return spread.flatten().to_numpy(), ends[np.searchsorted(start, bounds)]

    def _odd_words(self, data: np.ndarray, bounds: np.ndarray, start: np.ndarray, stop: np.ndarray, codes: np.ndarray, raws: list[bytes], odd: np.ndarray) -> np.ndarray:
        """Codes where the first run of a word with an odd run stands for the whole word and its other runs for nothing. What
        they stand for is put behind raws, in which odd runs become nothing as well."""
        first = np.r_[True, start[1:] != stop[:-1]]
        begun = np.searchsorted(start, bounds[:-1])
        first[begun[begun < len(start)]] = True
        heads = np.flatnonzero(first)
        word = np.cumsum(first) - 1
        found = np.unique(word[odd[codes]])
        ends = stop[np.r_[heads[1:], len(start)] - 1]
        words = pa.array([data[i:j].tobytes().decode() for i, j in zip(start[heads[found]].tolist(), ends[found].tolist(), strict=True)], pa.string()).dictionary_encode()
        for i in np.flatnonzero(odd).tolist():
            raws[i] = b""
        codes = np.where(np.isin(word, found), np.flatnonzero(odd)[0], codes)
        codes[heads[found]] = len(raws) + words.indices.to_numpy()
        raws.extend(map(self._whole, words.dictionary.to_pylist()))
        return codes

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]
