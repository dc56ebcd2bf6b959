"""SentencePiece encoding and decoding: N-best segmentations over the lattice of a model's pieces and their scores.

Forward Viterbi scores are exact heuristics for a backward A* search, so complete paths leave the queue best first. A text
is cut into atoms where no piece can reach across. A worker searches each distinct atom once; the n best of a whole text
come from the same search over the alternatives of the few atoms that can matter for them.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from eligo.llm.common import collected, id_and_text, slices, table

SPACE = "▁"
PIECE_MODEL = "piece_bpe_32k.model"
#: A byte that no piece covers costs this much, below any path of pieces.
BYTE_SCORE = -100_000.0
#: Atoms that a worker remembers before the older half goes, and the longest that it remembers at all.
MEMORY = 500_000
CLOSE_MEMORY = 20_000
LONGEST_REMEMBERED = 100
#: Letters of an atom up to which all its edges are kept.
LONGEST_KEPT = 2_000
RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("alternatives", pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))]))))])
RESULT_SQL = "doc_id long, ids array<int>, scores array<double>, alternatives array<array<struct<at:int,n:int,ids:array<int>>>>"
INF = float("inf")


def n_best(edges: Sequence[list[tuple[int, float, object]]], n: int, forward: list[float] | None = None) -> list[tuple[float, list]]:
    """The n best paths from node 0 to the last node. edges[j]: (from node i < j, score, label) of the edges into node j.

    Forward: the best score to reach each node. Backward: A* from the last node, whose priority (score of the suffix +
    forward score of its first node) is exact, so paths complete in order. Each open suffix ends in a path of exactly its
    priority; so the queue keeps no more of them, best first, than there are paths to find. Among equals the one nearest
    to the start goes on first.
    """
    last = len(edges) - 1
    if forward is None:
        forward = [0.0] + [-INF] * last
        for j in range(1, last + 1):
            forward[j] = max((forward[i] + s for i, s, _ in edges[j]), default=-INF)
    queue, out, tie = [(-forward[last], last, 0, 0.0, None)], [], 0
    while queue and len(out) < n:
        _, j, _, suffix, path = queue.pop(0)
        if j == 0:
            labels = []
            while path is not None:
                labels.append(path[0])
                path = path[1]
            out.append((suffix, labels))
            continue
        room = n - len(out)
        for i, s, label in edges[j]:
            tie += 1
            s += suffix
            key = -(s + forward[i])
            if len(queue) >= room:
                worst = queue[-1]
                if key > worst[0] or (key == worst[0] and i >= worst[1]):
                    continue
                queue.pop()
            insort(queue, (key, i, tie, s, (label, path)))
    return out


class Lattice(Sequence):
    """Edges into each node of a very long atom. They are looked up as the search asks for them, so that only its forward
    scores and the nodes that were visited are held."""

    def __init__(self, pieces: Pieces, text: str):
        self.pieces, self.text, self.known = pieces, text, {0: []}

    def __len__(self) -> int:
        return len(self.text) + 1

    def __getitem__(self, j: int) -> list[tuple[int, float, tuple[int, ...]]]:
        if j not in self.known:
            first = max(0, j - self.pieces.longest)
            self.known[j] = self.pieces.edges(self.text[first:j], first)[1][-1]
        return self.known[j]


class Pieces:
    _held: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {self.names[i]: (max(model.get_score(i), -1e6), (i,)) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        of_byte = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.scores))
        inside = {(a, b) for p in self.scores for a, b in zip(p, p[1:], strict=False)}
        letter = {c for c in "".join(self.scores) if c.isalpha()}
        if any(b == SPACE and a != SPACE for a, b in inside):
            raise ValueError("a piece reaches over the start of a word")
        # Atoms end where no piece reaches across; between letters and others too, where the vocabulary allows it.
        mixed = any((a in letter) != (b in letter) and a != SPACE for a, b in inside)
        self.atom = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if mixed else rf"{SPACE}*[^\W\d_]+|{SPACE}*(?:(?![^\W\d_])[^{SPACE}])+|{SPACE}+")
        self.raw = [bytes([of_byte[i]]) if i in of_byte else name.replace(SPACE, " ").encode() for i, name in enumerate(self.names)]
        #: Letters of the pieces as a tree: (next letters, what the piece that ends here adds).
        self.tree: dict = {}
        for piece, hit in self.scores.items():
            children = self.tree
            for c in piece[:-1]:
                children = children.setdefault(c, ({}, None))[0]
            children[piece[-1]] = (children[piece[-1]][0] if piece[-1] in children else {}, hit)
        #: Atom: ids and score of its best path, and what the second loses (inf: there is none). Newer and older half.
        self.memo: dict[str, tuple[tuple[int, ...], float, float]] = {}
        self.older: dict[str, tuple[tuple[int, ...], float, float]] = {}
        #: Atom and n: all of its n best, for those that some text's n best depend on.
        self.close: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def as_bytes(self, char: str) -> tuple[float, tuple[int, ...]]:
        raw = char.encode()
        return BYTE_SCORE * len(raw), tuple([self.bytes[b] for b in raw])

    def edges(self, text: str, first: int = 0, keep: bool = True) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """Viterbi scores of a text's nodes and, to keep, the edges into each; nodes are numbered from `first` on. A start is
        left as soon as no piece begins with its letters."""
        n = len(text)
        best, into, tree = [0.0] + [-INF] * n, [[] for _ in range(n + 1 if keep else 0)], self.tree
        for i, letter in enumerate(text):
            here, node = best[i], tree.get(letter)
            if node is None or node[1] is None:  # a letter that is no piece
                score, ids = self.as_bytes(letter)
                if keep:
                    into[i + 1].append((i + first, score, ids))
                if here + score > best[i + 1]:
                    best[i + 1] = here + score
            j = i + 1
            while node is not None:
                children, hit = node
                if hit is not None:
                    score, ids = hit
                    if keep:
                        into[j].append((i + first, score, ids))
                    if here + score > best[j]:
                        best[j] = here + score
                if j == n:
                    break
                node = children.get(text[j])
                j += 1
        return best, into

    def lattice(self, text: str) -> Sequence[list[tuple[int, float, tuple[int, ...]]]]:
        return self.edges(text)[1]

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Scores and ids of the n best segmentations of a text that is one lattice."""
        short = len(text) <= LONGEST_KEPT
        forward, into = self.edges(text, keep=short)
        return [(s, tuple(chain.from_iterable(labels))) for s, labels in n_best(into if short else Lattice(self, text), n, forward)]

    def atom_of(self, name: str) -> tuple[tuple[int, ...], float, float]:
        """Each distinct atom is searched once by a worker, as far as its memory goes."""
        if (got := self.memo.get(name) or self.older.get(name)) is None:
            paths = self.search(name, 2)
            got = paths[0][1], paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else INF
        if len(name) <= LONGEST_REMEMBERED:
            if len(self.memo) >= MEMORY:
                self.older, self.memo = self.memo, {}
            self.memo[name] = got
        return got

    def paths_of(self, name: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        if (got := self.close.get((name, n))) is None:
            got = self.search(name, n)
            if len(name) <= LONGEST_REMEMBERED:
                if len(self.close) >= CLOSE_MEMORY:
                    self.close = {}
                self.close[name, n] = got
        return got

    def encode(self, text: str | None, n: int) -> tuple[list[int], list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Ids of the best segmentation, scores of the n best, and for each of them what it changes: (place, ids of the best
        that go there, ids that come) in order of places."""
        if not text:
            return [], [0.0], [[]]
        names = self.atom.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.memo.get, names))
        if None in found:
            for k in [k for k, atom in enumerate(found) if atom is None]:
                found[k] = self.atom_of(names[k])
        own, scores, losses = zip(*found, strict=True)
        # An alternative of any other atom comes after n segmentations that each change one of these.
        rest, near = list(losses), []
        while len(near) < n - 1 and (low := min(rest)) < INF:
            near.append(k := rest.index(low))
            rest[k] = INF
        edges: list[list] = [[]]
        place = at = 0
        for e, k in enumerate(sorted(near)):
            place, at = place + sum(map(len, own[at:k])), k
            paths = self.paths_of(names[k], n)
            edges.append([(e, s - scores[k], (place, len(own[k]), p) if r else None) for r, (s, p) in enumerate(paths)])
        paths, best = n_best(edges, n), sum(scores)
        return list(chain.from_iterable(own)), [best + s for s, _ in paths], [[x for x in labels if x is not None] for _, labels in paths]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def changed(ids: list[int], changes: Iterable[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """Ids of a segmentation, from those of the best and what it changes."""
    out, end = [], 0
    for place, n, own in changes:
        out += ids[end:place]
        out += own
        end = place + n
    return out + ids[end:]


def vocabulary(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(path: str, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in collected(slices(batches, limit=2_000_000)):
            rows = [pieces.encode(t, n) for t in batch.column(1).to_pylist()]
            others = [[[{"at": at, "n": size, "ids": list(own)} for at, size, own in c] for c in changes] for _, _, changes in rows]
            yield table(RESULT, [batch.column(0), [r[0] for r in rows], [r[1] for r in rows], others])

    return run


def encode(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, scores, alternatives) for each row of docs, null and repeated ids included: the best segmentation's ids,
    the scores of the n best, best first, and for each of these its changes to the best one: from place `at` on, `n` ids go
    and `ids` come. Equal scores: the order is the same in every run. Null and empty texts have no ids and one score, 0.
    Spaces are the model's own mark, so a text that holds the mark itself decodes to spaces; any other text decodes to itself."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_encode(path or vocabulary(), n), RESULT_SQL)


def _decode(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            yield table(schema, [batch.column(0), [pieces.decode(x) for x in batch.column(1).to_pylist()]])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from encode's ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or vocabulary()), "doc_id long, text string")


BEST = pa.struct([("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("decoded_crc32", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("best_score", pa.float64()), ("n_best", pa.int64()), ("second_loss", pa.float64()), ("decoded_crc32", pa.int64()), ("best", pa.list_(BEST))])
DIGEST_SQL = "doc_id long, n_ids long, ids_crc32 long, best_score double, n_best long, second_loss double, decoded_crc32 long, best array<struct<n_ids:long,ids_crc32:long,score:double,decoded_crc32:long>>"


def _digest(path: str, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in collected(slices(batches, limit=2_000_000)):
            best = []
            for text in batch.column(1).to_pylist():
                ids, scores, changes = pieces.encode(text, n)
                own = [changed(ids, c) for c in changes]
                best.append([{"n_ids": len(x), "ids_crc32": zlib.crc32(np.array(x, "<u4")), "score": s, "decoded_crc32": zlib.crc32(pieces.decode(x).encode())} for x, s in zip(own, scores, strict=True)])
            first = [b[0] for b in best]
            losses = [b[0]["score"] - b[1]["score"] if len(b) > 1 else None for b in best]
            yield table(DIGEST, [batch.column(0), *([b[name] for b in first] for name in ("n_ids", "ids_crc32", "score")), [len(b) for b in best], losses, [b["decoded_crc32"] for b in first], best])

    return run


def digests(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """For each row of docs, digests of the best segmentation, and in `best` of each of the n best, best first."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_digest(path or vocabulary(), n), DIGEST_SQL)


def op7_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the three best segmentations of every text, and of the text decoded from each."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
