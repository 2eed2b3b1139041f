"""SentencePiece encoding and decoding with N-best segmentation.

The N best segmentations of a text are the N paths of largest score sum
through the lattice of the model's pieces. A forward Viterbi pass gives every
place the best score of the text before it; it is the exact heuristic of a
backward A* search from the end of the text, which so yields complete
paths in order of their score.

Pieces hold the word mark only at their start (or consist of it), and none
joins letters with other characters, so the lattice falls apart at such places
(both facts are checked in the vocabulary). Each part is searched by itself,
the best path of repeated parts is looked up in a bounded memory, and the N
best of the text are the N best sums, one path from each part. Characters that no piece covers are spelled in byte pieces,
each scored below every other piece; so is a literal word mark, so decoding
gives back every text exactly.

Text preparation is the model's: a word mark for every space and one before
the text. Paths of one score come in the order in which the search finds them,
which is fixed. Defined results: null counts as empty; an empty text has one
path, without pieces; a text with fewer than N paths has fewer rows; very long
texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm.common import ship, table

MARK = "▁"
LITERAL = "\udc00"  # stands for a word mark of the text; no text holds this code point
MEMORY = 1_000_000  # words whose paths a Python worker remembers
LONGEST_WORD = 64  # characters of a remembered word
PENALTY = 10.0
UNUSED = -1e8  # pieces scored below are for white space only and lose to their parts

Path = tuple[float, tuple[int, ...]]


class PieceModel:
    """The pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.byte_ids, spelling = {}, {}, [0] * 256, [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                spelling[i] = piece.replace(MARK, " ").encode()
        self.spelling = np.array(spelling, object)
        # a node: character -> (next node, score and ids of the piece that ends there, or None)
        tree: dict = {}
        for p, i in self.ids.items():
            node = tree
            for c in p[:-1]:
                node = node.setdefault(c, [{}, None, None])[0]
            node.setdefault(p[-1], [{}, None, None])[1:] = self.scores[p], (i,)
        self.trie = _frozen(tree)
        self.byte_score = min(s for s in self.scores.values() if s > UNUSED) - PENALTY
        self.parts = re.compile(rf"{MARK}*(?:[^\W\d_¹²³]+|(?:(?!{MARK})[\W\d_¹²³])+)|{MARK}+")
        if not all(self.parts.fullmatch(p) for p in self.ids):  # some piece joins letters with others: part at word marks only
            self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        assert all(self.parts.fullmatch(p) for p in self.ids), "a piece holds a word mark after another character"
        self.forget()

    def forget(self) -> None:
        """Empty memory: numbered parts with their best ids, their best scores and the losses of their second best paths."""
        self.numbers, self.best_ids, self.figures, self.others = Numbers(self), [], np.empty((1 << 10, 3)), {}

    def lattice(self, part: str, keep: int) -> list[list[tuple[float, int, float, tuple[int, ...]]]]:
        """Forward Viterbi: for every place the ``keep`` best edges (score of the path to here, start, own score, ids)."""
        n, ids = len(part), self.ids
        edges: list[list] = [[] for _ in range(n + 1)]
        edges[0].append((0.0, 0, 0.0, ()))
        for start in range(n):
            here = edges[start]
            if not here:
                continue
            if len(here) > 1:
                here.sort(reverse=True)
                del here[keep:]
            before, node, end = here[0][0], self.trie, start
            for c in part[start:] if start else part:
                found = node.get(c)
                if found is None:
                    break
                end += 1
                node, own, piece = found
                if piece is not None:
                    edges[end].append((before + own, start, own, piece))
            if part[start] not in ids:
                spelled = tuple([self.byte_ids[b] for b in part[start].replace(LITERAL, MARK).encode()])
                own = self.byte_score * len(spelled)
                edges[start + 1].append((before + own, start, own, spelled))
        edges[n].sort(reverse=True)
        del edges[n][keep:]
        return edges

    def paths(self, part: str, n_best: int) -> list[Path]:
        """The n best segmentations of a part.

        A* from its end: a partial path has the score of its pieces plus the
        forward score of the rest. As that is exact, the best continuation of
        the best partial path has the same score and is followed to the start
        at once; its other continuations wait, the n best of them.
        """
        edges = self.lattice(part, n_best)
        waiting: list[tuple] = [(-edges[-1][0][0], 0, len(part), 0.0, None)]
        count, out = 0, []
        while waiting and len(out) < n_best:
            bound, _, place, score, tail = waiting.pop(0)
            while place:
                best, *others = edges[place]
                for total, start, own, piece in others:
                    count += 1
                    insort(waiting, (-total - score, count, start, own + score, (piece, tail)))
                    del waiting[n_best - len(out):]
                _, place, own, piece = best
                score, tail = own + score, (piece, tail)
            ids: list[int] = []
            while tail:
                ids.extend(tail[0])
                tail = tail[1]
            out.append((-bound, tuple(ids)))
        return out

    def remember(self, part: str) -> int:
        """The number of a new part."""
        edges, number = self.lattice(part, 2), len(self.best_ids)
        if number == len(self.figures):
            self.figures = np.concatenate([self.figures, np.empty_like(self.figures)])
        # the search's first path; the best of the continuations that it leaves waiting is the second path
        place, loss, best = len(part), math.inf, []
        while place:
            first, *second = edges[place]
            if second and first[0] - second[0][0] < loss:
                loss = first[0] - second[0][0]
            best.append(first[3])
            place = first[1]
        self.best_ids.append(np.array([i for piece in reversed(best) for i in piece], "<u4").tobytes())
        # best score, loss of the second best, bytes of the best ids
        self.figures[number] = edges[-1][0][0], loss, len(self.best_ids[-1])
        return number

    def other_paths(self, part: str, n_best: int) -> list[tuple[float, bytes]]:
        """(loss against the best, ids) of a part's next paths."""
        key = (part, n_best)
        if key not in self.others:
            (best, _), *rest = self.paths(part, n_best)
            rest = [(best - score, np.array(ids, "<u4").tobytes()) for score, ids in rest]
            if len(part) > LONGEST_WORD:
                return rest
            self.others[key] = rest
        return self.others[key]

    def encode(self, text: str, n_best: int) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the n best segmentations of a text."""
        if not text:
            return [(0.0, np.empty(0, "<u4"))]
        if len(self.best_ids) >= MEMORY:
            self.forget()
        parts = self.parts.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))
        numbers = list(map(self.numbers.__getitem__, parts))
        score, second, size = self.figures.take(numbers, axis=0).T
        total, best = sum(score.tolist()), b"".join(map(self.best_ids.__getitem__, numbers))
        ends = np.cumsum(size).astype(np.int64)
        # any of the n best sums leaves the best path in parts with the smallest losses only: n - 1 of them do
        losses = []
        second = second.copy()
        for _ in range(n_best - 1):
            i = int(second.argmin())
            if second[i] == math.inf:
                break
            second[i] = math.inf
            losses.extend((loss, i, ids) for loss, ids in self.other_paths(parts[i], n_best))
        out = []
        for loss, swaps in best_sums(sorted(losses), n_best):
            own = best
            for i, ids in sorted(swaps, reverse=True):  # from the end, so that earlier places stay
                own = own[:ends[i] - int(size[i])] + ids + own[ends[i]:]
            out.append((total - loss, np.frombuffer(own, "<u4")))
        self.numbers.drop_long()
        return out

    def spell(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation in UTF-8."""
        return b"".join(self.spelling[ids].tolist())[1:]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation."""
        return self.spell(ids).decode()


def _frozen(node: dict) -> dict:
    return {c: (_frozen(after), own, piece) for c, (after, own, piece) in node.items()}


class Numbers(dict):
    """Part -> its number; a new part is searched and remembered. Long parts are forgotten after their text."""

    def __init__(self, model: PieceModel):
        self.model, self.long = model, []

    def __missing__(self, part: str) -> int:
        number = self[part] = self.model.remember(part)
        if len(part) > LONGEST_WORD:
            self.long.append(part)
        return number

    def drop_long(self) -> None:
        for part in self.long:
            self.model.best_ids[self.pop(part)] = b""
        self.long.clear()


def best_sums(losses: list[tuple[float, int, bytes]], n: int) -> list[tuple[float, list[tuple[int, bytes]]]]:
    """The n smallest sums of losses (loss, part, ids), given in order, with at most one from each part."""
    out: list = [(0.0, [])]
    heap = [(losses[0][0], (0,))] if losses else []
    while heap and len(out) < n:
        loss, chosen = heapq.heappop(heap)
        if len({losses[i][1] for i in chosen}) == len(chosen):
            out.append((loss, [losses[i][1:] for i in chosen]))
        last = chosen[-1] + 1
        if last < len(losses):
            for after in ((*chosen, last), (*chosen[:-1], last)):
                heapq.heappush(heap, (sum(losses[i][0] for i in after), after))
    return out


@functools.lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model: str, n_best: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, ids): the n best segmentations of every text."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_model(model)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                found = [(i, r, score, ids) for i, t in enumerate(part.column(1)) for r, (score, ids) in enumerate(pieces.encode(t.as_py() or "", n_best), 1)]
                offsets = np.cumsum([0, *(len(f[3]) for f in found)])
                ids = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate([f[3] for f in found]).astype(np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([f[0] for f in found])), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.float64()), ids], names=["doc_id", "rank", "score", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, rank int, score double, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode_documents(encoded: DataFrame, model: str, ids_col: str = "ids", text_name: str = "text") -> DataFrame:
    """All columns of ``encoded`` and the text that the ids spell."""
    ship(encoded)

    @F.pandas_udf("string")
    def spell(ids):
        import pandas as pd

        pieces = load_model(model)
        return pd.Series([None if x is None else pieces.decode(x) for x in ids])

    return encoded.withColumn(text_name, spell(F.col(ids_col)))


def summaries(docs: DataFrame, model: str, n_best: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, n_pieces, ids_crc32, text_sha256): encoded and decoded in one task, ids and texts reduced to digests."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_model(model)
        for b in batches:
            out = []
            for i, t in enumerate(b.column(1)):
                for r, (score, ids) in enumerate(pieces.encode(t.as_py() or "", n_best), 1):
                    out.append((i, r, score, len(ids), zlib.crc32(ids), hashlib.sha256(pieces.spell(ids)).hexdigest()))
            if out:
                doc, *cols = zip(*out, strict=True)
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "text_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, text_sha256 string").withColumnRenamed("doc_id", id_col)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return summaries(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), 3)
