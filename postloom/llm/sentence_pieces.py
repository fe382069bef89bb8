"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch of texts are joined and indexed by a suffix array, as deep as the longest
piece.  Every piece of the vocabulary is looked up by binary search; its range of suffixes
gives its occurrences, which are the edges of the segmentation, laid out by position and length.
Relaxation then decides between edges.  The model here is a BPE model with byte fallback, so
edges are not relaxed by the best sum of scores but as the model defines it: within a word, the
best-scored edge that joins two adjacent symbols goes first, the leftmost of equals, until no edge
joins any; whatever is in no piece falls back to bytes.

Words are cut where no piece can reach across: before a run of spaces that follows something else and
around characters that occur in no longer piece.  Words met before are not encoded again.

Defined cases: NULL and empty texts have no ids; spaces and line ends are kept as they are; the
mark for a space in a text reads back as a space; texts of any length and words of any length are
encoded whole; other columns of a table pass through, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from postloom.llm.shared import free_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Characters of text and of new words that are worked on at once; bounds of memory only.
TEXT_CHARS = 1_000_000
WORD_CHARS = 200_000
# Words up to this length are relaxed side by side, longer ones each with a queue of edges.
LONG = 128
REMEMBERED = 250_000
NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id: text, score, and the byte of a fallback piece (-1: none, -2: control)."""

    pieces: list[str]
    scores: list[float]
    bytes: list[int]
    unknown: int
    prefix: bool

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path or public_tokenizers.path(MODEL), "rb") as file:
            model.ParseFromString(file.read())
        trainer, normalizer = model.trainer_spec, model.normalizer_spec
        kind = type(model.pieces[0]) if model.pieces else None
        plain = not normalizer.precompiled_charsmap and not normalizer.remove_extra_whitespaces
        known = {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN} if kind else set()
        if trainer.model_type != trainer.BPE or not plain or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without text normalization is needed")
        if any(p.type not in known for p in model.pieces):
            raise ValueError("the model has pieces of a kind that is not supported")
        codes = []
        for p in model.pieces:
            codes.append(-1 if p.type == kind.NORMAL else int(p.piece[3:5], 16) if p.type == kind.BYTE else -2)
        return cls(
            [p.piece for p in model.pieces],
            [p.score for p in model.pieces],
            codes,
            next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN),
            normalizer.add_dummy_prefix,
        )

    def state(self) -> tuple:
        return (self.pieces, self.scores, self.bytes, self.unknown, self.prefix)


class Encoder:
    """Encodes and decodes batches of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        normal = [i for i, code in enumerate(v.bytes) if code == -1]
        self.longest = max((len(v.pieces[i]) for i in normal), default=1)
        _, ranks = np.unique(-np.array(v.scores), return_inverse=True)
        self.ranks = np.append(ranks.astype(np.int32), NONE)  # by id; smaller goes first
        self.single = {v.pieces[i]: i for i in normal if len(v.pieces[i]) == 1}
        self.long_ids = np.array([i for i in normal if len(v.pieces[i]) > 1], np.int32)
        self.long_sizes = np.array([len(v.pieces[i]) for i in self.long_ids], np.int32)
        long = [v.pieces[i] for i in self.long_ids]
        # Order-preserving codes of characters: 0 ends a word, the last stands for all others.
        letters = sorted(set("".join(long)))
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.lower = self._keys(long, 0)
        self.upper = self._keys(long, 0xFFFF)
        self.byte_ids = {code: i for i, code in enumerate(v.bytes) if code >= 0}
        joinable = "".join(f"\\U{ord(c):08x}" for c in letters if c != SPACE)
        joined = f"{SPACE}*[{joinable}]+|" if joinable else ""
        self.words = re.compile(f"{joined}{SPACE}+|.", re.DOTALL)
        self.spelled = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for i, code in enumerate(v.bytes):
            if code != -1:
                self.spelled[i] = bytes([code]) if code >= 0 else b""
        self.spelled[v.unknown] = " ⁇ ".encode()
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _codes(self, text: str) -> np.ndarray:
        """Codes of characters; those of no longer piece get codes of their own kind: the last."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        known = self.letters[at] == points
        return np.where(known, at + 1, len(self.letters) + 1).astype(np.uint16)

    def _keys(self, pieces: list[str], fill: int) -> np.ndarray:
        """Fixed-width keys that compare as the code sequences do."""
        keys = np.full((len(pieces), self.longest), fill, ">u2")
        for row, piece in enumerate(pieces):
            keys[row, : len(piece)] = self._codes(piece)
        return np.ascontiguousarray(keys).view(f"S{2 * self.longest}").reshape(-1)

    def _suffixes(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffix array, as deep as the longest piece, suffixes ending with their words."""
        n = len(codes)
        rank, depth, place = codes.astype(np.int64), 1, np.arange(n)
        while depth < self.longest:
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(place + depth < ends)
            after[inside] = rank[inside + depth]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            rank = rank + 1
            depth *= 2
        return np.argsort(rank, kind="stable")

    def _edges(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """table[position, length]: id of the piece there, -1 for none."""
        n, width = len(codes), self.longest
        order = self._suffixes(codes, ends)
        padded = np.concatenate([codes, np.zeros(width, np.uint16)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)[:n][order]
        inside = np.arange(width)[None, :] < (ends - np.arange(n))[order][:, None]
        keys = np.where(inside, windows, 0).astype(">u2").view(f"S{2 * width}").reshape(-1)
        first, last = np.searchsorted(keys, self.lower), np.searchsorted(keys, self.upper, "right")
        counts = last - first
        starts = np.repeat(first - (np.cumsum(counts) - counts), counts)
        positions = order[starts + np.arange(int(counts.sum()))]
        table = np.full((n, width + 1), -1, np.int32)
        table[positions, np.repeat(self.long_sizes, counts)] = np.repeat(self.long_ids, counts)
        return table

    def _relax(self, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length of the symbol that starts at each position, 0 inside symbols; many words at once."""
        sizes = np.zeros(len(table), np.int64)
        width = table.shape[1]
        word = np.repeat(np.arange(len(starts)), ends - starts)
        at = _ranges(starts, ends)
        sizes[at] = 1

        def joins(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both = sizes[i] + sizes[j]
            fits = both < width
            return self.ranks[np.where(fits, table[i, np.where(fits, both, 0)], -1)]

        best = np.full(len(at), NONE, np.int32)
        pair = np.flatnonzero(word[:-1] == word[1:])
        best[pair] = joins(at[pair], at[pair + 1])
        while len(at):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(best, begin)
            runs = np.diff(np.r_[begin, len(at)])
            of_word = np.repeat(least, runs)
            hit = np.flatnonzero((best == of_word) & (of_word != NONE))
            if not len(hit):
                break
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            sizes[at[hit]] += sizes[at[hit + 1]]
            sizes[at[hit + 1]] = 0
            keep = of_word != NONE  # words without an edge left are finished
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            at, word, best = at[keep], word[keep], best[keep]
            for i in (moved[hit], moved[hit] - 1):  # the joined symbol and the one before it
                i = i[(i >= 0) & (i < len(at))]
                best[i] = NONE
                two = i[i + 1 < len(at)]
                two = two[word[two] == word[two + 1]]
                best[two] = joins(at[two], at[two + 1])
        return sizes

    def _relax_long(self, table: np.ndarray, start: int, end: int, sizes: np.ndarray) -> None:
        """The same for one long word, with a queue of edges."""
        size = {i: 1 for i in range(start, end)}
        before = {i: i - 1 for i in range(start + 1, end)}
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = i + size[i]
            if j < end and size[i] + size[j] < table.shape[1]:
                piece = table[i, size[i] + size[j]]
                if piece >= 0:
                    heapq.heappush(queue, (int(self.ranks[piece]), i, size[i], size[j]))

        for i in range(start, end):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            if size.get(i) != left or size.get(i + left) != right:
                continue
            size[i] = left + right
            del size[i + left]
            if i + left + right < end:
                before[i + left + right] = i
            offer(i)
            if i in before:
                offer(before[i])
        for i, n in size.items():
            sizes[i] = n

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each word."""
        text = "".join(words)
        lengths = np.array([len(w) for w in words], np.int64)
        stops = np.cumsum(lengths)
        begins = stops - lengths
        table = self._edges(self._codes(text), np.repeat(stops, lengths))
        long = lengths > LONG
        sizes = self._relax(table, begins[~long], stops[~long])
        for i in np.flatnonzero(long):
            self._relax_long(table, int(begins[i]), int(stops[i]), sizes)
        at = np.flatnonzero(sizes)
        ids = table[at, np.where(sizes[at] > 1, sizes[at], 0)].tolist()
        out, counts = [], np.ones(len(at), np.int64)
        for k, (i, one) in enumerate(zip(at.tolist(), (sizes[at] == 1).tolist())):
            if not one:
                out.append(ids[k])
                continue
            found = self.single.get(text[i])
            if found is None:
                spelled = [self.byte_ids.get(b, self.vocabulary.unknown) for b in text[i].encode()]
                spelled = spelled if self.byte_ids else [self.vocabulary.unknown]
                out.extend(spelled)
                counts[k] = len(spelled)
            else:
                out.append(found)
        owner = np.searchsorted(stops, at, side="right")
        per_word = np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)
        return np.array(out, np.int32), per_word

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before, in stretches."""
        pieces, counts, some, held = [self.flat], [], [], 0
        for i, word in enumerate(words):
            some.append(word)
            held += len(word)
            if held >= WORD_CHARS or i == len(words) - 1:
                ids, per_word = self._encode_words(some)
                pieces.append(ids)
                counts.append(per_word)
                some, held = [], 0
        if counts:
            self.flat = np.concatenate(pieces)
            sums = self.ends[-1] + np.cumsum(np.concatenate(counts))
            self.ends = np.concatenate([self.ends, sums])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self._forget()
        prefix = SPACE if self.vocabulary.prefix else ""
        known, fresh, rows = self.index, [], []
        for text in texts:
            words = self.words.findall(prefix + text.replace(" ", SPACE)) if text else []
            row = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            for k in np.flatnonzero(row < 0).tolist():
                at = known.get(words[k])
                if at is None:
                    at = known[words[k]] = len(known)
                    fresh.append(words[k])
                row[k] = at
            rows.append(row)
        self._learn(fresh)
        out = []
        for row in rows:
            out.append(self.flat[_ranges(self.ends[row], self.ends[row + 1])])
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.spelled[i] for i in ids.tolist()])
        if self.vocabulary.prefix and len(ids) and text.startswith(b" ") and self.vocabulary.bytes[int(ids[0])] == -1:
            text = text[1:]
        return text.decode("utf-8", "replace")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions from each start up to its end, one after the other."""
    sizes = ends - starts
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return shift + np.arange(int(sizes.sum()))


def _encoded(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Texts and their ids, in stretches of bounded length."""
    some, held = [], 0
    for i, text in enumerate(texts):
        some.append(text.as_py())
        held += len(some[-1] or "")
        if held >= TEXT_CHARS or i == len(texts) - 1:
            yield some, encoder.encode(some)
            some, held = [], 0


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))


def with_ids(
    docs: DataFrame, path: str | None = None, column: str = "piece_ids", text: str = "text",
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of each whole text in ``column`` (renamed if the name is taken), and what
    they decode to in ``decoded``, if given; both in one pass of Python."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path).state())
    fields = [StructField(free_name(docs, column), ArrayType(IntegerType(), False))]
    if decoded:
        fields.append(StructField(free_name(docs, decoded), StringType()))
    schema, place = StructType([*docs.schema.fields, *fields]), docs.columns.index(text)
    names = [f.name for f in fields]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            at = 0
            for some, rows in _encoded(encoder, batch.column(place)):
                part = batch.slice(at, len(some))
                at += len(some)
                new = [_lists(rows)]
                if decoded:
                    new.append(pa.array([encoder.decode(r) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(add, schema)


def with_text(
    docs: DataFrame, path: str | None = None, column: str = "decoded", ids: str = "piece_ids"
) -> DataFrame:
    """``docs`` with the text that its ids spell (NULL ids: NULL)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path).state())

    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def spell(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(*shared.value))
        for lists in parts:
            rows = lists.to_pylist()
            yield pa.array(
                [None if r is None else encoder.decode(np.array(r, np.int64)) for r in rows], pa.string()
            )

    return docs.withColumn(free_name(docs, column), spell(ids))


def summaries(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and what decoding the ids gives: decoded_sha256, same_text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path).state())

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            at = 0
            for texts, rows in _encoded(encoder, batch.column(1)):
                decoded = [encoder.decode(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(r) for r in rows], pa.int64()),
                        pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                        pa.array([d == (t or "") for d, t in zip(decoded, texts)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "same_text"],
                )
                at += len(texts)

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, same_text boolean"
    return docs.select("doc_id", "text").mapInArrow(sum_up, schema)
