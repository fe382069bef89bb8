"""Token ids as Parquet list columns, in document order.

Documents are dealt into ranges of ``doc_id`` and sorted, each task encodes whole texts and writes
one file: ids as a list column (dictionary or delta encoded), beside them the number of ids, the task's
place in the order and the ids before a document within its file.  Row groups and pages have
set sizes, and the page index lets a reader fetch the metadata, or the ids of a few documents, alone.

Defined cases: a NULL text is empty and holds the end id alone; NULL ids come first; rows that repeat
an id follow each other, ordered by their text's digest; strings of special tokens in a text are encoded
as the tokenizer's file says; an empty table gives empty files.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "byte_bpe_50k.json"
END = 2
# Characters encoded at once, which bounds the memory that encodings take.
CHARS = 1_000_000
# Different words that a task remembers.
REMEMBERED = 400_000
# White space for every library, and all that any library takes for white space.
SPACE = r" \t\n\r\f\v"
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
ANY_SPACE = r"\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff"
SCHEMA = "doc_id long, part int, before long, n_tokens int, ids array<int>"


class Numbered(dict):
    """Numbers keys as they come; new ones are listed in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = number = len(self)
        return number


class WordEncoder:
    """Encodes whole texts by a tokenizer of this kind, each different word once.

    A byte-level tokenizer cuts a text into words before anything else.  A word never holds a white
    space that follows another character, nor punctuation (but an apostrophe) that follows a letter.
    So a text cut there has the ids of its parts, in order; parts met before (up to
    ``REMEMBERED``) are not encoded again.  Punctuation of special tokens is left uncut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        marks = re.escape("".join(c for c in MARKS if c not in special[1:]))
        # White space that could join with a line end: any but one space in front of something else.
        # How the tokenizer spells the bytes of a space and of letters, asked of itself.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = [chr(c) for c in range(0x250) if re.fullmatch(f"[{LETTERS}]", chr(c))]
        self.bytes = {ord(c): spell(c)[0][0] for c in [" ", *letters]}
        whole = len(spell(" " + "".join(letters))) == 1
        self.single = re.compile(f" ?[{LETTERS}]+" if whole else "(?!)").fullmatch
        # Letters up to a cut; punctuation up to one; anything up to a white space; the rest.
        self.parts = re.compile(
            f"[{SPACE}]*[{marks}]*[{LETTERS}]+(?=[{SPACE}{marks}])|[{SPACE}]*[{marks}]+(?=[{SPACE}])"
            f"|.+?(?=(?<=[^{ANY_SPACE}])[{SPACE}])|.+",
            re.DOTALL,
        )
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.flat = np.zeros(0, np.int32)
        self.starts = self.stops = np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Append the ids of new parts.

        A part of letters alone is one word already, so the model itself is asked; all other parts
        go through the whole tokenizer.
        """
        single = [self.single(p) is not None for p in parts]
        rest = iter(
            self.tokenizer.encode_batch_fast(
                [p for p, one in zip(parts, single) if not one], add_special_tokens=False
            )
        )
        ask, table, ids, sizes = self.tokenizer.model.tokenize, self.bytes, [], []
        for part, one in zip(parts, single):
            found = [t.id for t in ask(part.translate(table))] if one else next(rest).ids
            ids += found
            sizes.append(len(found))
        stops = len(self.flat) + np.cumsum(np.array(sizes, np.int64))
        self.flat = np.concatenate([self.flat, np.array(ids, np.int32)])
        self.starts = np.concatenate([self.starts, stops - sizes])
        self.stops = np.concatenate([self.stops, stops])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        number, rows = self.known.__getitem__, []
        for text in texts:
            parts = self.parts.findall(text)
            rows.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        if self.known.fresh:
            self._learn(self.known.fresh)
            self.known.fresh = []
        return [self.flat[_ranges(self.starts[row], self.stops[row])] for row in rows]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions from each start up to its end, one after the other."""
    sizes = ends - starts
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return shift + np.arange(int(sizes.sum()))


def _stretches(texts: list[str], limit: int) -> Iterator[list[str]]:
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def encoder(path: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordEncoder(path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            for some in _stretches(texts, CHARS):
                rows = [np.append(row, np.int32(end)) for row in words.encode(some)]
                sizes = np.array([len(r) for r in rows], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(rows).astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(rows)),
                        pa.array(np.full(len(rows), part, np.int32)),
                        pa.array(before + offsets[:-1]),
                        pa.array(sizes.astype(np.int32)),
                        lists,
                    ],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(offsets[-1])
                at += len(rows)

    return encode


def encoded(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Documents in ascending order of their ids, each with the ids of its whole text and the end id."""
    path = path or public_tokenizers.path(TOKENIZER)
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
        .repartitionByRange("doc_id", "digest")  # rows of one id, or without any, are dealt out too
        .sortWithinPartitions("doc_id", "digest")
        .drop("digest")
    )
    return ordered.mapInArrow(encoder(path, end), SCHEMA)


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    end: int = END,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Write token files; ``encoding`` of the ids is "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    ids = "parquet.enable.dictionary#ids.list.element"
    encoded(docs, path, end).write.options(
        **{
            "parquet.writer.version": "PARQUET_2_0",  # integers without a dictionary as deltas
            "parquet.enable.dictionary": "false",
            ids: str(encoding == "dictionary").lower(),
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": "1000",
            "compression": "zstd",
        }
    ).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; ``start``: ids of all documents before it."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    # One row per file, whatever the files hold.
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset")
    )
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id",
        (F.col("offset") + F.col("before")).alias("start"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        sums = [zlib.crc32(row.tobytes()) for row in np.split(flat, ends[:-1])] if len(ends) else []
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(3)] + [pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(tokens: DataFrame) -> DataFrame:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
