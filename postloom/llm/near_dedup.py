"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, components.

SuperMinHash gives every element of a set its own random order of the slots: in round j the element
offers j plus a random fraction to the j-th slot of its order, and a slot keeps its smallest offer.
Rounds are run for all elements of a batch of documents at once; a document is finished as soon as
all its slots are filled, since later rounds only offer more.

Links are searched among texts with different sets only (equal sets are one class).  The members of
a bucket are first compared with two centres of it, by their full sets; that joins almost all
true links without pairing members.  The members outside the largest component of a bucket then
meet all others of the bucket, block by block, again by their full sets; only links that join
components leave a block.  Hence every pair that shares a band ends in one component or is checked.

Defined cases: a text with fewer words than a shingle is one shingle; NULL, empty and blank texts have
none and are linked with nothing; rows that repeat an id are one document with the links of all its
texts, which are compared each by itself; a row with a NULL id takes the component of documents with an equal set, else NULL, and
links nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.components import components
from postloom.llm.exact_dedup import digest
from postloom.llm.shared import free_name, materialize
from postloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# 25 bands of 5: a pair at similarity 0.8 meets in none with probability 0.00005.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
CHUNK = 100_000
# Shingles in a block of a large bucket.
BLOCK = 300_000
# Members of small buckets that are compared in one call.
GROUP = 400
# Pairs (16 bytes each) that are broadcast at most; beyond, texts are looked up by a shuffle.
BROADCAST_PAIRS = 1_000_000
UNFILLED = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    # On bytes, lower() changes A-Z alone and split() cuts at the six ASCII white spaces.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(words) - size + 1 + i])
    return np.unique(rolled)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signature matrix, one row per set; an empty set keeps unfilled slots."""
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    filled = np.full((len(sets), slots), UNFILLED, np.uint64)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order: np.ndarray | None = None
    for step in range(slots):
        if not len(elements):
            break
        drawn = mixed(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = step + ((drawn & np.uint64(0xFFFFFFFF)) % np.uint64(slots - step)).astype(np.int64)
        if order is None:
            at = swap
        else:
            row = np.arange(len(elements))
            at = order[row, swap].astype(np.int64)
            order[row, swap] = order[:, step]
        offer = (np.uint64(step) << np.uint64(56)) | (drawn >> np.uint64(8))
        np.minimum.at(filled.reshape(-1), owner * slots + at, offer)
        going = ((filled == UNFILLED).any(axis=1))[owner]
        elements, owner = elements[going], owner[going]
        if order is not None:
            order = order[going]
        elif len(elements):  # orders are only kept for sets that need a second round
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            row, swapped = np.arange(len(elements)), swap[going]
            order[row, swapped] = 0
    return filled


def band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signatures), band + 1, np.uint64)
        for slot in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, slot])
        keys[:, band] = key
    return keys.view(np.int64)


FEATURES = "doc_id long, sha binary, n_shingles long, same binary, bands array<long>"


def features(size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows(ids: list, shas: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            signatures = super_minhash(sets)
            keys = band_keys(signatures)
            lists = pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1))
            )
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(shas, pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    lists,
                ],
                names=["doc_id", "sha", "n_shingles", "same", "bands"],
            )

        for batch in batches:
            ids, shas, sets, held = [], [], [], 0
            for doc_id, text, sha in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids.append(doc_id)
                shas.append(sha)
                sets.append(shingles(text.as_py(), size, hashes))
                held += len(sets[-1])
                if held >= CHUNK:
                    yield rows(ids, shas, sets)
                    ids, shas, sets, held = [], [], [], 0
            if ids:
                yield rows(ids, shas, sets)

    return of


def linked(size: int, threshold: int):
    """Keep the pairs (a, b, text_a, text_b) whose full sets reach the similarity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            centre, kept = (None, None), []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if centre[0] != a:
                    centre = (a, shingles(left.as_py(), size, hashes))
                other = shingles(right.as_py(), size, hashes)
                inner = len(np.intersect1d(centre[1], other, assume_unique=True))
                kept.append(100 * inner >= threshold * (len(centre[1]) + len(other) - inner))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return of


def meetings(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set on the left, the sizes of its intersections with all sets on the right."""
    owner = np.repeat(np.arange(len(right)), [len(r) for r in right])
    elements = np.concatenate(right)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    for one in left:
        first, last = np.searchsorted(elements, one), np.searchsorted(elements, one, "right")
        held = last - first
        at = np.repeat(first - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
        yield np.bincount(owner[at], minlength=len(right))


def across(size: int, threshold: int):
    """Links between the components of a bucket: its minor members against a block of all.

    Each minor member gets one link at most to each other component.  A group has many small
    buckets or a block of a large one.
    """
    hashes = WordHashes()

    def of(group: pd.DataFrame) -> pd.DataFrame:
        sets = {t: shingles(t, size, hashes) for t in group["text"].unique()}
        group = group.sort_values(["bucket", "block", "chunk"], kind="stable")
        keys = group[["bucket", "block", "chunk"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ids, comps = group["class"].to_numpy(), group["component"].to_numpy()
        minor, texts = group["minor"].to_numpy(bool), group["text"].tolist()
        found = []
        for start, end in zip(starts, np.r_[starts[1:], len(group)]):
            left = start + np.flatnonzero(minor[start:end])
            right = start + np.flatnonzero(~minor[start:end])
            if not len(left) or not len(right):
                continue
            others = [sets[texts[j]] for j in right]
            lengths = np.array([len(o) for o in others])
            for i, inner in zip(left, meetings([sets[texts[i]] for i in left], others)):
                both = len(sets[texts[i]]) + lengths - inner
                near = right[(100 * inner >= threshold * both) & (comps[right] != comps[i])]
                _, first = np.unique(comps[near], return_index=True)
                found += [(ids[i], ids[j]) for j in near[first]]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return of


class Search:
    """Links between classes of equal sets, in rounds over the buckets with several classes.

    A class is a number; its text is that of one row, which its id and a hash of the text name.
    """

    def __init__(self, docs: DataFrame, size: int, threshold: int):
        keyed = docs.select("doc_id", "text", digest("text").alias("sha"))
        self.docs = keyed.select("doc_id", "text", F.xxhash64("sha").alias("key"))
        self.size, self.threshold = size, threshold
        self.rows = materialize(keyed.mapInArrow(features(size), FEATURES), "features")
        some = self.rows.where("n_shingles > 0 and doc_id is not null")
        first = some.groupBy("same").agg(F.min(F.struct("doc_id", "sha")).alias("first"))
        numbered = first.select(
            "same",
            F.monotonically_increasing_id().alias("class"),
            F.col("first.doc_id").alias("node"),
            F.xxhash64("first.sha").alias("key"),
        )
        self.classes = materialize(numbered, "classes")
        firsts = self.classes.select(F.col("same").alias("same_node"), "node", "class")
        nodes = some.join(firsts, (F.col("same") == F.col("same_node")) & (F.col("doc_id") == F.col("node")))
        self.nodes = materialize(nodes.dropDuplicates(["class"]).select("class", "n_shingles", "bands"), "nodes")
        slots = self.nodes.select(F.explode("bands").alias("bucket"), "class", "n_shingles")
        shared = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        self.slots = materialize(slots.join(shared.select("bucket"), "bucket", "left_semi"), "buckets")
        self.texts = self.candidates()

    def candidates(self) -> DataFrame:
        """(class, text) of every class that shares a bucket: one row each, however often rows repeat."""
        wanted = self.classes.join(self.slots.select("class").distinct(), "class", "left_semi")
        wanted, rows = written(wanted.select("class", F.col("node").alias("doc_id"), "key"), "wanted")
        small = F.broadcast(wanted) if rows <= BROADCAST_PAIRS else wanted
        texts = self.docs.join(small, ["doc_id", "key"]).select("class", "text")
        return materialize(texts.dropDuplicates(["class"]), "texts")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The written links among the pairs: both whole texts meet and are compared."""
        pairs, rows = written(pairs, "pairs")
        small = F.broadcast if rows <= BROADCAST_PAIRS else lambda table: table
        right = self.texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")).join(small(pairs), "b")
        left = self.texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
        left = left.join(small(pairs.select("a").distinct()), "a", "left_semi")
        both = right.join(left, "a").select("a", "b", "text_a", "text_b")
        links = both.mapInArrow(linked(self.size, self.threshold), "a long, b long")
        return materialize(links, "links")

    def open_slots(self, found: DataFrame) -> DataFrame:
        """Members of buckets with several components, dealt into blocks: (bucket, block, chunk).

        Members outside the largest component of a bucket are its minor ones.  Each member is in
        one block; the minor ones, in chunks, meet every block.
        """
        at = self.slots.join(found, F.col("class") == F.col("node"), "left").select(
            "bucket", "class", "n_shingles", F.coalesce("component", "class").alias("component")
        )
        by_component = at.groupBy("bucket", "component").agg(
            F.count("*").alias("n"), F.sum("n_shingles").alias("n_shingles")
        )
        shares = by_component.groupBy("bucket").agg(
            F.max_by("component", F.struct("n", "component")).alias("largest"),
            F.max(F.struct("n", "component", "n_shingles")).alias("most"),
            F.sum("n_shingles").alias("all"),
            F.count("*").alias("components"),
        )
        shares = shares.where("components > 1").select(
            "bucket",
            "largest",
            F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("most.n_shingles")) / BLOCK).cast("int").alias("chunks"),
        )
        dealt = at.join(shares, "bucket").withColumn("hash", F.xxhash64("class"))

        def all_of(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def one_of(n: str):
            return F.pmod(F.col("hash"), F.col(n)).cast("int")

        columns = ["bucket", "class", "component"]
        every = dealt.select(*columns, one_of("blocks").alias("block"), all_of("chunks").alias("chunk"), F.lit(False).alias("minor"))
        minor = dealt.where("component != largest").select(
            *columns, all_of("blocks").alias("block"), one_of("chunks").alias("chunk"), F.lit(True).alias("minor")
        )
        return materialize(every.unionByName(minor), "open")

    def with_centres(self, slots: DataFrame) -> DataFrame:
        """Every member of a bucket with two of them: the smallest and the one with the smallest hash."""
        centres = slots.groupBy("bucket").agg(
            F.array(F.min("class"), F.min_by("class", F.xxhash64("class"))).alias("centres")
        )
        return (
            slots.join(centres, "bucket")
            .select(F.explode(F.array_distinct("centres")).alias("a"), F.col("class").alias("b"))
            .where("a != b")
            .distinct()
        )

    def links_across(self, slots: DataFrame) -> DataFrame:
        """The written links that join components within a bucket."""
        rows = slots.count()
        few = F.broadcast if rows <= BROADCAST_PAIRS else lambda table: table
        told = self.texts.join(few(slots), "class").withColumn(
            "group", F.pmod(F.xxhash64("bucket", "block", "chunk"), F.lit(rows // GROUP + 1))
        )
        links = told.groupBy("group").applyInPandas(
            across(self.size, self.threshold), "a long, b long"
        )
        return materialize(links, "links")

    def components(self) -> DataFrame:
        """(node_class, component) of every class that is linked with another."""
        found = components(self.confirmed(self.with_centres(self.slots)))
        more = self.links_across(self.open_slots(found))
        return components(found.toDF("a", "b").unionByName(more)).toDF("node_class", "component")


def decide_rows(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, sha, n_shingles, component_id, text_component: one row per row of ``docs``.

    ``text_component`` is the smallest id with a text that is linked with the row's own, directly or
    over other texts; ``component_id`` also follows the other texts of an id.
    """
    search = Search(docs, size, threshold)
    found = search.components()
    of_class = search.classes.join(found, F.col("class") == F.col("node_class"), "left").select(
        "same", "node", F.coalesce("component", "class").alias("texts")
    )
    of_class = materialize(of_class, "components")
    rows = search.rows.select("doc_id", "sha", "n_shingles", "same")
    some, blank = rows.where("n_shingles > 0"), rows.where("n_shingles = 0").drop("same")
    held = some.where("doc_id is not null").join(of_class, "same").select("doc_id", "texts").distinct()
    held = materialize(held, "held")
    # The texts of one id are one document: their components are linked.
    least = held.groupBy("doc_id").agg(F.min("texts").alias("b"), F.max("texts").alias("most")).where("b != most")
    joined = components(held.join(least, "doc_id").select(F.col("texts").alias("a"), "b"))
    named = of_class.groupBy("texts").agg(F.min("node").alias("text_component"))
    whole = named.join(joined, F.col("texts") == F.col("node"), "left").select(
        "texts", "text_component", F.coalesce("component", "texts").alias("whole")
    )
    whole = materialize(whole, "whole")
    names = whole.groupBy("whole").agg(F.min("text_component").alias("component_id"))
    names = materialize(whole.join(names, "whole").drop("whole"), "names")
    columns = ["doc_id", "sha", "n_shingles", "component_id", "text_component"]
    some = some.join(of_class.join(names, "texts").drop("texts", "node"), "same", "left").select(*columns)
    of_id = held.join(names, "texts").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    blank = blank.join(of_id, "doc_id", "left").select(
        "doc_id",
        "sha",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").alias("text_component"),
    )
    return some.unionByName(blank)


def decide(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Documents are linked when 100 * intersection >= ``threshold`` * union of their shingle sets;
    the component is named by its smallest id, which is the document that is kept.  All rows of an
    id are one document.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return decide_rows(docs, size, threshold).select("doc_id", "n_shingles", "component_id", kept)


def drop_near_copies(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without the texts that are linked with a text of a smaller id, all columns unchanged.

    Rows go by their id and text: a copy takes no other row along that has its id, or none, and a
    text is only dropped where one that it is linked with by texts alone stays.
    """
    rows = decide_rows(docs, size, threshold).where(~F.col("doc_id").eqNullSafe(F.col("text_component")))
    lost = materialize(rows.select("doc_id", "sha").distinct(), "near_copies")
    sha = free_name(docs, "sha")
    keyed = docs.withColumn(sha, digest("text"))
    same_text = keyed["doc_id"].eqNullSafe(lost["doc_id"]) & (keyed[sha] == lost["sha"])
    # The list grows with the documents, so at any size it is shuffled; each text moves once.
    return keyed.join(lost.hint("merge"), same_text, "left_anti").drop(sha)
