"""Prefix trie of conversations by an Euler tour.

Conversations that begin alike share the nodes of their first turns.  A prefix is known by the sum of the
hashes of (turn, depth) over its turns, so that prefixes are running sums and no conversation is ever
gathered; a node is a group of equal prefixes, named by its smallest conversation and its depth.  The
tour enters and leaves every node once: it enters a node after its previous sibling is left, or else after
its parent is entered, and leaves it after its last child is left, or else after it was entered.
Ranking that list gives sums at every arc, and the sums of a subtree are the difference between
leaving and entering its top.

Defined cases: rows without a conversation id take no part; a NULL role or text is empty; turns are
taken in order of ``turn``, NULL first, equal ones by the digest of their role and text, and a repeated
row is a turn more; a conversation without turns is a member of the root; without conversations there are
no nodes.  Prefixes that meet in one sum but differ in their last turn stop the job (128 bits).
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.list_ranking import ranked
from postloom.llm.scans import grouped_scan
from postloom.llm.shared import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["depth", "upto_a", "upto_b"]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of the length of the role, the role and the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes): the turns of every conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("copy"),  # lets many equal rows be dealt out
    )
    placed = grouped_scan(rows, ["conv_id"], ["turn", "digest", "copy"])
    return placed.select("conv_id", F.col("position").alias("depth"), "digest", "bytes")


def rebuilt(rows: DataFrame) -> DataFrame:
    """Sequences in which every conversation c begins with turns of conversation c - c % 5.

    It takes the first crc32(c) % 9 turns of that one, then its own turns after its first so many.
    """
    c = F.col("conv_id")
    shared = F.crc32(c.cast("string").cast("binary")) % 9
    starts = rows.where((c % 5 == 0) & (F.col("depth") <= 8)).select(
        c.alias("base"), "depth", "digest", "bytes"
    )
    convs = rows.select("conv_id").distinct().select(
        "conv_id", (c - c % 5).alias("base"), shared.alias("shared")
    )
    heads = convs.join(starts, "base").where("depth <= shared")
    lengths = starts.groupBy("base").agg(F.max("depth").alias("length"))
    taken = convs.join(lengths, "base", "left").select(
        "conv_id", (F.least("shared", F.coalesce("length", F.lit(0))) - F.col("shared")).alias("moved")
    )
    tails = rows.where(F.col("depth") > shared).join(taken, "conv_id")
    return heads.select("conv_id", "depth", "digest", "bytes").unionByName(
        tails.select("conv_id", (F.col("depth") + F.col("moved")).alias("depth"), "digest", "bytes")
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversation ids of each node in a batch, joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in KEY])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        ids = batch.column("conv_id").to_numpy()
        texts = [",".join(map(str, some.tolist())) for some in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(k[starts]) for k in keys), pa.array(ids[starts]), pa.array(texts)],
            names=[*KEY, "first", "ids"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each node, fed piece by piece."""
    last, state = None, None

    def done(key, state):
        columns = [pa.array([v]) for v in (*key, state.hexdigest())]
        return pa.RecordBatch.from_arrays(columns, names=[*KEY, "ends_sha256"])

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in KEY))
        found: list[tuple] = []
        for key, text in zip(keys, batch.column("ids").to_pylist()):
            if key == last:
                state.update(b"," + text.encode())
                continue
            if last is not None:
                found.append((*last, state.hexdigest()))
            last, state = key, hashlib.sha256(text.encode())
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*found)], names=[*KEY, "ends_sha256"]
            )
    if last is not None:
        yield done(last, state)


def end_digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256: digest of the ascending ids of the conversations that end at each node.

    The ids are sorted and joined in pieces by many tasks; only the pieces of a node meet in one,
    which holds no more of them than one piece.
    """
    order = [*KEY, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _joined, "depth long, upto_a long, upto_b long, first long, ids string"
    )
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        _hashed, "depth long, upto_a long, upto_b long, ends_sha256 string"
    )


def prefixes(rows: DataFrame) -> DataFrame:
    """Sequences with the sum of each prefix (upto_a, upto_b) and of the one before it."""
    hashes = [F.xxhash64(F.lit(k), "digest", "depth").alias(n) for k, n in enumerate("ab")]
    narrow = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "bytes", *hashes)
    return materialize(grouped_scan(narrow, ["conv_id"], ["depth"], sums=["a", "b"]), "prefixes")


def nodes_of(prefixed: DataFrame, members: DataFrame) -> DataFrame:
    """KEY, conv_id, n_convs, bytes, before_a, before_b of every node, the root at depth 0."""
    found = prefixed.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"),
        *[f(f"before_{n}").alias(f"{g}_{n}") for n in "ab" for f, g in ((F.min, "before"), (F.max, "most"))],
    )
    same = (F.col("before_a") == F.col("most_a")) & (F.col("before_b") == F.col("most_b"))
    clash = F.raise_error(F.lit("two prefixes have one sum")).cast("long")
    found = found.withColumn("conv_id", F.when(same, F.col("conv_id")).otherwise(clash))
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(k) for k in KEY], "conv_id", "n_convs",
                       *[zero.alias(c) for c in ("bytes", "before_a", "before_b")])
    return found.drop("most_a", "most_b").unionByName(root)


def tour(tree: DataFrame) -> DataFrame:
    """Arcs of the Euler tour, each with the arc before it.

    An arc is (conversation, 2 * depth) for entering a node and (conversation, 2 * depth + 1) for leaving.
    """
    code = F.col("depth") * 2

    def arc(conv: Column | str, at: Column):
        return F.struct((F.col(conv) if isinstance(conv, str) else conv).alias("c"), at.alias("k"))

    after_sibling, after_parent = arc("previous", code + 1), arc("parent_conv_id", code - 2)
    after_child, after_entering = arc("last_child", code + 3), arc("conv_id", code)
    enter = F.struct(
        code.alias("a2"),
        F.when(F.col("previous").isNotNull(), after_sibling)
        .when(F.col("parent_conv_id").isNotNull(), after_parent).alias("p"),
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    leave = F.struct(
        (code + 1).alias("a2"),
        F.when(F.col("last_child").isNotNull(), after_child).otherwise(after_entering).alias("p"),
        F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
    )
    arcs = tree.select(F.col("conv_id").alias("a1"), F.explode(F.array(enter, leave)).alias("arc"))
    return arcs.select(
        "a1", "arc.a2", F.col("arc.p.c").alias("p1"), F.col("arc.p.k").alias("p2"),
        F.lit(1).cast("long").alias("place"), "arc.n_leaves", "arc.saved_tokens",
    )


def trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the sequences ``rows`` (conv_id, depth, digest, bytes).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and entered_at, left_at: the places of the two arcs in the tour, from 1.
    ``members``: conv_id of all conversations, also of those without turns.
    """
    members = materialize(members.select("conv_id").where("conv_id IS NOT NULL").distinct(), "members")
    prefixed = prefixes(rows)
    nodes = materialize(nodes_of(prefixed, members), "nodes")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("upto_a").alias("before_a"),
        F.col("upto_b").alias("before_b"), F.col("conv_id").alias("parent_conv_id"),
    )
    below = nodes.where("depth > 0").join(parents, ["depth", "before_a", "before_b"])
    siblings = grouped_scan(
        below.select("parent_conv_id", "depth", "conv_id"), ["depth", "parent_conv_id"], ["conv_id"],
        previous="conv_id",
    )
    siblings = materialize(siblings.drop("position"), "siblings")
    children = siblings.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.max("conv_id").alias("last_child")
    )
    ends = prefixed.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end"))
    ends = members.join(ends, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col("end")[k], F.lit(0)).cast("long").alias(k) for k in KEY]
    )
    node = ["conv_id", "depth"]
    tree = (
        nodes.join(siblings, node, "left")
        .join(children, node, "left")
        .join(end_digests(ends), KEY, "left")
        .select(
            *node, "parent_conv_id", "previous", "last_child", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
    tree = materialize(tree, "tree")
    sums = ranked(tour(tree), ["place", "n_leaves", "saved_tokens"])
    leaving = F.col("a2") % 2 == 1

    def gained(name: str) -> Column:
        """What the tour adds between just after entering a node and leaving it."""
        return F.sum(F.when(leaving, F.col(name)).otherwise(-F.col(name))).alias(f"inner_{name}")

    inner = sums.groupBy(F.col("a1").alias("conv_id"), F.expr("a2 div 2").alias("depth")).agg(
        gained("n_leaves"), gained("saved_tokens"),
        F.min("place").alias("entered_at"), F.max("place").alias("left_at"),
    )
    return tree.join(inner, node).select(
        *node, "parent_conv_id", "n_convs", "n_children",
        (F.col("inner_n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("inner_saved_tokens") + F.col("saved")).alias("saved_tokens"),
        "ends_sha256", "entered_at", "left_at",
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations given as turns (conv_id, turn, role, text)."""
    rows = materialize(sequences(turns), "sequences")
    return trie(rows, rows.select("conv_id"))
