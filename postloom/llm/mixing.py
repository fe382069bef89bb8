"""Mixes sources to target weights: whole documents whose words meet each source's budget.

Every source has a budget of words.  Whole passes over a source use up most of it; the rest is a
subset-sum problem over document sizes.  Documents are counted by exact size, the same share of each
size is taken first, the gap is narrowed from the longest size down, and a bounded-knapsack dynamic
program over the sizes that are left closes it.  The result is a number of documents for each
size; which ones is decided by a seeded hash, so reruns agree.

Only the counts by (source, size) reach the solver, one source at a time; documents never meet.

Defined cases: NULL and empty texts have size 0 and are never taken; NULL sources form a source
of their own, ordered last; rows that repeat an id count as rows of their own; an empty table or a
source without words gives targets of 0.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.exact_dedup import digest
from postloom.llm.shared import free_name, materialize, word_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
PASSES = 2
# Words that the dynamic program may have to close; bounds its memory, not the result.
GAP = 4096
# Documents of one size that are ranked in one task.
RANKED = 20_000


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, digest of the text, size and a seeded draw in [0, 1) of every document."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "sha"), 11) / F.lit(float(1 << 53))
    keyed = docs.select("doc_id", "source", digest("text").alias("sha"), word_count("text").alias("size"))
    return keyed.withColumn("draw", draw)


def targets(counts: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_size, target from (source, size, n): one row per source.

    Shares go by weight; one that exceeds ``PASSES`` times its source stops there and the excess
    goes to the others by weight.  The level at which this ends is found by ordering sources by
    the level at which each is full.
    """
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # Windows without a partition see one row per source.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    capped = sources.select(
        "source",
        "source_size",
        weight.alias("weight"),
        (F.lit(float(PASSES)) * F.col("source_size")).alias("cap"),
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_before = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_before = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - full_before) / (F.sum("weight").over(everything) - weight_before)
    levels = capped.withColumn("level", level)
    # The first source that is not full at the level of those from it on fixes the level.
    fixed = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(
        everything
    )
    return levels.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(fixed * F.col("weight"), F.col("cap"))).alias("target"),
    )


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, gap: int = GAP) -> np.ndarray:
    """How many documents of each size to take so that their words come nearest to ``budget``.

    ``sizes`` are distinct and positive, ``budget`` is below the sum of all.  Ties take the
    smaller sum.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):  # narrow the gap, longest first
        if rest <= gap:
            break
        more = min(int(counts[i] - taken[i]), max(0, rest - gap // 2) // int(sizes[i]))
        taken[i] += more
        rest -= more * int(sizes[i])
    # Reachable sums as bits of one number; a parcel is 1, 2, 4, ... documents of one size.
    reach, history = 1, []
    limit = min(total - budget + rest, 2 * rest + int(sizes.min())) + 1
    mask = (1 << (limit + 1)) - 1
    for i in np.argsort(sizes, kind="stable"):
        left, parcel = min(int(counts[i] - taken[i]), limit // int(sizes[i])), 1
        while left > 0 and not (reach >> rest) & 1:
            parcel = min(parcel, left)
            history.append((int(i), parcel, reach))
            reach = (reach | (reach << (parcel * int(sizes[i])))) & mask
            left -= parcel
            parcel *= 2
    under = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    over = reach >> (rest + 1)
    above = rest + 1 + ((over & -over).bit_length() - 1) if over else None
    goal = above if above is not None and above - rest < rest - under else under
    for i, parcel, earlier in reversed(history):
        if not (earlier >> goal) & 1:
            taken[i] += parcel
            goal -= parcel * int(sizes[i])
    return taken


def _solve(source: pd.DataFrame) -> pd.DataFrame:
    source = source.sort_values("size")
    sizes, counts = source["size"].to_numpy(np.int64), source["n"].to_numpy(np.int64)
    budget, total = int(round(source["target"].iloc[0])), int((sizes * counts).sum())
    passes = min(budget // total, PASSES) if total else 0
    extra = np.zeros(len(sizes), dtype=np.int64)
    words = sizes > 0
    if words.any() and passes < PASSES:
        extra[words] = fit(sizes[words], counts[words], budget - passes * total)
    return source.assign(passes=passes, extra=extra)[
        ["source", "source_size", "target", "size", "n", "passes", "extra"]
    ]


def plan(counts: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """Passes and extra documents by (source, size)."""
    wanted = targets(counts, weights, share).withColumnRenamed("source", "wanted_source")
    joined = counts.join(wanted, F.col("source").eqNullSafe(F.col("wanted_source")))
    joined = joined.select("source", "source_size", "target", "size", "n")
    return joined.groupBy("source").applyInPandas(
        _solve,
        f"source {counts.schema['source'].dataType.simpleString()}, source_size long, "
        "target double, size long, n long, passes long, extra long",
    )


KEY = ("doc_id", "source", "sha")


def decide_rows(docs: DataFrame, weights, share: float, seed: int, ranked: int) -> DataFrame:
    """doc_id, source, sha, size, source_size, target, rows, passes, ones: equal rows as one.

    Each of the ``rows`` is taken ``passes`` times, and ``ones`` of them once more.
    """
    docs = materialize(sized(docs, seed), "sized")
    counts = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    plans = materialize(plan(counts, weights, share), "mix")
    equal = docs.groupBy(*KEY, "size", "draw").agg(F.count("*").alias("rows"))
    planned = equal.join(
        plans,
        equal["source"].eqNullSafe(plans["source"]) & (equal["size"] == plans["size"]),
    ).select(
        "doc_id", equal["source"], "sha", equal["size"], "draw", "rows", "source_size", "target", "n", "passes", "extra"
    )

    # Documents of one size are ranked by their draw: in slices of the draw, so that a size held
    # by very many documents is not ranked in one task.
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / ranked))
    sliced = planned.withColumn("slice", F.floor(F.col("draw") * slices))
    choosing = sliced.where("extra > 0 and extra < n")
    key = ["source", "size", "slice"]
    in_slice = choosing.groupBy(*key).agg(F.sum("rows").alias("held"))
    earlier = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = in_slice.select(
        *key, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset")
    )
    until = Window.partitionBy(*key).orderBy("draw", "doc_id", "sha").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranks = choosing.withColumn("rank", F.sum("rows").over(until)).alias("c")
    left = F.col("extra") - F.col("offset") - F.col("rank") + F.col("rows")
    chosen = ranks.join(
        offsets.alias("o"),
        F.col("c.source").eqNullSafe(F.col("o.source"))
        & (F.col("c.size") == F.col("o.size"))
        & (F.col("c.slice") == F.col("o.slice")),
    ).select("c.*", F.greatest(F.lit(0), F.least("rows", left)).cast("long").alias("ones"))
    settled = sliced.where("not (extra > 0 and extra < n)").withColumn(
        "ones", F.when(F.col("extra") > 0, F.col("rows")).otherwise(F.lit(0)).cast("long")
    )
    columns = [*KEY, "size", "source_size", "target", "rows"]

    def taken(column: str):
        return F.when(F.col("size") > 0, F.col(column)).otherwise(F.lit(0)).cast("long").alias(column)

    columns += [taken("passes"), taken("ones")]
    return chosen.select(*columns).unionByName(settled.select(*columns))


def decide(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 0, ranked: int = RANKED
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    decided = decide_rows(docs, weights, share, seed, ranked)
    each = decided.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    copies = F.col("passes") + (F.col("row") <= F.col("ones")).cast("long")
    return each.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 0, ranked: int = RANKED
) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is two rows, columns unchanged.

    Every row is taken by its own copies.  Of rows equal in id, source and text some may be taken once
    more than the others; which ones, the other columns decide.
    """
    decided = decide_rows(docs, weights, share, seed, ranked).where("passes + ones > 0")
    wanted = materialize(decided.select(*KEY, "rows", "passes", "ones"), "taken")
    sha, times, place, own_id, own_source, own_sha = (
        free_name(docs, name) for name in ("sha", "copies", "place", "taken_id", "taken_source", "taken_sha")
    )
    keyed = docs.withColumn(sha, digest("text"))

    def taken(some: DataFrame) -> DataFrame:
        some = some.select(
            F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("sha").alias(own_sha),
            F.struct("passes", "ones").alias(times),
        )
        same_row = (
            keyed["doc_id"].eqNullSafe(some[own_id])
            & keyed["source"].eqNullSafe(some[own_source])
            & (keyed[sha] == some[own_sha])
        )
        return keyed.join(some, same_row).drop(own_id, own_source, own_sha)

    # At most one group of equal rows for each source and size is taken unevenly; it alone is ranked.
    uneven = (F.col("ones") > 0) & (F.col("ones") < F.col("rows"))
    equal_rows = Window.partitionBy("doc_id", "source", sha).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    alike = taken(wanted.where(~uneven)).withColumn(place, F.lit(1))
    apart = taken(materialize(wanted.where(uneven), "uneven")).withColumn(place, F.row_number().over(equal_rows))
    one = (F.col(place) <= F.col(f"{times}.ones")).cast("long")
    repeated = alike.unionByName(apart).withColumn(times, F.col(f"{times}.passes") + one)
    repeated = repeated.where(F.col(times) > 0).drop(sha, place)
    return repeated.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(times)
