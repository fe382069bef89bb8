"""Duplicate removal: the first posting wins, over three keys at once.

The rule is sequential: going through the postings in order, one is kept unless it shares its
link, fingerprint or content hash with a posting already KEPT.  Three independent "first per key"
filters would drop too much, since a dropped posting must not block others.

The parallel form works in rounds.  A posting that is the first of all three of its key groups is
certainly kept; whatever shares a key with it is certainly dropped; the rest goes into the next
round.  Per round this takes one map-side combined minimum per key, so a key held by a third of
all rows costs one row per map task, and joins that only look keys up, so that adaptive execution
may split a hot key over many tasks.  No two rows are ever paired.

Such rounds decide one posting after the other along a chain, where each shares a key with the next.
Whether a posting is kept that comes second in some of its groups, always after the same one, and first
in the others, is the opposite of that one's fate; so chains of such postings are decided
together, by pointer jumping to the one they begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from postloom.functions import batches
from postloom.functions.keys import with_keys
from postloom.session import materialize, written

KEYS = ("link", "fingerprint", "content_hash")
# Rows of keys, of at most 500 characters each, that are broadcast: below 200 MB in memory.
SMALL_BATCH_ROWS = 100_000


def _firsts_of_all_keys(undecided: DataFrame) -> DataFrame:
    """(kind, key, seq) of the postings that come first in each of their key groups."""
    tagged = undecided.select(
        "seq",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(KEYS)])
        ).alias("k"),
    )
    firsts = tagged.groupBy("k.kind", "k.key").agg(F.min("seq").alias("seq"))
    won = F.bit_or(F.expr("shiftleft(1, kind)")).over(Window.partitionBy("seq"))
    return firsts.withColumn("won", won).filter(F.col("won") == 2 ** len(KEYS) - 1).drop("won")


def _kept_along_chains(undecided: DataFrame) -> DataFrame:
    """(kind, key, seq) of postings that are first in all their groups, and of all that are kept along the
    chains that begin with these."""
    tagged = undecided.select(
        "seq", F.posexplode(F.array(*KEYS)).alias("kind", "key")
    )
    # A rank limit is applied inside the map tasks too, so a hot key is two rows of each.
    rank = F.row_number().over(Window.partitionBy("kind", "key").orderBy("seq"))
    groups = tagged.withColumn("rank", rank).where("rank <= 2").groupBy("kind", "key").agg(
        F.min("seq").alias("first"), F.max("seq").alias("second")
    )
    members = F.array(
        F.struct(F.col("first").alias("seq"), F.lit(None).cast("long").alias("after")),
        F.when(F.col("second") > F.col("first"), F.struct(F.col("second").alias("seq"), F.col("first").alias("after"))),
    )
    roles = groups.select(F.explode(F.array_compact(members)).alias("role")).groupBy("role.seq").agg(
        F.count(F.lit(1)).alias("groups"), F.min("role.after").alias("after"), F.max("role.after").alias("last")
    )
    whole = (F.col("groups") == len(KEYS)) & (F.col("after").eqNullSafe(F.col("last")))
    links, begun = written(roles.where(whole).select("seq", "after", F.lit(False).alias("dropped")), "chains")
    while begun:
        ahead = links.select(
            F.col("seq").alias("after"), F.col("after").alias("next"), F.col("dropped").alias("turned")
        )
        # Chains that begin with a posting that cannot be decided yet end here.
        moved = links.join(ahead, "after").select(
            "seq", F.col("next").alias("after"), (F.col("dropped") == F.col("turned")).alias("dropped")
        )
        seen = Observation()
        links = materialize(
            links.where("after IS NULL").unionByName(moved).observe(seen, F.count("after").alias("open")), "chains"
        )
        begun = seen.get["open"]
    kept = links.where("after IS NULL AND NOT dropped").select("seq")
    return undecided.join(kept, "seq", "left_semi").select(
        F.posexplode(F.array(*KEYS)).alias("kind", "key"), "seq"
    )


def check_order(numbered: DataFrame) -> None:
    """Fail where ``seq`` is no order: a number is missing or given twice."""
    rows, numbers = numbered.agg(F.count(F.lit(1)), F.count_distinct("seq")).first()
    if rows != numbers:
        raise ValueError(f"seq must number the postings: {rows} rows have {numbers} different numbers")


def kept_sequence(
    keyed: DataFrame, tail_rows: int = 10_000, tail_after: int = 2
) -> DataFrame:
    """``seq`` of the postings to keep, from rows of (seq, link, fingerprint, content_hash).

    ``seq`` is a unique total order; otherwise this fails.  Random input needs a handful of
    rounds.  After ``tail_after`` rounds a remainder of at most ``tail_rows`` rows is decided by the
    sequential rule in one task; a larger one goes on in rounds that decide whole chains, however many it
    takes: each one decides at least its first posting.  Rows are counted as they are written.
    """
    check_order(keyed)
    # A missing key counts as a value of its own, as joins would never match it.
    keyed = keyed.select("seq", *[F.coalesce(k, F.lit("\0")).alias(k) for k in KEYS])
    # Rows equal in all keys share one fate: only the first can be kept.
    undecided, left = written(keyed.groupBy(*KEYS).agg(F.min("seq").alias("seq")), "dedupe-open")
    kept: list[DataFrame] = []
    rounds = 0
    while left:
        if rounds >= tail_after and left <= tail_rows:
            ordered = undecided.coalesce(1).sortWithinPartitions("seq")
            kept.append(materialize(ordered.mapInPandas(batches.first_in_order, "seq long"), "dedupe-kept"))
            break
        decide = _firsts_of_all_keys if rounds < tail_after else _kept_along_chains
        winners, won = written(decide(undecided), "dedupe-kept", "kind")
        kept.append(winners.filter("kind = 0").select("seq"))
        rest = undecided
        for kind, key in enumerate(KEYS):
            taken = winners.filter(F.col("kind") == kind).select(F.col("key").alias(key))
            rest = rest.join(F.broadcast(taken) if won <= SMALL_BATCH_ROWS else taken, key, "left_anti")
        undecided, left = written(rest.select("seq", *KEYS), "dedupe-open")
        rounds += 1
    result = undecided.select("seq").limit(0) if not kept else kept[0]
    for more in kept[1:]:
        result = result.unionByName(more)
    return result


def dedupe_batch(postings: DataFrame, **tail) -> DataFrame:
    """Postings without duplicates, with both keys added; ``seq`` gives the order of arrival.

    The keys are computed once, into a narrow table; the texts themselves move once, when the
    kept rows are picked by their unique ``seq``.
    """
    if not set(KEYS) <= set(postings.columns):
        keys = materialize(with_keys(postings).select("seq", *KEYS), "dedupe-keys")
        kept = keys.drop("link").join(kept_sequence(keys, **tail), "seq", "left_semi")
        return postings.join(kept, "seq")
    kept = kept_sequence(postings.select("seq", *KEYS), **tail)
    return postings.join(kept, "seq", "left_semi")


# --- looking keys up in the store ------------------------------------------------------------------

def existing_keys(
    store: DataFrame, keys: DataFrame, key: str, as_of=None, window_days: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Distinct values of ``key`` that are both in ``keys`` and stored; NULL and '' never match.

    With ``window_days`` only rows created in that many days before ``as_of`` count.  A small
    batch is broadcast, so the store is filtered where it lies.  Otherwise both sides are first
    reduced to distinct values (combined map-side), which also leaves no hot key to the join.
    """
    wanted = keys.select(key).filter(F.length(key) > 0)
    stored = store.filter(F.length(key) > 0)
    if window_days is not None:
        since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(window_days))
        stored = stored.filter(F.col("created_at") >= since)
    stored = stored.select(key)
    if small is None:
        wanted, rows = written(wanted.distinct(), "wanted-keys")
        small = rows <= SMALL_BATCH_ROWS
    if small:
        return stored.join(F.broadcast(wanted.distinct()), key, "left_semi").distinct()
    return stored.distinct().join(wanted.distinct(), key, "left_semi")


def drop_stored(kept: DataFrame, store: DataFrame) -> DataFrame:
    """Postings none of whose keys is stored."""
    keys, rows = written(kept.select("seq", *KEYS), "batch-keys")
    small = rows <= SMALL_BATCH_ROWS
    fresh = kept
    for key in KEYS:
        fresh = fresh.join(existing_keys(store, keys, key, small=small), key, "left_anti")
    return fresh


def filter_new(postings: DataFrame, store: DataFrame) -> DataFrame:
    """The batch without its own duplicates and without anything stored already."""
    return drop_stored(dedupe_batch(postings), store)


def find_duplicates(store: DataFrame, postings: DataFrame) -> DataFrame:
    """Stored rows sharing a link, fingerprint or content hash with any posting.

    Stored rows are flagged, not paired with every posting, so a hot key cannot multiply rows.
    The lookups run on the distinct key triples of the store, one equi-join per key against the
    distinct keys of the postings; the rows themselves move once, to pick up their flags.
    """
    flagged = store.select(*KEYS).distinct()
    for key in KEYS:
        known = postings.filter(F.length(key) > 0).select(key).distinct()
        flagged = flagged.join(known.withColumn(f"same_{key}", F.lit(True)), key, "left")
    flags = {f"same_{k}": F.coalesce(f"same_{k}", F.lit(False)) for k in KEYS}
    hits = flagged.withColumns(flags).filter(" OR ".join(flags)).withColumnsRenamed({k: f"hit_{k}" for k in KEYS})
    same = [F.col(k).eqNullSafe(F.col(f"hit_{k}")) for k in KEYS]
    return store.join(hits, same).drop(*[f"hit_{k}" for k in KEYS])


def duplicates_by_posting(store: DataFrame, postings: DataFrame) -> DataFrame:
    """What each posting repeats: one row per posting that shares a key with a stored row.

    For every key the number of stored rows with it, and the smallest id among them as their
    representative (0 and NULL without any).  Stored rows are first counted per key, map-side combined, so
    a key held by many of them is one row to the join and no two rows are paired.  ``seq`` numbers the
    postings.
    """
    found = postings.select("seq", *KEYS)
    for key in KEYS:
        classes = store.filter(F.length(key) > 0).groupBy(key).agg(
            F.count(F.lit(1)).alias(f"{key}_rows"), F.min("id").alias(f"{key}_id")
        )
        found = found.join(classes, key, "left")
    counts = {f"{k}_rows": F.coalesce(f"{k}_rows", F.lit(0)) for k in KEYS}
    columns = [c for k in KEYS for c in (f"{k}_rows", f"{k}_id")]
    return found.withColumns(counts).filter(" OR ".join(f"{k}_rows > 0" for k in KEYS)).select("seq", *columns)
