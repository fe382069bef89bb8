"""Tables in hash buckets that split as they grow.

A slot (modulus, bucket) holds the rows whose hash leaves ``bucket`` when divided by ``modulus``.  The slots of
a table divide all hashes among them; a slot that would outgrow its target is written as two, four, ...
slots with as many times the modulus, while the others stay as they are.  The slots are recorded with the
table, so no later setting can look for a row in the wrong place.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ("modulus", "bucket")


@dataclass(frozen=True)
class Slot:
    modulus: int
    bucket: int
    folder: str | None = None
    rows: int = 0

    @property
    def place(self) -> tuple[int, int]:
        return self.modulus, self.bucket


def first_slots(buckets: int) -> list[Slot]:
    return [Slot(buckets, b) for b in range(buckets)]


def placed(df: DataFrame, slots: Iterable[Slot], hashed: Column) -> DataFrame:
    """``df`` with the modulus and bucket of the slot of each row.

    Splitting doubles a modulus, so there are few different ones; the slots themselves, one row each,
    are broadcast.
    """
    places = sorted(s.place for s in slots)
    moduli = sorted({m for m, _ in places})
    if len(moduli) == 1 and len(places) == moduli[0]:
        return df.withColumns({"modulus": F.lit(moduli[0]), "bucket": F.pmod(hashed, F.lit(moduli[0])).cast("int")})
    candidates = F.array(
        *[F.struct(F.lit(m).alias("modulus"), F.pmod(hashed, F.lit(m)).cast("int").alias("bucket")) for m in moduli]
    )
    directory = df.sparkSession.createDataFrame(places, "modulus int, bucket int")
    each = df.withColumn("__place", F.explode(candidates)).select("*", "__place.*").drop("__place")
    return each.join(F.broadcast(directory), list(PLACE))


def rows_by_slot(df: DataFrame) -> dict[tuple[int, int], int]:
    """Rows of each slot that occurs in a :func:`placed` frame: at most one row per slot is collected."""
    return {(r.modulus, r.bucket): r["count"] for r in df.groupBy(*PLACE).count().collect()}


def chosen(slots: Iterable[Slot], places: Iterable[tuple[int, int]]) -> list[Slot]:
    wanted = set(places)
    return [s for s in slots if s.place in wanted]


def read_slots(spark: SparkSession, slots: Iterable[Slot]) -> DataFrame | None:
    """The rows of these slots, from their own files; None if they have none."""
    folders = sorted(s.folder for s in slots if s.folder)
    return spark.read.parquet(*folders) if folders else None


def split(slots: Iterable[Slot], arriving: dict[tuple[int, int], int], target: int) -> list[Slot]:
    """Empty slots in place of ``slots``, so that none is expected to hold more than ``target`` rows."""
    found = []
    for slot in slots:
        expected, parts = slot.rows + arriving.get(slot.place, 0), 1
        while expected > parts * target:
            parts *= 2
        found += [Slot(slot.modulus * parts, slot.bucket + k * slot.modulus) for k in range(parts)]
    return found


def write_slots(df: DataFrame, slots: list[Slot], hashed: Column, folder: str, *order: Column | str) -> list[Slot]:
    """Write all rows of ``slots`` to a new folder; returns the slots with their folders and row counts.

    Rows are balanced over tasks by their bytes: small slots share a task, a large one takes several.
    """
    if not slots:
        return []
    spark = df.sparkSession
    dealt = placed(df, slots, hashed).hint("rebalance", *[F.col(c) for c in PLACE])
    rows = dealt.sortWithinPartitions(*PLACE, *order)
    rows.write.mode("errorifexists").partitionBy(*PLACE).parquet(folder)
    counts = rows_by_slot(spark.read.schema(dealt.select(*PLACE).schema).parquet(folder))  # from file footers
    return [
        Slot(*s.place, f"{folder}/modulus={s.modulus}/bucket={s.bucket}" if s.place in counts else None, counts.get(s.place, 0))
        for s in slots
    ]
