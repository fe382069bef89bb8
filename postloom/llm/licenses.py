"""Licence scan: sparse word n-gram logistic regressions over paragraphs, confirmed by templates.

A paragraph is a line.  Its words that name licences, word pairs and triples are joined with the
weights of one logistic regression for each family, and summed by paragraph.  A family whose chance is
above a half is a prediction, so that a line may name several; what no family claims is the unknown
class, whose chance is that of all families being absent.  A prediction counts when the paragraph
also agrees with a template of that family, a notice or a name.  N-grams without a weight vanish in the
join, so only paragraphs that resemble a notice are ever grouped; their texts are not shuffled, equal
paragraphs are one group, and the weights (a few thousand rows, bounded by the wording) are broadcast.

The model is fitted on the driver: notices, cut and framed by chance, and names in phrases, alone and
two by two, against about ``sample`` distinct paragraphs of the corpus (those with the smallest
hashes, of at most ``LONGEST`` characters) and wording that is near to a notice.  Left-out rows set the
temperature, which calibrates the chances and with them the unknown class.

Defined cases: NULL and empty texts have no paragraphs; a document has one row per row of the table,
licences as a sorted array, empty if there are none; repeated rows and ids give equal rows;
paragraphs may have any length.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import bound, lit_rows
from postloom.llm.license_texts import DOUBLE_PHRASES, NAMES, NOTICES, OTHER, PHRASES
from postloom.llm.shared import materialize

# Letters and numbers are words of their own, so that "GPLv3", "GPL v3" and "Apache-2.0" read alike.
TOKEN = r"[a-z]+|[0-9]+(?:[.][0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE = 2000
# Characters of the longest paragraph that the model is fitted on; all are scanned.
LONGEST = 2000
# Share of the word pairs of the paragraph or a notice, whichever has fewer, that must agree;
# templates of fewer pairs than SHORT must be there whole.
AGREE = 0.6
SHORT = 6
FAMILIES = tuple(NOTICES)
# Weights below are left out of the model.
SPARSE = 0.05
# Distinct licence paragraphs that are broadcast at most; beyond, paragraphs are looked up by a shuffle.
BROADCAST_PARAGRAPHS = 200_000


def tokens(paragraph: str) -> list[str]:
    return re.findall(TOKEN, paragraph.translate(str.maketrans(UPPER, LOWER)))


def grams(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def parts(words: list[str]) -> set[str]:
    """What a template is compared by: its word pairs, or its only word."""
    return grams(words, (2,)) or set(words)


def templates() -> list[dict]:
    """Family, parts and share of them that must agree, of every notice and name."""
    found = []
    for family in FAMILIES:
        for wording in NOTICES[family] + NAMES.get(family, ()):
            words = tokens(wording)
            held = sorted(parts(words[1:] if words[0] in ("a", "the") else words))
            found.append({"family": family, "parts": held, "need": 1.0 if len(held) < SHORT else AGREE})
    return found


def agreement(a: set[str], b: set[str]) -> float:
    """Share of the parts of the smaller set that are in both."""
    return len(a & b) / max(min(len(a), len(b)), 1)


@dataclass(frozen=True)
class Model:
    """Per n-gram, weights of the families, already divided by the temperature; ``bias`` likewise."""

    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]

    def chances(self, paragraph: str) -> np.ndarray:
        """Chance of each family."""
        score = np.array(self.bias)
        for gram in grams(tokens(paragraph)):
            score = score + np.array(self.weights.get(gram, (0.0,) * len(FAMILIES)))
        return _logistic(score)

    def unknown(self, paragraph: str) -> float:
        """Chance that the paragraph names no family."""
        return float(np.prod(1 - self.chances(paragraph)))


def examples(sample: list[str], seed: int) -> tuple[list[set[str]], np.ndarray]:
    """N-gram sets and the families of each: notices whole, cut and framed, names in phrases, pairs
    of either, and paragraphs and wording without any."""
    r = random.Random(seed)
    place = {family: k for k, family in enumerate(FAMILIES)}
    fillers = [w for p in sample[:200] for w in tokens(p)[:20]] or ["word"]
    found: list[tuple[list[str], tuple[int, ...]]] = []

    def framed(words: list[str]) -> list[str]:
        frame = [[r.choice(fillers) for _ in range(r.randint(0, 6))] for _ in range(2)]
        return frame[0] + words + frame[1]

    def one(family: str) -> list[str]:
        """A notice or a name in a phrase."""
        if family not in NAMES or r.random() < 0.4:
            return tokens(r.choice(NOTICES[family]))
        return tokens(r.choice(PHRASES).format(r.choice(NAMES[family])))

    for family, notices in NOTICES.items():
        for words in map(tokens, notices):
            found.append((words, (place[family],)))
            for _ in range(8):
                start, end = 0, len(words)
                if len(words) > 14:
                    start = r.randint(0, len(words) - 12)
                    end = r.randint(start + 10, len(words))
                found.append((framed(words[start:end]), (place[family],)))
    for family, names in NAMES.items():
        for name in names:
            if len(tokens(name)) > 1:
                found += [(tokens(name), (place[family],))] * 10
            for phrase in PHRASES:
                words = tokens(phrase.format(name))
                found.append((words if r.random() < 0.5 else framed(words), (place[family],)))
        for _ in range(40):
            other = r.choice([f for f in NAMES if f != family])
            both = (place[family], place[other])
            phrase, pair = r.choice(DOUBLE_PHRASES), [r.choice(names), r.choice(NAMES[other])]
            r.shuffle(pair)
            found.append((tokens(phrase.format(*pair)), both))
            found.append((framed(one(family) + one(other)), both))
    for _ in range(60):  # whole licences in one line
        several = r.sample(FAMILIES, r.randint(2, 3))
        words = [w for f in several for n in NOTICES[f] for w in tokens(n)]
        found.append((words, tuple(place[f] for f in several)))
    known = [set(t["parts"]) for t in templates() if len(t["parts"]) >= 2]
    for words in map(tokens, sample):
        # Wording that the sample holds of a licence is no example of the unknown class.
        own = grams(words, (2,))
        if not any(len(own & t) >= len(t) * AGREE for t in known):
            found.append((words, ()))
    found += [(framed(tokens(p)) if k else tokens(p), ()) for p in OTHER for k in range(5)]
    # Phrases with a word in the name's place that names nothing, and names outside of any phrase.
    found += [(tokens(p.format(r.choice(fillers))), ()) for p in PHRASES for _ in range(8)]
    single = [t for names in NAMES.values() for t in map(tokens, names) if len(t) == 1]
    found += [([r.choice(fillers), *r.choice(single), r.choice(fillers)], ()) for _ in range(300)]
    r.shuffle(found)
    goal = np.zeros((len(found), len(FAMILIES)), np.float32)
    for row, (_, families) in zip(goal, found):
        row[list(families)] = 1
    return [grams(words) for words, _ in found], goal


def known_grams(rows: list[set[str]], goal: np.ndarray, sample: list[str]) -> list[str]:
    """N-grams with a weight: pairs and triples that several licence examples hold, and words of the
    names that are in few paragraphs, so that a common word never drags all paragraphs along."""
    often: dict[str, int] = {}
    for one, families in zip(rows, goal.any(axis=1)):
        for gram in one if families else ():
            often[gram] = often.get(gram, 0) + 1
    common: dict[str, int] = {}
    for paragraph in sample:
        for word in set(tokens(paragraph)):
            common[word] = common.get(word, 0) + 1
    usual = {w for wording in (*PHRASES, *DOUBLE_PHRASES) for w in tokens(wording)}
    words = {w for names in NAMES.values() for name in names for w in tokens(name) if w.isalpha() and len(w) > 2}
    words = {w for w in words - usual if common.get(w, 0) <= 0.005 * len(sample)}
    return sorted(g for g, n in often.items() if n >= 3 and (" " in g or g in words))


def fit(sample: list[str], seed: int = 0, steps: int = 300, decay: float = 1e-5) -> Model:
    """Logistic regressions by Adam over all rows; every fifth row is kept for the temperature."""
    rows, goal = examples(sample, seed)
    known = known_grams(rows, goal, sample)
    place = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1), np.float32)
    x[:, -1] = 1
    for row, one in zip(x, rows):
        row[[place[g] for g in one if g in place]] = 1
    held = np.arange(len(rows)) % 5 == 4
    train, aim = x[~held], goal[~held]
    w = np.zeros((x.shape[1], goal.shape[1]), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        slope = train.T @ (_logistic(train @ w) - aim) / len(train) + decay * w
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    w[:-1][np.abs(w[:-1]).max(axis=1) < SPARSE] = 0
    logits = x[held] @ w

    def loss(t: float) -> float:
        p = np.clip(_logistic(logits / t), 1e-9, 1 - 1e-9)
        return -float(np.log(np.where(goal[held] > 0, p, 1 - p)).mean())

    # Rounding keeps the plan's constant small; a weight is then off by 0.00005 at most.
    w = np.round((w / min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)).astype(float), 4)
    weights = {g: tuple(map(float, row)) for g, row in zip(known, w) if row.any()}
    return Model(weights, tuple(map(float, w[-1])))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id and every paragraph that is not empty, with two hashes of it."""
    lines = F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    return (
        docs.select("doc_id", lines.alias("paragraph"))
        .where("paragraph <> ''")
        .select("*", F.xxhash64("paragraph").alias("h1"), F.hash("paragraph").alias("h2"))
    )


def words_of(paragraph: str) -> Column:
    return F.regexp_extract_all(F.translate(F.col(paragraph), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def grams_of(words: Column, n: int) -> Column:
    """N-grams of an array of words, in their order."""
    if n == 1:
        return words
    last = F.size(words) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model fitted on about ``sample`` distinct paragraphs, those with the smallest hashes.

    The bound on the hash comes from the number of distinct paragraphs, so the driver receives
    about ``sample`` rows of at most ``LONGEST`` characters, however many there are.
    """
    short = paragraphs(docs).where(F.length("paragraph") <= LONGEST).select("paragraph", "h1")
    distinct = short.agg(F.approx_count_distinct("h1")).first()[0]
    most = -(1 << 63) + min((1 << 64) * sample // max(distinct, 1), (1 << 64) - 1)
    rows = short.where(F.col("h1") <= F.lit(most)).select("paragraph").distinct().collect()
    return fit(sorted(row["paragraph"] for row in rows))


def _constant(docs: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small constant table, as one literal of the plan."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return docs.sparkSession.range(1).select(F.explode(parsed).alias("row")).select("row.*")


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """Hashes of the distinct paragraphs with ``families``: those whose chance is above a half."""
    rows = [{"gram": g, "weights": w} for g, w in model.weights.items()]
    weights = F.broadcast(_constant(docs, rows, "gram: string, weights: array<double>"))
    every = F.concat(*[grams_of(F.col("words"), n) for n in (1, 2, 3)])
    found = (
        paragraphs(docs)
        .select("h1", "h2", words_of("paragraph").alias("words"))
        .select("h1", "h2", F.explode(every).alias("gram"))
        .join(weights.select("gram"), "gram", "left_semi")
        .distinct()
        .join(weights, "gram")
    )
    sums = found.groupBy("h1", "h2").agg(
        *[F.sum(F.get("weights", F.lit(k))).alias(f"w{k}") for k in range(len(FAMILIES))]
    )
    chances = [
        F.struct(F.lit(f).alias("family"), (1 / (1 + F.exp(-(F.col(f"w{k}") + model.bias[k])))).alias("chance"))
        for k, f in enumerate(FAMILIES)
    ]
    likely = F.filter(F.array(*chances), lambda c: c["chance"] > 0.5)
    return sums.select("h1", "h2", likely.alias("families")).where(F.size("families") > 0)


def confirmed(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph, ``families`` (family, chance, agreement) of every licence paragraph."""
    found = materialize(predicted(docs, model), "predicted")
    found = F.broadcast(found) if found.count() <= BROADCAST_PARAGRAPHS else found
    wording = lit_rows(templates())
    at = paragraphs(docs).join(found, ["h1", "h2"])

    def agreements(words: Column, pairs: Column) -> Column:
        """Families with their best agreement, of those that have one."""

        def agrees(template: Column) -> Column:
            parts = template["parts"]
            common = F.size(F.array_intersect(parts, pairs)) + F.size(F.array_intersect(parts, words))
            share = common / F.greatest(F.least(F.size(pairs), F.size(parts)), F.lit(1))
            return F.when(share >= template["need"], share)

        def with_agreement(c: Column) -> Column:
            own = F.filter(wording, lambda t: t["family"] == c["family"])
            best = F.array_max(F.transform(own, agrees))
            return F.struct(c["family"].alias("family"), c["chance"].alias("chance"), best.alias("agreement"))

        return F.filter(F.transform("families", with_agreement), lambda c: c["agreement"].isNotNull())

    # Bound, so that words and pairs are made once for a paragraph and not for every template.
    families = bound(
        words_of("paragraph"),
        lambda words: bound(F.array_distinct(grams_of(words, 2)), lambda pairs: agreements(words, pairs)),
    )
    return at.select("doc_id", "paragraph", families.alias("families")).where(F.size("families") > 0)


def scan_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph, family, chance, agreement: a row for every family of a licence paragraph."""
    return confirmed(docs, model).select("doc_id", "paragraph", F.inline("families"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, licenses, n_license_paragraphs: one row per row of ``docs``."""
    lines = confirmed(docs, model or train(docs)).select("doc_id", F.col("families.family").alias("families"))
    found = lines.groupBy("doc_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("families")))).alias("licenses"),
        F.count("*").alias("n"),
    )
    found = found.withColumnRenamed("doc_id", "found_id")
    rows = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return rows.select(
        "doc_id",
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_paragraphs"),
    )
