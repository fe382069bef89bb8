"""Match score with its explanation, and the scored row that goes into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.functions.features import contract_in, location_in, parse_salary
from postloom.functions.keys import with_keys
from postloom.functions.text import (
    bound,
    distinct_ignoring_case,
    found_in,
    lit_array,
    lit_rows,
    normalize_text,
    normalized,
    signs_of,
    spellings_in,
)
from postloom.profile import MatchProfile, TermDictionary, canonical_term, squeeze


def canonical_tech(name: Column) -> Column:
    """Dictionary entry a technology name stands for, else the squeezed name."""
    owner: dict[str, str] = {}
    for entry, spellings in v.TECH_ALIASES.items():
        for spelling in (entry, *spellings):
            owner.setdefault(spelling, entry)
    table = F.create_map(*[F.lit(x) for pair in owner.items() for x in pair])
    wanted = F.lower(normalize_text(name))
    return F.coalesce(F.try_element_at(table, wanted), wanted)


def seniority_factor(found: Column, wanted: str) -> Column:
    wanted = (wanted or "any").strip().lower()
    if wanted == "any":
        return F.lit(1.0)
    level = F.lower(F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown")))
    factor = F.when(level == "unknown", v.SENIORITY_UNKNOWN_FACTOR).when(level == wanted, 1.0)
    for other, value in v.SENIORITY_FACTORS.get(wanted, {}).items():
        factor = factor.when(level == other, value)
    return factor.otherwise(v.SENIORITY_OTHER_FACTOR)


class _Wishes:
    """A profile turned into dictionary entries, once, on the driver."""

    def __init__(self, profile: MatchProfile):
        self.must = [canonical_term(t) for t in profile.must_have if t.strip()]
        nice = [canonical_term(t) for t in profile.nice_to_have if t.strip()]
        self.techs = list(dict.fromkeys([*self.must, *nice]))
        self.dictionary = TermDictionary.of(self.techs, v.REASON_DISPLAY)
        self.spellings = self.dictionary.spellings()
        self.keywords = [k for k in profile.negative_keywords if k.strip()]
        self.places = [p for p in profile.preferred_locations if p.strip()]
        self.context = sorted({squeeze(x) for x in (*self.keywords, *self.places)})
        self.profile = profile

    def weight(self, tech: str) -> float:
        return v.MUST_HAVE_FACTOR if tech in self.must else 1.0

    def table(self, fields) -> Column:
        """Wished technologies as a constant: name, signs, weight per field, best possible sum."""
        best = sum(weight for _, weight in fields)
        return lit_rows(
            [
                {
                    "name": self.dictionary.name(t),
                    "signs": signs_of(self.dictionary.entries[t], self.spellings),
                    **{name: weight * self.weight(t) for name, weight in fields},
                    "best": best * self.weight(t),
                }
                for t in self.techs
            ]
        )

    def bad_words(self, found: Column) -> Column:
        """Negative keywords shown by ``found``, in their order."""
        if not self.keywords:
            return lit_array([])
        table = lit_rows([{"word": k, "signs": signs_of([k], self.context)} for k in self.keywords])
        shown = bound(found, lambda f: F.filter(table, lambda k: F.arrays_overlap(f, k["signs"])))
        return F.transform(shown, lambda k: k["word"])

    def picked(self, scores: Column, techs, hit: bool) -> Column:
        """Names of those ``techs`` that did (or did not) score, in their order."""
        if not techs:
            return lit_array([])
        places = lit_rows([{"at": self.techs.index(t), "name": self.dictionary.name(t)} for t in techs])
        chosen = bound(
            scores, lambda s: F.filter(places, lambda p: (F.get(s, p["at"]) > 0) == F.lit(hit))
        )
        return F.transform(chosen, lambda p: p["name"])


def scoring_texts(df: DataFrame) -> DataFrame:
    """``df`` with the lower-cased, normalised texts a score looks at."""
    flat = {
        "__title": F.col("title"),
        "__stack": F.array_join(F.col("stack"), " "),
        "__description": F.col("description"),
        "__location": F.col("location"),
    }
    return df.withColumns({n: F.lower(normalized(c)) for n, c in flat.items()})


def tech_scores(df: DataFrame, profile: MatchProfile, out: str = "tech_scores") -> DataFrame:
    """Add one score per wished technology: title, stack and description hits with weights."""
    return _with_tech_scores(scoring_texts(df), _Wishes(profile), out).select(*df.columns, out)


def _with_tech_scores(texts: DataFrame, w: _Wishes, out: str) -> DataFrame:
    """The same on prepared texts; every text is scanned once for all technologies together."""
    fields = (
        ("__title", v.TITLE_WEIGHT), ("__stack", v.STACK_WEIGHT),
        ("__description", v.DESCRIPTION_WEIGHT),
    )
    if not w.techs:
        return texts.withColumn(out, F.array().cast("array<double>"))
    found = F.struct(*[spellings_in(F.col(n), w.spellings).alias(n) for n, _ in fields])

    def scores(found: Column) -> Column:
        def score(tech: Column) -> Column:
            hits = [
                F.when(F.arrays_overlap(found[n], tech["signs"]), tech[n]).otherwise(0.0)
                for n, _ in fields
            ]
            return F.least(sum(hits, F.lit(0.0)), tech["best"])

        return F.transform(w.table(fields), score)

    return texts.withColumn(out, bound(found, scores))


def base_score(scores: Column, profile: MatchProfile) -> Column:
    """Share of the best possible sum, in percent; ``scores`` comes from :func:`tech_scores`."""
    w = _Wishes(profile)
    weights = v.TITLE_WEIGHT + v.STACK_WEIGHT + v.DESCRIPTION_WEIGHT
    best = 0.0
    for tech in w.techs:
        best += weights * w.weight(tech)
    if not best:
        return F.lit(0.0)
    return F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.lit(best) * 100.0


def _listed(names: Column) -> Column:
    return F.array_join(names, ", ")


def _judged(df: DataFrame, profile: MatchProfile, w: _Wishes) -> DataFrame:
    """``df`` with every ingredient of the score as a ``__`` column, each computed once."""
    if not {"salary_min", "salary_max", "remote_type"} <= set(df.columns):
        raise ValueError("scoring needs salary_min, salary_max and remote_type")
    scores = F.col("__scores")
    combined, found = F.col("__combined"), F.col("__context")
    near = found_in(found, w.places, w.context) if w.places else F.lit(False)
    return (
        _with_tech_scores(scoring_texts(df), w, "__scores")
        .withColumn("__combined", all_texts())
        .withColumns(
            {
                "__context": spellings_in(combined, w.context) if w.context else lit_array([]),
                "__remote": is_remote(combined),
                "__paid": is_paid(),
                "__factor": seniority_factor(F.col("seniority"), profile.seniority),
                "__base": base_score(scores, profile),
                "__matched": w.picked(scores, w.techs, True),
                "__missing": w.picked(scores, w.techs, False),
                "__missing_must": w.picked(scores, w.must, False),
            }
        )
        .withColumns(
            {
                "__near": near,
                "__bad_words": w.bad_words(found),
            }
        )
        .withColumns({"__bonus": bonus(), "__penalty": penalty(_not_remote(profile))})
    )


def all_texts() -> Column:
    """All of :func:`scoring_texts` as one text."""
    return F.concat_ws(" ", "__title", "__stack", "__description", "__location")


def is_remote(combined: Column) -> Column:
    stated = F.lower(normalize_text(F.col("remote_type"))).isin("remote", "remoto")
    return stated | combined.contains("remot")


def is_paid() -> Column:
    def paid(name: str) -> Column:
        return F.coalesce(F.col(name) != 0, F.lit(False))

    return paid("salary_min") | paid("salary_max")


def bonus() -> Column:
    """From ``__remote``, ``__near`` and ``__paid``."""

    def worth(test: str, value: float) -> Column:
        return F.when(F.col(test), value).otherwise(0.0)

    return worth("__remote", v.REMOTE_BONUS) + worth("__near", v.LOCATION_BONUS) + worth("__paid", v.SALARY_BONUS)


def _not_remote(profile: MatchProfile) -> Column:
    return ~F.col("__remote") if profile.remote_only else F.lit(False)


def penalty(not_remote: Column) -> Column:
    """From ``__paid``, ``__bad_words`` and ``__missing_must``."""

    def costs(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    return (
        costs(not_remote, v.NOT_REMOTE_PENALTY)
        + costs(~F.col("__paid"), v.NO_SALARY_PENALTY)
        + F.size("__bad_words") * v.NEGATIVE_KEYWORD_PENALTY
        + costs(F.size("__missing_must") > 0, v.MISSING_MUST_PENALTY)
    )


def context_adjustments(df: DataFrame, profile: MatchProfile | None = None) -> DataFrame:
    """Add ``bonus`` and ``penalty``: work model, place, salary, negative words, missing musts."""
    profile = profile or MatchProfile()
    judged = _judged(df, profile, _Wishes(profile))
    return judged.select(*df.columns, F.col("__bonus").alias("bonus"), F.col("__penalty").alias("penalty"))


def explanations(not_remote: Column) -> tuple[Column, Column]:
    """(positive, negative) reasons in their fixed order, from the ``__`` columns and ``seniority``."""
    factor = F.col("__factor")
    level = F.coalesce(F.nullif(F.col("seniority"), F.lit("")), F.lit(v.REASON_SENIORITY_UNKNOWN))

    def naming(text: str, names: str) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(text), _listed(F.col(names))))

    positive = [
        naming(v.REASON_FOUND, "__matched"),
        F.when(factor == 1, F.concat(F.lit(v.REASON_SENIORITY_FITS), level)),
        F.when(F.col("__remote"), v.REASON_REMOTE),
        F.when(F.col("__near"), v.REASON_LOCATION),
        F.when(F.col("__paid"), v.REASON_SALARY),
    ]
    negative = [
        naming(v.REASON_NOT_FOUND, "__missing"),
        naming(v.REASON_MISSING_MUST, "__missing_must"),
        F.when(factor == 0, F.concat(F.lit(v.REASON_SENIORITY_MISFIT), level)).when(
            factor != 1, F.concat(F.lit(v.REASON_SENIORITY_PENALTY), level)
        ),
        F.when(not_remote, v.REASON_NOT_REMOTE),
        F.when(~F.col("__paid"), v.REASON_NO_SALARY),
    ]
    words = F.transform("__bad_words", lambda k: F.concat(F.lit(v.REASON_NEGATIVE), k))
    return (
        distinct_ignoring_case(F.array_compact(F.array(*positive))),
        distinct_ignoring_case(F.concat(F.array_compact(F.array(*negative)), words)),
    )


def final_score() -> Column:
    raw = F.col("__base") * F.col("__factor") + F.col("__bonus") - F.col("__penalty")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)


def reasons_of(not_remote: Column) -> Column:
    return _reasons(
        F.col("score"), F.col("__matched"), F.col("__missing"), F.col("__factor"), *explanations(not_remote)
    )


def score_postings(df: DataFrame, profile: MatchProfile | None = None) -> DataFrame:
    """Add ``score`` (0 to 100, two decimals) and ``score_reasons``."""
    profile = profile or MatchProfile()
    w = _Wishes(profile)
    if not w.techs:
        nothing, none = lit_array([]), F.lit(0.0)
        reasons = _reasons(none, nothing, nothing, F.lit(1.0), nothing, lit_array([v.REASON_NO_STACK]))
        return df.withColumns({"score": none, "score_reasons": reasons})
    judged = _judged(df, profile, w)
    reasons = reasons_of(_not_remote(profile))
    return (
        judged.withColumn("score", final_score())
        .withColumn("score_reasons", reasons)
        .select(*df.columns, "score", "score_reasons")
    )


def score_profiles(df: DataFrame, profiles: dict[str, MatchProfile]) -> DataFrame:
    """One row per posting and profile: ``profile``, ``score`` and ``score_reasons`` added.

    The profiles are a small table kept by hand; their wishes become expressions, so postings
    are read once and no join is needed.
    """
    columns, scored = df.columns, df
    for i, (name, profile) in enumerate(profiles.items()):
        one = F.struct(F.lit(name).alias("profile"), F.col("score").cast("double").alias("score"), "score_reasons")
        scored = score_postings(scored, profile).withColumn(f"__profile_{i}", one).drop("score", "score_reasons")
    each = F.explode(F.array(*[F.col(f"__profile_{i}") for i in range(len(profiles))])).alias("__one")
    return scored.select(*columns, each).select(*columns, "__one.*")


def _reasons(value, matched, missing, factor, positive, negative) -> Column:
    return F.struct(
        value.alias("value"),
        matched.alias("matched_techs"),
        missing.alias("missing_techs"),
        factor.alias("seniority_factor"),
        positive.alias("positive_reasons"),
        negative.alias("negative_reasons"),
    )


def score_simple(df: DataFrame, wanted, seniority: str = "senior") -> DataFrame:
    """Score against a plain list of technologies: no must-haves, no context words."""
    plain = MatchProfile(
        must_have=(), nice_to_have=tuple(wanted), negative_keywords=(), preferred_locations=(),
        seniority=seniority,
    )
    return score_postings(df, plain)


def merge_raw_payload(payload: Column, description: Column) -> Column:
    """Source fields plus the description, unless they hold one already."""
    fields = F.coalesce(payload, F.create_map().cast("map<string,string>"))
    add = ~F.map_contains_key(fields, "description") & (F.length(description) > 0)
    return F.when(add, F.map_concat(fields, F.create_map(F.lit("description"), description))).otherwise(
        fields
    )


def build_payloads(df: DataFrame, profile: MatchProfile | None = None) -> DataFrame:
    """Scored rows for the store: given values win over those read from the description.

    The score looks at the posting as it came in, not at the values parsed here.
    """
    keyed = df if {"fingerprint", "content_hash"} <= set(df.columns) else with_keys(df)
    low = F.col("__low")  # the long text is lower-cased once for contract and place
    scored = score_postings(keyed, profile).withColumn("__low", F.lower("description")).withColumns(
        {
            "__salary": parse_salary(F.col("description")),
            "__place": location_in(F.col("location"), F.concat_ws(" ", F.lower("location"), low)),
            "__contract": contract_in(F.concat_ws(" ", F.lower("title"), low)),
        }
    )

    def given_or(name: str, parsed: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), parsed)

    def money(name: str) -> Column:
        # A number too long for the column cannot be a salary.
        parsed = F.col("__salary")[name].try_cast("decimal(12,2)")
        return F.coalesce(F.nullif(F.col(name), F.lit(0).cast("decimal(12,2)")), parsed)

    def cut(name: str, length: int) -> Column:
        return F.substring(F.nullif(F.col(name), F.lit("")), 1, length)

    place = F.col("__place")
    return scored.select(
        "seq",
        F.substring("title", 1, 300).alias("title"),
        cut("company", 200).alias("company"),
        F.coalesce(place["normalized_location"], F.col("location")).alias("location"),
        "stack",
        F.substring("link", 1, 500).alias("link"),
        F.substring("source", 1, 100).alias("source"),
        cut("external_id", 200).alias("external_id"),
        "fingerprint",
        "content_hash",
        "published_at",
        cut("seniority", 50).alias("seniority"),
        F.col("score").cast("decimal(5,2)").alias("score"),
        "score_reasons",
        merge_raw_payload(F.col("raw_payload"), F.col("description")).alias("raw_payload"),
        money("salary_min").alias("salary_min"),
        money("salary_max").alias("salary_max"),
        given_or("salary_currency", F.col("__salary")["salary_currency"]).alias("salary_currency"),
        given_or("contract_type", F.col("__contract")).alias("contract_type"),
        given_or("remote_type", place["remote_type"]).alias("remote_type"),
        given_or("country", place["country"]).alias("country"),
        given_or("city", place["city"]).alias("city"),
        F.lit("active").alias("status"),
    )
