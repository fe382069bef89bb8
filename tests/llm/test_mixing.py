from __future__ import annotations

from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.llm import mixing
from tests.llm import cases


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), st.floats(0, 1), st.integers(1, 40))
def test_fit_comes_as_near_as_any_choice(counts, share, gap):
    sizes = np.array(sorted(counts))
    held = np.array([counts[s] for s in sizes])
    budget = int(share * (sizes * held).sum())
    taken = mixing.fit(sizes, held, budget)
    assert (taken >= 0).all() and (taken <= held).all()
    best = min(abs(sum(s * n for s, n in zip(sizes, c)) - budget) for c in product(*[range(h + 1) for h in held]))
    got = abs(int((sizes * taken).sum()) - budget)
    # The share of each size that is taken first leaves enough to choose from but for tiny tables.
    assert got <= max(best, int(sizes.max()))


def levels(sources, weights=(5, 2, 1), share=1.5):
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sources.values()) - sum(2 * sources[s] for s in full)
        whole = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / whole > 2 * sources[s] + 1e-9}
        if not over:
            return {s: 2.0 * sources[s] if s in full else rest * weight[s] / whole for s in names}
        full |= over


def test_targets_and_takings(spark):
    docs = cases.documents(spark).where("doc_id is null or doc_id not in (8, 9)")  # one fills a source
    rows = mixing.decide(docs).collect()
    assert len(rows) == docs.count()
    sources = defaultdict(int)
    taken = defaultdict(int)
    for r in rows:
        sources[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = levels(sources)
    for r in rows:
        assert r.source_size == sources[r.source] and r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1
    again = mixing.decide(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_words_are_ascii_separated(spark):
    got = {r.doc_id: r.size for r in mixing.decide(cases.documents(spark)).collect() if r.doc_id}
    assert got[3] == got[4] == got[5] == 0 and got[6] == 1 and got[13] == 2 and got[8] == 20_000


def test_ranks_within_slices_choose_the_same_number(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(300)] + [(1000 + i, "x y") for i in range(4)], "doc_id long, text string").selectExpr("*", "if(doc_id < 1000, 'p', 'q') AS source")
    one = mixing.decide(docs, weights=(1.0, 8.0), ranked=10_000)
    many = mixing.decide(docs, weights=(1.0, 8.0), ranked=7)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_mix_repeats_documents(spark):
    docs = cases.documents(spark).where("doc_id is not null and doc_id != 7")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.decide(docs).collect() if r.copies}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert got == want


def test_rows_that_share_an_id_are_taken_by_their_own_copies(spark):
    """NULL ids over all sources and sizes, ids with several texts, and equal rows taken unevenly."""
    rows = [(None, cases.prose(300 + k, 3 + k % 9), f"s{k % 3}", k) for k in range(60)]
    rows += [(k % 4, cases.prose(400 + k, 2 + k % 5), f"s{k % 3}", k) for k in range(40)]
    rows += [(7, "same five words in here", f"s{k % 3}", k) for k in range(21)] + [(7, "", "s0", 1), (None, None, "s1", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    decided = mixing.decide(docs).collect()
    assert len(decided) == len(rows)
    copies, got, words = Counter(), Counter(), Counter()
    for r in decided:
        copies[r.doc_id, r.source, r.size] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
        words[r.source] += len(r.text.split())
    assert got == +copies
    for r in decided:
        assert abs(words[r.source] - r.target) <= 1
    held = Counter((None if r[0] is None else r[0], r[1], r[2], r[3]) for r in rows)
    assert all(n <= 2 * held[key] for key, n in Counter(tuple(r) for r in mixed.collect()).items())


def test_the_text_is_part_of_the_draw(spark):
    docs = spark.createDataFrame([(None, f"text {k}", "s") for k in range(50)], "doc_id long, text string, source string")
    assert mixing.sized(docs).select("draw").distinct().count() == 50


def test_empty_tables(spark):
    none = cases.empty(cases.documents(spark))
    assert mixing.decide(none).collect() == [] and mixing.mix(none).collect() == []
    blank = cases.documents(spark).where("doc_id in (3, 4, 5)")
    assert {(r.target, r.taken) for r in mixing.decide(blank).collect()} == {(0.0, 0)}


def test_columns_named_like_the_operators_own_stay(spark):
    docs = cases.documents(spark)
    named = docs.withColumns({"taken_id": docs["doc_id"], "taken_source": docs["source"], "taken_sha": docs["lang"]})
    mixed = mixing.mix(named)
    assert mixed.columns == named.columns
    assert mixed.where("NOT taken_id <=> doc_id OR NOT taken_source <=> source OR NOT taken_sha <=> lang").count() == 0
    assert mixed.count() == mixing.mix(docs).count() > 0
