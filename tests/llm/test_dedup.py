from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from postloom.llm import near_dedup
from postloom.llm.components import components
from postloom.llm.exact_dedup import decide, drop_copies
from tests.llm import cases


def test_exact_copies_keep_the_largest_id(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    want = []
    for doc_id, text in rows:
        keep = max((i for i in groups[text] if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.append((doc_id, keep, len(groups[text]), doc_id == keep, sha))
    got = [tuple(r) for r in decide(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("copies", [1, 2, 1000])
def test_frequent_digests_and_others_are_decided_alike(spark, copies):
    docs = cases.documents(spark).unionByName(cases.documents(spark).where("doc_id > 150"))
    some = sorted(map(str, decide(docs, copies=copies, heavy=3).collect()))
    assert some == sorted(map(str, decide(docs).collect()))


def test_one_row_of_each_text_stays(spark):
    docs = cases.documents(spark)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    assert {r.doc_id for r in rows if r.text == "same text here"} == {2}


def test_a_text_with_ids_missing_is_kept_once(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "x"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted(str(r.text) for r in drop_copies(docs).collect()) == ["", "x"]


def test_empty_tables(spark):
    none = cases.empty(cases.documents(spark))
    assert decide(none).collect() == [] and drop_copies(none).collect() == []
    assert near_dedup.decide(none).collect() == [] and near_dedup.drop_near_copies(none).collect() == []


def shingles(text: str | None, size: int) -> set:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size, threshold):
    """Components by comparing all pairs; rows with one id are one document."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        sets[doc_id].append(shingles(text, size))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i in ids:
        for j in ids:
            if i < j and any(
                a and b and 100 * len(a & b) >= threshold * len(a | b) for a in sets[i] for b in sets[j]
            ):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies_equal_all_pairs(spark, size):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, size, 80)
    got = near_dedup.decide(docs, size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    counts = sorted((str(i), len(shingles(t, size))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == counts
    assert {r.component_id for r in got if r.doc_id is None} == {1, None}


def test_one_document_of_each_component_stays(spark):
    docs = cases.documents(spark)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and not set(ids) & set(range(101, 121)) and 8 in ids and 9 not in ids
    assert set(range(200, 240)) <= set(ids) and {3, 4, 5, 6} <= set(ids)


def test_a_near_copy_takes_no_other_row_along(spark):
    """A copy without an id, or with an id that another text has too, goes alone."""
    a, b, c = (cases.prose(k, 60) for k in (71, 72, 73))
    rows = [(1, a), (None, a), (None, b), (None, None), (5, a), (5, c), (6, a + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in near_dedup.drop_near_copies(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (None, None), (5, c)], key=str)


def test_the_texts_of_an_id_link_their_components(spark):
    a, b, c, d = (cases.prose(k, 60) for k in (81, 82, 83, 84))
    near = b.split()
    near[30] = "changed"
    rows = [(1, a), (5, a), (5, b), (9, b), (5, c), (7, " ".join(near)), (9, ""), (20, d), (20, c + " end"), (30, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.decide(docs).collect()}
    assert got == set(brute(rows, 5, 80).items()) == {(1, 1), (5, 1), (7, 1), (9, 1), (20, 1), (30, 30)}
    kept = sorted(tuple(r) for r in near_dedup.drop_near_copies(docs).collect())
    assert kept == sorted([(1, a), (5, b), (5, c), (9, ""), (20, d), (30, "")])


def test_chains_far_from_both_centres_are_joined(spark):
    """Each text is near its neighbours only, so no centre of a bucket sees all of them."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([f"x{k}" for k in range(8 * i)] + words[8 * i :])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.decide(docs, size=4).collect()}
    assert got == brute(rows, 4, 80) and set(got.values()) == {0}


def sequential(elements, slots):
    """SuperMinHash one element at a time, with the draws of the batch version."""
    best = [(1 << 64) - 1] * slots
    for x in elements:
        order = list(range(slots))
        for j in range(slots):
            at = np.uint64((x + (j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            drawn = int(near_dedup.mixed(np.array([at]))[0])
            k = j + (drawn & 0xFFFFFFFF) % (slots - j)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], (j << 56) | (drawn >> 8))
    return best


def test_signatures_equal_the_sequential_form():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 300)]
    got = near_dedup.super_minhash([*sets, np.zeros(0, np.uint64)], 25)
    for one, row in zip(sets, got):
        assert sequential([int(x) for x in one], 25) == row.tolist()
    assert (got[-1] == near_dedup.UNFILLED).all()


def test_agreement_of_signatures_estimates_similarity():
    r = np.random.default_rng(1)
    common = r.integers(0, 2**63, 800).astype(np.uint64)
    found = []
    for _ in range(20):
        own = r.integers(0, 2**63, (2, 100)).astype(np.uint64)
        a, b = near_dedup.super_minhash([np.unique(np.r_[common, o]) for o in own])
        found.append((a == b).mean())
    assert abs(np.mean(found) - 0.8) < 0.02


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {i: 100 for i in range(101, 140)} | {200: 150}
    assert components(cases.empty(df)).collect() == []


def test_many_repeated_rows_of_two_near_texts(spark):
    """2,500 rows of each of two near texts, under one id each, meet as two texts."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    docs = spark.range(5000).selectExpr(
        "id % 2 + 10 AS doc_id", f"CASE WHEN id % 2 = 0 THEN '{texts[0]}' ELSE '{texts[1]}' END AS text"
    ).repartition(8)
    search = near_dedup.Search(docs, 5, 80)
    assert search.texts.count() == 2
    rows = near_dedup.decide(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, rows)) == [(10, 10, True, 2500), (11, 10, False, 2500)]
    assert near_dedup.drop_near_copies(docs).select("doc_id").distinct().count() == 1


@pytest.mark.parametrize("copies", [1, 1000])
def test_repeated_rows_of_a_winner_are_one(spark, copies):
    docs = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 7 WHEN id < 3500 THEN NULL ELSE id END AS doc_id",
                                        "CASE WHEN id < 3600 THEN 'same' ELSE concat('t', id) END AS text", "1 AS place", "'x' AS first")
    kept = drop_copies(docs, copies=copies)
    assert kept.columns == docs.columns
    rows = {r.text: r.doc_id for r in kept.collect()}
    assert kept.count() == len(rows) == 401 and rows["same"] == 3599 and rows["t3700"] == 3700


def test_each_text_moves_at_most_once(spark):
    docs = cases.documents(spark)
    plan = drop_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortMergeJoin" not in plan
