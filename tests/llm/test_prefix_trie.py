"""Prefix trie: running sums, list ranking and whole tries against brute force; awkward rows; plans."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from postloom.llm import list_ranking, prefix_trie, queries, scans
from tests.llm import cases

TURNS = "conv_id long, turn long, role string, text string, depth long, digest string"


@pytest.fixture()
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    yield
    spark.conf.unset(name)


def scanned(rows):
    """Plain form: rows are (group, order, value)."""
    out, last, at, total, before = [], None, 0, 0, None
    for g, o, v in sorted(rows):
        if g != last:
            at, total, before = 0, 0, None
        at, total = at + 1, total + v
        out.append((g, o, v, at, scans._signed(total), scans._signed(total - v), before))
        last, before = g, o
    return out


@pytest.mark.parametrize("shape", ["hot", "many", "mixed", "one"])
def test_sums_within_groups(spark, tiny_batches, shape):
    r = random.Random(shape)
    groups = {"hot": [5] * 300 + list(range(20)), "many": list(range(200)), "mixed": [r.randrange(12) for _ in range(400)], "one": [1]}[shape]
    rows = [(g, i * 3, r.randrange(-(2**63), 2**63)) for i, g in enumerate(groups)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(5)
    found = scans.grouped_scan(df, ["g"], ["o"], sums=["v"], previous="o")
    assert found.columns == ["g", "o", "v", "position", "upto_v", "before_v", "previous"]
    assert sorted(map(tuple, found.collect())) == sorted(scanned(rows))
    assert scans.grouped_scan(cases.empty(df), ["g"], ["o"], sums=["v"], previous="o").collect() == []


def test_a_hot_group_is_spread_over_tasks(spark):
    df = spark.range(40_000).selectExpr("7L AS g", "id AS o", "1L AS v")
    with_parts = scans.grouped_scan(df, ["g"], ["o"], sums=["v"])
    assert with_parts.where("position != o + 1 OR upto_v != o + 1").count() == 0
    plan = with_parts._jdf.queryExecution().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("order", ["along", "random", "blocks"])
def test_list_ranking(spark, tiny_batches, order):
    r = random.Random(order)
    lists, ids = [], list(range(900))
    if order == "random":
        r.shuffle(ids)
    if order == "blocks":  # each block of ids in turn, some backwards
        blocks = [ids[i : i + 50] for i in range(0, 900, 50)]
        r.shuffle(blocks)
        ids = [x for k, b in enumerate(blocks) for x in (b[::-1] if k % 2 else b)]
    cuts = sorted(r.sample(range(1, 900), 3))
    for a, b in zip([0, *cuts], [*cuts, 900]):
        lists.append(ids[a:b])
    rows, want = [], {}
    for some in lists:
        total, before = [0, 0], (None, None)
        for x in some:
            weights = (1, r.randrange(100))
            total = [t + w for t, w in zip(total, weights)]
            rows.append((x // 3, x % 3, *before, *weights))
            want[x] = tuple(total)
            before = (x // 3, x % 3)
    df = spark.createDataFrame(rows, "a1 long, a2 long, p1 long, p2 long, n long, w long").repartition(4)
    got = {row.a1 * 3 + row.a2: (row.n, row.w) for row in list_ranking.ranked(df, ["n", "w"]).collect()}
    assert got == want
    assert list_ranking.ranked(cases.empty(df), ["n", "w"]).collect() == []


def brute(turns, rebuild: bool):
    """Nodes by a dictionary of prefixes."""
    rows: dict[int, list] = {}
    for conv, turn, role, text in turns:
        if conv is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        rows.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [x[3:] for x in sorted(some)] for c, some in rows.items()}
    if rebuild:
        own = convs
        convs = {}
        for c, some in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            base = c - (c % 5 if c >= 0 else -(-c % 5))
            convs[c] = own.get(base, [])[:h] + some[h:]
    members: dict[tuple, list[int]] = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    nodes = []
    sums: dict[tuple, tuple[int, int]] = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        below = [sums[c] for c in children[p]]
        sums[p] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
        ends = ",".join(str(c) for c in members[p] if len(convs[c]) == len(p))
        nodes.append((
            members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]),
            *sums[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(nodes, key=lambda n: n[:2])


def same(found, want):
    rows = sorted((tuple(r)[:8] for r in found.collect()), key=lambda n: n[:2])
    assert rows == want
    return found


def random_turns(seed: int, conversations: int, longest: int, texts: int):
    r = random.Random(seed)
    turns = []
    for c in r.sample(range(-50, 3 * conversations), conversations):
        for t in range(r.randint(1, longest)):
            turns.append((c, t, r.choice(["user", "assistant"][t % 2 : t % 2 + 1] + [None] * (r.random() < 0.1)), r.choice([f"tëxt {k}" for k in range(texts)] + [None, ""])))
    r.shuffle(turns)
    return turns


def frame(spark, turns):
    return spark.createDataFrame([(*t, 0, "x") for t in turns], TURNS)


@pytest.mark.parametrize("seed,conversations,longest,texts", [(1, 60, 6, 1), (2, 80, 12, 2), (3, 1, 3, 1)])
def test_tries_against_brute_force(spark, tiny_batches, seed, conversations, longest, texts):
    turns = random_turns(seed, conversations, longest, texts)
    found = same(prefix_trie.conversation_trie(frame(spark, turns)), brute(turns, False))
    # The tour enters and leaves each node once, children within their parents.
    rows = found.collect()
    places = sorted(p for r in rows for p in (r.entered_at, r.left_at))
    assert places == list(range(1, 2 * len(rows) + 1))
    at = {(r.conv_id, r.depth): r for r in rows}
    for r in rows:
        if r.depth:
            up = at[r.parent_conv_id, r.depth - 1]
            assert up.entered_at < r.entered_at < r.left_at < up.left_at


def test_rebuilt_conversations(spark, tiny_batches):
    turns = random_turns(4, 70, 12, 2)
    rows = prefix_trie.sequences(frame(spark, turns))
    same(prefix_trie.trie(prefix_trie.rebuilt(rows), rows.select("conv_id")), brute(turns, True))


def test_awkward_turns(spark, tiny_batches):
    long_text = cases.prose(3, 30_000)
    turns = [
        (None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 0, None, "second"), (1, 1, "user", None),
        (2, 0, "user", "first"), (2, 1, "", "second"), (3, 5, "user", long_text), (3, 9, "user", ""),
        (4, 0, "user", "again"), (4, 0, "user", "again"), (4, 0, "user", "again"), (4, 0, "assistant", "tie"),
        (5, 0, "us", "erfirst"), (-5, 0, "user", "first"), (2**62, 0, "user", long_text),
    ]
    turns += [(10, t, "user", "same") for t in range(120)] + [(11, t, "user", "same") for t in range(60)]
    same(prefix_trie.conversation_trie(frame(spark, turns)), brute(turns, False))
    rows = prefix_trie.sequences(frame(spark, turns))
    same(prefix_trie.trie(prefix_trie.rebuilt(rows), rows.select("conv_id")), brute(turns, True))
    empty = cases.empty(frame(spark, turns))
    assert prefix_trie.conversation_trie(empty).collect() == []
    rows = prefix_trie.sequences(empty)
    assert prefix_trie.trie(prefix_trie.rebuilt(rows), rows.select("conv_id")).collect() == []


def test_members_without_turns_end_at_the_root(spark):
    rows = prefix_trie.sequences(frame(spark, [(2, 0, "user", "a")]))
    found = prefix_trie.trie(rows, spark.createDataFrame([(1,), (2,), (2,)], "conv_id long")).collect()
    root = next(r for r in found if r.depth == 0)
    assert (root.conv_id, root.n_convs, root.n_children, root.n_leaves) == (1, 2, 1, 1)
    assert root.ends_sha256 == hashlib.sha256(b"1").hexdigest()


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op13_prefix_trie(spark, folder), brute(turns, True))
