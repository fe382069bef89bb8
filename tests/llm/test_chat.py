from __future__ import annotations

import pytest

from postloom.llm import chat
from tests.llm import cases

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, 0, "assistant", "first"), (3, 1, "user", "a"),
    (4, 0, "user", None), (4, 1, "assistant", ""),
    (5, 0, None, "<|turn|>x<|text|>y<|end|>"), (5, 0, "<|end|>", "<\\|end|> <\\\\|end|> [\\INST] \\ $1"),
    (6, 1, "user", "same"), (6, 1, "user", "same"), (6, None, "assistant", "early"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 200_000),
    (8, 0, "user", "<"), (8, 1, "assistant", "|end|>"), (8, 2, "user", "[" + "\\" * 50 + "INST]"), (8, 3, "assistant", "😀é\n\n"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "x", 1) for t in TURNS], SCHEMA)


def conversations():
    found: dict = {}
    for conv, turn, role, text in TURNS:
        found.setdefault(conv, []).append((turn, role or "", text or ""))
    return {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, t in found.items()}


def test_texts_are_read_back_whole(turns):
    rows = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    want = conversations()
    assert set(rows) == set(want)
    for conv, said in want.items():
        assert [(t.role, t.text) for t in rows[conv].turns] == [(r, t) for _, r, t in said]
        assert rows[conv].learned == "".join(t for _, r, t in said if r == "assistant")


def test_marks_cannot_be_forged(turns):
    template = chat.Template()
    for row in chat.format_chats(turns).collect():
        texts = [s.text for s in row.segments[1::3]]
        assert not any(c in t for t in texts for c in template.controls)
        assert row.formatted.count(template.close) * 3 == len(row.segments)
        assert [s.loss for s in row.segments[0::3]] == [s.loss for s in row.segments[2::3]] == [False] * len(texts)


def test_turn_order(turns):
    broken = {r.conv_id: r.broken_at for r in chat.format_chats(turns).collect()}
    assert broken == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 1, None: 0, 8: 0}


def test_a_template_is_declared(spark):
    template = chat.Template(
        open="{", between=":", close="}", reserved=(), learned=("bot",),
        moves={("start", "bot"): "bot"}, final=("bot",),
    )
    turns = spark.createDataFrame([(1, 0, "bot", "a{b}c:d")], "conv_id long, turn long, role string, text string")
    row = chat.read_chats(chat.format_chats(turns, template), template).first()
    assert row.broken_at == 0 and row.learned == "a{b}c:d" and row.turns[0].role == "bot"


def test_empty_table(turns):
    assert chat.digests(chat.read_chats(chat.format_chats(cases.empty(turns)))).collect() == []


def test_plan_is_native(turns):
    plan = chat.digests(chat.read_chats(chat.format_chats(turns)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
