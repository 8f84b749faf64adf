from __future__ import annotations

import random

import pytest

from echograph.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, n long, k long, digest string"


@pytest.fixture
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def logged(talk_of):
    """Rows of {conv_id: [(role, text), ...]}."""
    return [(c, t, role, text) for c, turns in talk_of.items() for t, (role, text) in enumerate(turns)]


def brute(talk_of):
    whole = {c: tuple(t) for c, t in talk_of.items()}
    out = {}
    for c, t in whole.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in whole.values()):
            continue
        same = [d for d, o in whole.items() if o == t]
        if c == min(same):
            text = "".join(f"{chat.OPEN}{'unknown' if r is None else r}\n{x or ''}{chat.CLOSE}\n" for r, x in t)
            out[c] = (len(t), len(same), text)
    return out


def found(df):
    return {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in chat.rendered(df).collect()}


def test_against_brute_force(talks):
    rng = random.Random(5)
    talk_of = {}
    for c in range(300):
        source = talk_of[rng.choice(list(talk_of))] if talk_of and rng.random() < 0.6 else []
        turns = list(source[: rng.randint(0, len(source))]) + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(0, 3))]
        talk_of[c] = turns or [("user", "hi")]
    assert found(talks(logged(talk_of)).repartition(7)) == brute(talk_of)


def test_snapshots_collapse_to_the_longest(talks):
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(600)]  # over several blocks
    talk_of = {k: turns[:k] for k in (1, 2, 255, 256, 257, 512, 513, 600)} | {900: [*turns[:256], ("user", "else")]}
    assert set(found(talks(logged(talk_of)))) == {600, 900}


def test_turn_numbers_do_not_count(talks):
    rows = [(1, 0, "user", "a"), (1, 5, "assistant", "b"), (2, -3, "user", "a"), (2, 7, "assistant", "b"), (2, 9, "user", "c")]
    assert set(found(talks(rows))) == {2}


def test_odd_rows(talks):
    rows = [
        (1, 0, "user", "x"), (1, 0, "user", "x"),  # a repeated row counts once
        (2, 0, "user", "x"), (2, 0, "user", "y"), (2, None, None, None),  # ties and nulls
        (None, 0, "user", "only"), (None, 1, "user", "w " * 200_000),
        (3, 0, "user", ""), (4, 0, "user", None),
    ]
    out = found(talks(rows))
    assert set(out) == {1, 2, None, 3, 4} and out[1][:2] == (1, 1) and out[2][0] == 3 and out[None][0] == 2
    assert out[2][2].startswith(f"{chat.OPEN}unknown\n{chat.CLOSE}")
    assert found(talks([])) == {}


def test_thousands_of_copies(talks):
    rows = logged({c: [("user", "hello"), ("assistant", "hi")] for c in range(3000)} | {9999: [("user", "hello")]})
    assert {c: v[:2] for c, v in found(talks(rows)).items()} == {0: (2, 3000)}


def test_plan_is_native(talks):
    plan = chat.rendered(talks(logged({1: [("user", "a")]})))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
