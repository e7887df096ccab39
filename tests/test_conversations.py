"""Conversation and stream operators against step-by-step Python versions."""

from __future__ import annotations

import datetime as dt
import random
from itertools import groupby

import pytest

from portfolia.operators import conversations as c, skew


def _messages(seed, roles):
    rng = random.Random(seed)
    return [(g, t, rng.choice(roles), rng.choice(["text", "tool_use"]), rng.choice(["", f"m{g}.{t}", "x\ny"]))
            for g in range(6) for t in sorted(rng.sample(range(50), 20))]


def _by_conv(rows):
    return {g: list(ms) for g, ms in groupby(rows, key=lambda r: r[0])}


SCHEMA = "conv_id long, turn long, role string, type string, text string"


@pytest.fixture(params=[(2, 3), (7, 30), (65536, 1 << 20)])
def sizes(request, monkeypatch):
    """Rows in a block of places, and bytes in a piece."""
    for module in (c, skew):
        monkeypatch.setattr(module, "BLOCK", request.param[0])
    monkeypatch.setattr(skew.number_runs, "__defaults__", (request.param[0],))
    return request.param[1]


def test_coalesce_turns(spark, sizes):
    rows = _messages(sizes, ["user", "assistant"])
    rows = [(*r, rng_value) for r, rng_value in zip(rows, random.Random(1).choices([None, "p", "q"], k=len(rows)), strict=True)]
    got = {}
    out = c.coalesce_turns(spark.createDataFrame(rows, SCHEMA + ", prop string"), ["prop"], sizes)
    for r in out.orderBy("run", "part").collect():
        got.setdefault((r.conv_id, r.first_turn), []).append(r)
    for g, ms in _by_conv(rows).items():
        for no, (role, run) in enumerate(groupby(ms, key=lambda m: m[2]), 1):
            run = list(run)
            parts = got.pop((g, run[0][1]))
            props = [m[5] for m in run if m[5]] if role == "assistant" else []
            for p in parts:
                assert (p.run, p.role, p.type, p.n_messages) == (no, role, run[0][3], len(run))
                assert p.prop == (props[-1] if props else None)
                assert len(p.text) <= sizes + 12
            assert "".join(p.text for p in parts) == "\n\n".join(m[4] for m in run if m[4])
    assert not got


def test_rows_without_role_turn_or_conversation_are_kept(spark, sizes):
    rows = [(1, 0, "user", "text", "a"), (1, 1, None, "text", "LOST"), (1, 2, "user", "text", "c"),
            (1, None, "user", "text", "late"), (None, 3, "assistant", "text", "no home"), (None, None, None, None, None)]
    out = c.coalesce_turns(spark.createDataFrame(rows, SCHEMA), piece_bytes=sizes).orderBy(
        "conv_id", "run", "part").collect()
    texts = {}
    for r in out:
        texts.setdefault((r.conv_id, r.run, r.role), []).append(r.text)
    assert {k: "".join(v) for k, v in texts.items()} == {
        (None, 1, "assistant"): "no home", (None, 2, None): "", (1, 1, "user"): "a", (1, 2, None): "LOST",
        (1, 3, "user"): "c\n\nlate"}


def test_copies_of_one_row_and_a_burst_are_cut(spark):
    """Fifty equal messages of one turn, and fifty events of one time: no piece holds them all, and none is lost."""
    rows = spark.createDataFrame([(1, 1, "user", "text", "same")] * 50, SCHEMA)
    out = c.coalesce_turns(rows, piece_bytes=30).orderBy("part").collect()
    assert "".join(r.text for r in out) == "\n\n".join(["same"] * 50) and max(len(r.text) for r in out) <= 36
    assert len(out) >= 10 and {r.n_messages for r in out} == {50}
    when = dt.datetime(2024, 1, 1)
    burst = spark.createDataFrame([(1, when, i, "text", f"{i:03d} ") for i in range(50)],
                                  "stream_id long, ts timestamp, event_id long, kind string, body string")
    out = c.assemble_events(burst, 20).orderBy("part").collect()
    assert [r.text for r in out] == ["".join(f"{i:03d} " for i in range(j, j + 5)).rstrip(" " if j == 45 else "")
                                     for j in range(0, 50, 5)]


def _alternate(ms):
    """The turn-by-turn rule: expect user first; keep the last of equal neighbours."""
    out, expected = [], "user"
    for role, run in groupby(ms, key=lambda m: m[2]):
        run = list(run)
        if role != expected:
            continue
        if role == "user":
            out.append((role, [run[0][4]]))
        elif texts := [m[4] for m in run if m[3] == "text"]:
            out.append((role, texts))
        expected = "assistant" if role == "user" else "user"
    return [x for i, x in enumerate(out) if i + 1 == len(out) or out[i + 1][0] != x[0]]


@pytest.mark.parametrize("roles", [["user", "assistant"], ["user", "assistant", "system"], ["assistant", "system"]])
@pytest.mark.parametrize("piece", [4, 65536])
def test_alternate_roles(spark, roles, piece):
    rows = _messages(len(roles) + piece, roles)
    got = {}
    out = c.alternate_roles(spark.createDataFrame(rows, SCHEMA), piece)
    for r in out.orderBy("conv_id", "run", "part").collect():
        got.setdefault(r.conv_id, {}).setdefault((r.first_turn, r.role), []).append(r.content)
    for g, ms in _by_conv(rows).items():
        have = [(role, "".join(parts)) for (_, role), parts in sorted(got.get(g, {}).items())]
        assert have == [(role, "\n\n".join(t for t in texts)) for role, texts in _alternate(ms)]


@pytest.mark.parametrize("size", [1 << 20, 17])
def test_assemble_events(spark, size):
    rng = random.Random(size)
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(seconds=rng.randint(0, 90)), i,
             rng.choices(["text", "tool_results", "tool_use", "done", "error"], [8, 2, 1, 1, 1 if s % 2 else 0])[0],
             rng.choice([f"b{i} ", f" b{i}\n", "  ", "", None]))
            for i, s in enumerate(rng.choices(range(12), k=300))]
    df = spark.createDataFrame(rows, "stream_id long, ts timestamp, event_id long, kind string, body string")
    got = {}
    for r in c.assemble_events(df, size).orderBy("stream_id", "part").collect():
        got.setdefault(r.stream_id, []).append(r)
    for s in {r[0] for r in rows}:
        text, tool, status, n = "", None, "open", 0
        for _, _, _, kind, body in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            if kind in ("error", "done"):
                status = kind
                text, tool, n = (body or "", None, 0) if kind == "error" else (text, tool, n)
                break
            if kind == "text":
                text, n = text + (body or ""), n + 1
            elif kind == "tool_use":
                name = "Unknown tool" if body is None else body
                text += f"I used the following tool to serve your request: **{name}**\n\n"
            else:
                tool = body
                text += body + "\n\n" if body else ""
        parts = got.pop(s)
        assert {(p.status, p.tool_result, p.n_texts) for p in parts} == {(status, tool, n)}
        assert "".join(p.text for p in parts) == text.strip()
        assert status == "error" or size > 17 or max(len(p.text) for p in parts) <= size + 80
    assert not got
