"""Conversation repair against trying all edits, and against a plain walk on long ones."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pennant.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"


def all_audits(signs):
    """Every audit with at most two inserts before a row and behind the last, and what it costs."""
    out = []

    def go(i, roles, audit, cost, inserts):
        if cost > 4 * len(signs):
            return  # deleting all is cheaper
        if i == len(signs) and re.fullmatch("(s?(ua)+)?", roles):
            out.append((cost, audit))
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, audit + "I", cost + 3, inserts + 1)
        if i < len(signs):
            go(i + 1, roles, audit + "D", cost + 4, 0)
            if signs[i] != "D":
                more = 3 if signs[i].isupper() else 0
                go(i + 1, roles + signs[i].lower(), audit + "K", cost + more, 0)
                for r in "ua":
                    go(i + 1, roles + r, audit + "R", cost + 3 + more, 0)

    go(0, "", "", 0, 0)
    return min(out)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_short_signature(n):
    for signs in map("".join, itertools.product("DsuaoSUAO", repeat=n)):
        cost, audit = all_audits(signs)
        assert C.solved(signs) == (audit, cost), signs


def test_longer_signatures():
    r = np.random.default_rng(1)
    for _ in range(12):
        signs = "".join(r.choice(list("DsuaoSUAO"), 4))
        assert C.solved(signs) == all_audits(signs)[::-1], signs


def walk(signs):
    """Costs from the back, then the least edit of those that keep to the cheapest."""
    n = len(signs)
    ahead = [None] * n + [{0: 0, 1: 6, 2: 3, 3: 0}]
    turn = lambda s: 3 if s == 2 else 2

    def steps(i, s):
        yield "D", 4, i + 1, s
        yield "I", 3, i, turn(s)
        if signs[i] != "D":
            more = 3 if signs[i].isupper() else 0
            kept = {"s": [0], "u": [0, 1, 3], "a": [2], "o": []}[signs[i].lower()]
            if s in kept:
                yield "K", more, i + 1, {"s": 1, "u": 2, "a": 3}[signs[i].lower()]
            yield "R", 3 + more, i + 1, turn(s)

    for i in reversed(range(n)):
        direct = {s: min(c + ahead[i + 1][t] for e, c, _, t in steps(i, s) if e != "I") for s in range(4)}
        ahead[i] = {s: min(direct[s], 3 + direct[turn(s)]) for s in range(4)}
    out, i, s = [], 0, 0
    while i < n:
        e, _, j, t = min(x for x in steps(i, s) if x[1] + (ahead[i][x[3]] if x[0] == "I" else ahead[i + 1][x[3]]) == ahead[i][s])
        out.append(e)
        i, s = j, t
    return "".join(out) + ["", "II", "I", ""][s], ahead[0][0]


def plain(rows):
    """What the query gives, row by row."""
    out = {}
    ids = {r[0] for r in rows}
    kept = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        kept += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for conv in ids:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        turns = {r[1] for r in own} - {None}
        seen, signs, faults = set(), [], Counter()
        for _, _, role, text in own:
            bare = text.strip(BLANKS)
            sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            signs.append("D" if fault in ("blank", "duplicate") else sign.upper() if fault else sign)
        audit, cost = walk(signs)
        lines, at, last = [], iter(own), ""
        for e in audit:
            if e == "I":
                last = "a" if last == "u" else "u"
                lines.append(f"{ {'a': 'assistant', 'u': 'user'}[last]}:")
                continue
            _, _, role, text = next(at)
            if e != "D":
                if e == "R":
                    role = "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{text}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(seed, n):
    r = np.random.default_rng(seed)
    texts = ["Fine.", "Yes!", "cut off", "", " \n", "a?b ", "long " * 50 + ".", "Ends?\t", "日本。", None]
    roles = ["user", "assistant", "system", "tool", "", "udder", None]
    return [(int(c) if c else None, int(t) if t >= 0 else None, roles[a], texts[b]) for c, t, a, b in zip(r.integers(0, n // 5, n), r.integers(-1, 9, n), r.choice(7, n, p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05]), r.integers(0, 10, n), strict=True)]


def test_query_equals_plain_python(spark):
    """Nulls in every column, ties, repeated rows, conversations whose rows all go."""
    rows = some_rows(5, 600) + some_rows(5, 30) + [(900 + i, i, "user", "Hello.") for i in range(40)] + [(7, 1, "user", "x" * 2_000_000)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.conv_id: tuple(r) for r in C.damage_audits(df).collect()}
    want = plain(rows)
    assert got == want
    gone = [r for r in want.values() if not r[7]]
    assert gone and all(r[8] == hashlib.sha256(b"").hexdigest() and not any(r[1:7]) for r in gone)


def test_long_conversation_in_segments(spark):
    """One conversation with most of the rows: ordered by range over tasks, cut and put together."""
    r = np.random.default_rng(2)
    rows = [(1, i, ["user", "assistant", "system"][int(a)], f"text {i % 700}" + ["", ".", "?"][int(b)]) for i, (a, b) in enumerate(zip(r.choice(3, 11_000, p=[0.48, 0.48, 0.04]), r.integers(0, 3, 11_000), strict=True))]
    rows += [(c, t, "user", "Hi.") for c in range(-20, 20) for t in range(3)]
    df = spark.createDataFrame(rows, ROWS)
    assert {r.conv_id: tuple(r) for r in C.damage_audits(df).collect()} == plain(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", ""), (2, 0, "user", "a?"), (2, 1, "assistant", "b!"), (2, 2, "tool", "c."), (2, 2, "tool", "c."), (None, None, None, None)]
    found, turns = C.repaired(spark.createDataFrame(rows, ROWS))
    assert {r.conv_id: (r.audit, r.cost) for r in found.collect()} == {1: ("KIKD", 7), 2: ("KKDD", 8), None: ("D", 4)}
    assert sorted(map(tuple, turns.collect())) == [(1, 0, "system", "Be kind."), (1, 1, "user", ""), (1, 2, "assistant", "Hi."), (2, 0, "user", "a?"), (2, 1, "assistant", "b!")]


def test_empty_and_clashing(spark):
    assert C.damage_audits(spark.createDataFrame([], ROWS)).collect() == []
    rows = some_rows(8, 60)
    wide = spark.createDataFrame(rows, ROWS).selectExpr("*", "'own' AS audit", "'own' AS copies", "'own' AS sign", "'own' AS how", "'own' AS digest", "'own' AS at")
    assert {r.conv_id: tuple(r) for r in C.damage_audits(wide).collect()} == plain(rows)
