"""Damage and repair of conversations against a plain program over all paths."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from weftline.llm import conversation_repair as C
from weftline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, blank string"
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}


def best(initials, faults):
    """Least cost and then audit, state by state, row by row."""
    now = {"": (0, "")}
    for i in range(len(initials) + 1):
        for _ in range(4):
            for s, (c, a) in list(now.items()):
                now[FOLLOWS[s]] = min(now.get(FOLLOWS[s], (1 << 60, "")), (c + 2, a + "I"))
        if i == len(initials):
            return min(now[s] for s in ("", "a") if s in now)
        after = {}
        for s, (c, a) in now.items():
            paths = [(s, c + 3, "D")]
            if faults[i] not in ("b", "d"):
                charge = faults[i] == "t"
                paths.append((FOLLOWS[s], c + 2 + charge, "R"))
                if initials[i] and initials[i] in (FOLLOWS[s], "s" if not s else FOLLOWS[s]):
                    paths.append((initials[i], c + charge, "K"))
            for to, cost, letter in paths:
                after[to] = min(after.get(to, (1 << 60, "")), (cost, a + letter))
        now = after


def plain(rows):
    """Per conversation what op11 returns, from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        own = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            said = re.sub("[\x20\x09-\x0d]+", "", text)
            faults.append("b" if not said else "d" if (role, text) in seen else None if said[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = best(initials, faults)
        lines, state, i = [], "", 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[i][1:]
            i += edit != "I"
            if edit == "D":
                continue
            if edit in "RI":
                role = {"u": "user", "a": "assistant"}[FOLLOWS[state]]
            state = role[:1]
            lines.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


@pytest.fixture(scope="module")
def odd():
    """Conversations with nulls, ties, repeats, odd roles, a long one, and a column whose name the code uses."""
    rng = random.Random(5)
    texts = ["Hello there.", "Why?", "no end", "", " \t\n", "é! \x0b", "Hello there.", "x" * 5000 + "!", None]
    rows = [(conv, rng.choice((None, t, t, t, t // 2)), rng.choice(("user", "assistant", "user", "assistant", "system", None, "", "tool", "usher")), rng.choice(texts), "b") for conv in [*range(60), None] for t in range(rng.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else rng.choice(("user", "system", "tool")), f"{rng.randrange(300)} words" + rng.choice((".", "", "!")), "b") for t in range(9000)]
    return rows + rows[:5] + [(101, None, "user", "All null.", "b")]


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return result(QUERIES["op11_repair"](spark, str(tmp_path)))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_repair"](spark, sf_dir)) == plain(rows)


def test_odd_conversations(spark, tmp_path, odd):
    got, expected = query(spark, tmp_path, odd), plain(odd)
    assert got.keys() == expected.keys()
    assert {k: (got[k], v) for k, v in expected.items() if got[k] != v} == {}


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == {}


def test_segments_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randrange(1, 40)
        initials = [rng.choice("suauat") for _ in range(n)]
        faults = [rng.choice((None, None, None, "b", "d", "t")) for _ in range(n)]
        k = rng.randrange(1, 9)
        found = C.joined([C.ways(initials[i : i + k], faults[i : i + k], not i) for i in range(0, n, k)])
        assert min((c, a) for before, after, c, a, _ in found if not before and after in C.WHOLE) == best(initials, faults)


def test_search_reads_less_than_the_lattice():
    """The bound leads straight through a sound conversation: one point a row, and those beside it."""
    popped, pop = [], C.heapq.heappop

    class Counting:
        heappush = staticmethod(C.heapq.heappush)

        @staticmethod
        def heappop(queue):
            popped.append(queue[0])
            return pop(queue)

    heap, C.heapq = C.heapq, Counting
    try:
        found = C.cheapest(list("uaxuaxuaua"), [None, None, "b", None, None, "d", "t", None, None, None], "", {"a"})
    finally:
        C.heapq = heap
    assert found["a"] == (7, "KKDKKDKKKK")
    assert len(popped) < 2 * 11


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", ""), (1, 2, "user", "B?"), (1, 3, "user", "C")], "conv_id long, turn long, role string, text string")
    summary, repaired = C.repair(rows)
    assert [(r.audit, r.cost, r.blank, r.truncated, r.illegal) for r in summary.collect()] == [("IKDKR", 8, 1, 1, 2)]
    assert [(r.edit, r.role, r.text) for r in repaired.collect()] == [("I", "user", ""), ("K", "assistant", "A."), ("K", "user", "B?"), ("R", "assistant", "C")]
