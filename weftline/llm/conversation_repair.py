"""Repair of damaged conversations by the cheapest edits.

A conversation is well formed if the initials of its roles read (s?(ua)+)?, that is, a system turn at most, then turns of
user and assistant in pairs. Each row's first fault counts: blank (no character but white space), duplicate (a row of the
same role and text stands before it), truncated (its last such character is none of . ! ?). Edits are Keep (0), Rerole to
user or assistant (2), Delete (3, required for blanks and duplicates) and Insert of an empty user or assistant turn
anywhere (2); a truncated row that stays adds 1. The audit is the edits' initials in order; of the cheapest audits the one
that is least in ASCII is taken, and it fixes the repair, as each edit has one role to give.

The edits are paths in a lattice of (rows read, last initial). A* searches it by cost so far plus what the rows left must
cost at least (suffix sums of 3 for what must be deleted and 1 for what is truncated), then by audit; the bound never
exceeds the cost, nor falls by more than an edit costs, so the first path that reaches a point is its cheapest and least.

Rows are numbered by ranges and cut into segments of 2**SEGMENT rows. Each segment is searched from every initial it can
be entered with, and the tables (initial before, initial after, cost, audit) of FAN segments at a time are joined until
one is left a conversation, so no task holds a conversation's rows, whatever their number. What one task streams through,
row by row, is a conversation's repaired text; a digest of it cannot be had otherwise. An audit is one value.

Defined results: nulls in role and text are one space; rows go by turn (null first), then by role and text; a null
conversation is one of its own; a role that is empty or of another initial is never kept; an empty table gives an empty
result; a very long text is one row's concern; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.ordering import numbered
from weftline.llm.scratch import cut

SEGMENT, FAN = 6, 64
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {REROLE: 2, DELETE: 3, INSERT: 2}
#: What a conversation's last initial can be; "" is a conversation without a turn.
STATES = ("", "s", "u", "a")
#: The states in which a conversation may end, and the turn that may follow each beside a first system turn.
WHOLE, NEXT = ("", "a"), {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = "bdt"
_TABLE = "array<struct<before:string,after:string,cost:bigint,audit:string,via:array<string>>>"
_PART = f"w_group string, segment long, first string, last string, illegal long, ways {_TABLE}"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults: by crc32(conv_id:turn) % 20 a row is dropped (0), loses its text (1) or its
    [.!?] (2), is repeated (3) or becomes the user's (4). Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    role = F.when(kind == 4, "user").otherwise(said("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _fits(before: str, initial: str) -> bool:
    return initial == NEXT[before] or initial == "s" and not before


def cheapest(initials: list[str], faults: list[str | None], before: str, goals: set[str]) -> dict[str, tuple[int, str]]:
    """Cost and audit of the best edits that lead from the state before to each goal, by A*."""
    n = len(initials)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (COST[DELETE] if faults[i] in (BLANK, DUPLICATE) else faults[i] == TRUNCATED)
    queue, closed, found = [(rest[0], "", 0, before)], set(), {}
    while queue and len(found) < len(goals):
        bound, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = bound - rest[i]
        if i == n and state in goals:
            found[state] = (cost, audit)
        heapq.heappush(queue, (bound + COST[INSERT], audit + INSERT, i, NEXT[state]))
        if i == n:
            continue
        heapq.heappush(queue, (cost + COST[DELETE] + rest[i + 1], audit + DELETE, i + 1, state))
        if faults[i] in (BLANK, DUPLICATE):
            continue
        cost += faults[i] == TRUNCATED
        heapq.heappush(queue, (cost + COST[REROLE] + rest[i + 1], audit + REROLE, i + 1, NEXT[state]))
        if _fits(state, initials[i]):
            heapq.heappush(queue, (cost + rest[i + 1], audit + KEEP, i + 1, initials[i]))
    return found


def ways(initials: list[str], faults: list[str | None], begins: bool) -> list[tuple[str, str, int, str, list[str]]]:
    """(before, after, cost, audit, []) for all states that a segment can lead from and to."""
    n, out = len(initials), []
    for before in ("",) if begins else STATES:
        if before in ("", "s"):  # nothing of it stays
            out.append((before, before, COST[DELETE] * n, DELETE * n, []))
        if not before:  # of it only a system turn stays: one without a charge, and the last such
            alone = [(faults[i] == TRUNCATED, -i) for i in range(n) if initials[i] == "s" and faults[i] not in (BLANK, DUPLICATE)]
            if alone:
                charge, i = min(alone)
                out.append((before, "s", COST[DELETE] * (n - 1) + charge, DELETE * -i + KEEP + DELETE * (n - 1 + i), []))
        out += [(before, after, *way, []) for after, way in cheapest(initials, faults, before, {"u", "a"}).items()]
    return out


def joined(parts: list[list[tuple]]) -> list[tuple[str, str, int, str, list[str]]]:
    """The ways through segments that follow each other; via: the states between and after them."""
    out = []
    for start in STATES:
        best = {start: (0, "", [start])}
        for part in parts:
            after: dict[str, tuple] = {}
            for before, end, cost, audit, _ in part:
                if before in best:
                    so_far = best[before]
                    way = (so_far[0] + cost, so_far[1] + audit, [*so_far[2], end])
                    after[end] = min(after.get(end, way), way)
            best = after
        out += [(start, end, *way) for end, way in best.items()]
    return out


def _illegal(pairs: Iterator[tuple[str, str]]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairs)


_WAY = pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("via", pa.list_(pa.string()))])
_PART_KINDS = pa.schema([("w_group", pa.string()), ("segment", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("ways", pa.list_(_WAY))])


def _part(group: str, segment: int, first: str, last: str, illegal: int, found: list[tuple]) -> dict:
    return {"w_group": group, "segment": segment, "first": first, "last": last, "illegal": illegal, "ways": [dict(zip(_WAY.names, x, strict=True)) for x in found]}


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, the ways through each segment."""
    at, initials, faults = None, [], []

    def part() -> dict:
        return _part(*at, initials[0], initials[-1], _illegal(zip(initials, initials[1:], strict=False)), ways(initials, faults, not at[1]))

    for batch in batches:
        out = []
        for group, segment, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("w_group", "segment", "initial", "fault")), strict=True):
            if (group, segment) != at:
                if at:
                    out.append(part())
                at, initials, faults = (group, segment), [], []
            initials.append(initial)
            faults.append(fault)
        yield pa.RecordBatch.from_pylist(out, _PART_KINDS)
    if at:
        yield pa.RecordBatch.from_pylist([part()], _PART_KINDS)


def _join(table: pa.Table) -> pa.Table:
    """The ways through some segments of a conversation that follow each other, FAN at most."""
    rows = table.sort_by("segment").to_pylist()
    illegal = sum(r["illegal"] for r in rows) + _illegal((a["last"], b["first"]) for a, b in zip(rows, rows[1:], strict=False))
    found = joined([[tuple(w.values()) for w in r["ways"]] for r in rows])
    return pa.Table.from_pylist([_part(rows[0]["w_group"], rows[0]["segment"] // FAN, rows[0]["first"], rows[-1]["last"], illegal, found)], _PART_KINDS)


def _faults(placed: DataFrame) -> DataFrame:
    """Of each row: w_group, place, turn, segment, initial of the role and its first fault."""
    seen = placed.select("w_group", "place", "turn", F.substring("role", 1, 1).alias("initial"), (~F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]"))).alias("blank"), (~F.rlike("text", F.lit("[.!?][\\x20\\x09-\\x0D]*\\z"))).alias("open"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    seen = cut(seen)
    again = seen.groupBy("w_group", "said").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").select("w_group", "said", "earliest")
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("earliest"), DUPLICATE).when(F.col("open"), TRUNCATED)
    return cut(seen.join(again, ["w_group", "said"], "left").select("w_group", "place", "turn", F.shiftright("place", SEGMENT).alias("segment"), "initial", fault.alias("fault")))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation in order, each segment after a row with its audit and the state before it: the repaired rows."""
    audit, at, state = "", 0, ""
    for batch in batches:
        out: list[tuple] = []
        for group, place, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("w_group", "place", "kind", "role", "text")), strict=True):

            def inserted(group: str = group, place: int = place) -> None:
                nonlocal at, state
                while at < len(audit) and audit[at] == INSERT:
                    at, state = at + 1, NEXT[state]
                    out.append((group, place, INSERT, NAMES[state], ""))

            if not kind:
                audit, at, state = text, 0, role
                inserted()
                continue
            edit, at = audit[at], at + 1
            if edit == REROLE:
                role = NAMES[NEXT[state]]
            if edit != DELETE:
                state = role[:1]
                out.append((group, place, edit, role, text))
            inserted()
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64() if i == 1 else pa.string()) for i in range(5)], names=["w_group", "place", "edit", "role", "text"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, running = None, None

    def told(group: str, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([state.hexdigest()])], names=["w_group", "sha256"])

    for batch in batches:
        for group, role, text in zip(*(batch.column(c).to_pylist() for c in ("w_group", "role", "text")), strict=True):
            if group != last:
                if running:
                    yield told(last, running)
                last, running = group, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
    if running:
        yield told(last, running)


def group_of(conv: Column) -> Column:
    """The conversation's name in what repair() returns."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text): per conversation w_group (see group_of), gaps, blank, duplicate, truncated,
    illegal, cost and audit; and the repaired rows: w_group, place (of the damaged row), edit, role and text, sorted within
    partitions and each conversation in one."""
    spoken = rows.select(group_of(F.col("conv_id")).alias("w_conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    placed = numbered(spoken, F.col("w_conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"))
    facts = _faults(placed)
    turns = facts.groupBy("w_group", "turn").agg(*(F.sum((F.col("fault") == k).cast("int")).alias(name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("w_group").agg(gaps.alias("gaps"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated")))
    ordered = facts.repartition("w_group", "segment").sortWithinPartitions("w_group", "segment", "place")
    levels, tops = [cut(ordered.mapInArrow(_search, _PART))], []
    while True:  # conversations of one segment are done, the others' segments are joined
        most = levels[-1].groupBy("w_group").agg(F.max("segment").alias("most"))
        several = most.where("most > 0").select("w_group")
        tops.append(levels[-1].where("segment = 0").join(several, "w_group", "left_anti"))
        if several.isEmpty():
            break
        up = levels[-1].join(several, "w_group", "left_semi").withColumn("above", F.floor(F.col("segment") / FAN))
        levels.append(cut(up.groupBy("w_group", "above").applyInArrow(lambda t: _join(t), _PART)))
    whole = F.filter("ways", lambda w: (w["before"] == "") & w["after"].isin(*WHOLE))
    best = F.array_min(F.transform(whole, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"), w["before"].alias("before"), w["after"].alias("after"))))
    tops = [top.select("w_group", "segment", "illegal", best.alias("best")) for top in tops]
    summary = reduce(DataFrame.unionByName, tops).join(counts, "w_group").select("w_group", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    chosen = [top.select("w_group", "segment", "best.before", "best.after") for top in tops]
    same = lambda w: (w["before"] == F.col("before")) & (w["after"] == F.col("after"))
    pick = F.get(F.filter("ways", same), F.lit(0))
    for i in range(len(levels) - 1, 0, -1):
        via = levels[i].join(chosen[i], ["w_group", "segment"]).select("w_group", "segment", pick["via"].alias("via"))
        each = via.select("w_group", "segment", "via", F.posexplode(F.slice("via", F.lit(2), F.size("via") - 1)).alias("i", "after"))
        chosen[i - 1] = chosen[i - 1].unionByName(each.select("w_group", (F.col("segment") * FAN + F.col("i")).alias("segment"), F.get("via", F.col("i")).alias("before"), "after"))
    audits = levels[0].join(chosen[0], ["w_group", "segment"]).select("w_group", F.shiftleft("segment", SEGMENT).alias("place"), F.lit(0).alias("kind"), F.col("before").alias("role"), pick["audit"].alias("text"))
    both = audits.unionByName(placed.select("w_group", "place", F.lit(1).alias("kind"), "role", "text"))
    repaired = both.repartition("w_group").sortWithinPartitions("w_group", "place", "kind").mapInArrow(_apply, "w_group string, place long, edit string, role string, text string")
    return summary, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation of repair()'s rows: w_group and the SHA-256 of its lines role:text."""
    return repaired.mapInArrow(_digest, "w_group string, sha256 string")
