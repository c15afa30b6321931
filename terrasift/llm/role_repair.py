"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in alternation, user
first and assistant last. Each given turn is kept, merged into the turn before it, relabelled,
or preceded by empty turns. A dynamic program over the automaton's states finds the cheapest
repair; its steps are (min, +) products, so long conversations are solved in segments: each
segment's state-to-state costs first, then the states between segments, then the segments'
own turns. No task holds more than a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.tables import keep

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # the state is the role of the last turn so far
STATES = ("start", *ROLES)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 3, 2
FAR = 1 << 40


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from one state to another, for every pair that can be joined."""
    found = {}
    for a in range(4):
        reach, ways = {a: ()}, [a]
        while ways:
            here = ways.pop(0)
            for b in LEGAL[here]:
                if b not in reach:
                    reach[b] = (*reach[here], b)
                    ways.append(b)
        found |= {(a, b): way for b, way in reach.items()}
    return found


INSERTS = _inserts()


def moves(role: int, state: int) -> list[tuple[int, int, str, int, tuple[int, ...]]]:
    """Ways to take a turn in a state: (cost, next state, action, given role, empty turns before it).

    ``role`` 0 is unknown and has to be relabelled. At equal cost the earlier way counts.
    """
    out = []
    for target in (SYSTEM, USER, ASSISTANT):
        cost = 0 if target == role else RELABEL
        label = "keep" if target == role else "relabel"
        if state == target:
            out.append((cost + MERGE, target, "merge" if cost == 0 else "relabel+merge", target, ()))
        for before in range(4):
            if target in LEGAL[before] and (state, before) in INSERTS:
                way = INSERTS[state, before]
                out.append((cost + INSERT * len(way), target, label if not way else f"insert+{label}", target, way))
    return sorted(out, key=lambda x: (x[0], len(x[4]), x[1], x[2]))


MOVES = {(r, s): moves(r, s) for r in range(4) for s in range(4)}
ENDS = {s: INSERT * len(INSERTS[s, ASSISTANT]) for s in range(4)}


def transfer(roles: list[int], entries: tuple = (START, SYSTEM, USER, ASSISTANT)) -> list[list[int]]:
    """Least cost from every entry state to every exit state over a run of turns."""
    rows = []
    for entry in entries:
        cost = [FAR] * 4
        cost[entry] = 0
        for role in roles:
            after = [FAR] * 4
            for s in range(4):
                if cost[s] < FAR:
                    for c, t, *_ in MOVES[role, s]:
                        after[t] = min(after[t], cost[s] + c)
            cost = after
        rows.append(cost)
    return rows


def path(roles: list[int], entry: int, leave: int) -> list[tuple]:
    """The moves of a cheapest way from ``entry`` to ``leave``, first best on ties."""
    cost, back = {entry: 0}, []
    for role in roles:
        after: dict[int, int] = {}
        step: dict[int, tuple] = {}
        for s in sorted(cost):
            for move in MOVES[role, s]:
                c, t = cost[s] + move[0], move[1]
                if c < after.get(t, FAR):
                    after[t], step[t] = c, (s, move)
        cost = after
        back.append(step)
    out, state = [], leave
    for step in reversed(back):
        state, move = step[state]
        out.append(move)
    return out[::-1]


def _role(column: Column) -> Column:
    name = F.lower(F.trim(column))
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), name)
    return F.coalesce(rank, F.lit(0)).cast("int")


ACTION = "action string, new_role string, inserted_before string, inserted_after string, cost bigint"
PLACED = ["conv_id", "turn", "role", "text", "code", "part", "seg", "pos"]


def actions(roles: list[int], entry: int, leave: int, last: bool) -> list[tuple]:
    """The ``ACTION`` columns of a run of turns between two states."""
    steps = path(roles, entry, leave)
    ends = INSERTS[leave, ASSISTANT] if last else ()
    out = []
    for k, (cost, _, action, role, before) in enumerate(steps):
        after = ends if k == len(steps) - 1 else ()
        names = (" ".join(STATES[x] for x in way) for way in (before, after))
        out.append((action, STATES[role], *names, cost + INSERT * len(after)))
    return out


def best_end(costs: dict[int, int]) -> int:
    return min(sorted(costs), key=lambda s: costs[s] + ENDS[s])


def ordered(turns: DataFrame, segment: int, conv_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """Turns with (part, seg, pos), their place in the order of conversations and turns, and
    their actions where a task sees the whole conversation.

    Rows are dealt by ranges of (conversation, turn, role, hash of the text), so one long
    conversation is spread over tasks; ties in all of these are copies. A segment is at most
    ``segment`` turns of one conversation in one task. A segment that may go on elsewhere has
    no actions; its first row holds the costs between its states.
    """
    own = turns.select(
        turns[conv_column].alias("conv_id"),
        turns[turn_column].alias("turn"),
        turns[role_column].cast("string").alias("role"),
        F.coalesce(turns[text_column].cast("string"), F.lit("")).alias("text"),
    ).withColumns({"code": _role(F.col("role")), "mark": F.xxhash64("role", "text")})
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "code", "mark")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = own.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("mark")
    names = [*PLACED, *[c.split()[0] for c in ACTION.split(", ")], "costs"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held, out = TaskContext.get().partitionId(), 0, [], []
        fits, first = False, True  # does the held segment begin its conversation; is it the task's first one

        def close(complete: bool) -> None:
            nonlocal seg
            codes = [r[4] for r in held]
            solved, costs = [(None,) * 5] * len(held), None
            if complete and fits and not first:
                ends = {s: c for s, c in enumerate(transfer(codes, (START,))[0]) if c < FAR}
                solved = actions(codes, START, best_end(ends), True)
            else:
                costs = sum(transfer(codes), [])
            out.extend((*r, part, seg, k, *a, costs if k == 0 else None) for k, (r, a) in enumerate(zip(held, solved)))
            seg += 1

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("conv_id", "turn")] + [pa.string()] * 2 + [pa.int32()] + [pa.int64()] * 3
            kinds += [pa.string()] * 4 + [pa.int64(), pa.list_(pa.int64())]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[0] != held[-1][0]:
                    close(True)
                    held, fits, first = [], True, False
                elif len(held) == segment:
                    close(False)
                    held, fits = [], False
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if held:
            close(False)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    kind = {c: own.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return sorted_rows.mapInArrow(
        place,
        f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text string, code int, part bigint, seg bigint, pos bigint, "
        f"{ACTION}, costs array<bigint>",
    )


def _join_segments(segments: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int]]:
    """(part, seg, entry, leave) of one conversation's segments along a cheapest way."""
    cost, back = {START: 0}, []
    for _, _, flat in segments:
        after: dict[int, int] = {}
        step: dict[int, int] = {}
        for s in sorted(cost):
            for t in range(4):
                c = cost[s] + flat[4 * s + t]
                if flat[4 * s + t] < FAR and c < after.get(t, FAR):
                    after[t], step[t] = c, s
        cost = after
        back.append(step)
    state = best_end(cost)
    out = []
    for (part, seg, _), step in zip(reversed(segments), reversed(back)):
        out.append((part, seg, step[state], state))
        state = step[state]
    return out[::-1]


def repair(
    turns: DataFrame,
    segment: int = 4096,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row for each turn: its action, its role after repair, the empty turns put before it
    (and after it, at a conversation's end), its cost, and its rendered piece of the conversation.

    A conversation is its pieces in the order of (part, seg, pos). Roles are compared without
    case and outer blanks; null and other roles are unknown and get relabelled. Null texts are
    empty. Turns are ordered by turn, then role, then text hash; a null turn comes first, null
    conversation ids form one conversation, repeated rows are turns of their own (they merge),
    an empty table gives no rows, other columns are ignored. Control marks inside texts are
    broken up so that they can't be read as turns.
    """
    placed, _ = keep(ordered(turns, segment, conv_column, turn_column, role_column, text_column))
    found = placed.where("costs IS NOT NULL").select("conv_id", "part", "seg", "costs")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["part", "seg"])
        joined = _join_segments(list(zip(rows["part"], rows["seg"], [list(c) for c in rows["costs"]])))
        return pd.DataFrame([(*x, k == len(joined) - 1) for k, x in enumerate(joined)], columns=["part", "seg", "entry", "leave", "last"])

    # one row of 16 numbers for each segment of a conversation
    states = found.groupBy("conv_id").applyInPandas(solve, "part bigint, seg bigint, entry int, leave int, last boolean")

    def act(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        entry, leave, last = (frame[c].iat[0] for c in ("entry", "leave", "last"))
        done = pd.DataFrame(actions(frame["code"].tolist(), int(entry), int(leave), bool(last)), columns=[c.split()[0] for c in ACTION.split(", ")])
        return pd.concat([frame[["part", "seg", "pos"]].reset_index(drop=True), done], axis=1)

    names = [c.split()[0] for c in ACTION.split(", ")]
    rest = placed.where("action IS NULL").drop(*names, "costs")
    acted = rest.select("part", "seg", "pos", "code").join(states, ["part", "seg"]).groupBy("part", "seg")
    late = rest.join(acted.applyInPandas(act, f"part bigint, seg bigint, pos bigint, {ACTION}"), ["part", "seg", "pos"])
    done = placed.where("action IS NOT NULL").drop("costs").unionByName(late)
    return done.drop("code").withColumn("piece", rendered_piece()).drop("text")


def rendered_piece() -> Column:
    """A turn's part of the rendered text; a merged turn goes on in the turn before it."""
    mark = lambda role: F.concat(F.lit("<|im_end|>\n<|im_start|>"), role, F.lit("\n"))
    empties = lambda c: F.concat_ws("", F.transform(F.filter(F.split(c, " "), lambda x: x != ""), mark))
    safe = F.replace(F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.concat(
        empties(F.col("inserted_before")),
        F.when(F.col("action").endswith("merge"), F.lit("\n")).otherwise(mark(F.col("new_role"))),
        safe,
        empties(F.col("inserted_after")),
    )


def render(repaired: DataFrame) -> DataFrame:
    """``(conv_id, rendered, cost)``: every conversation as one text, for those that fit a row."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "seg", "pos", "piece")))
    text = F.concat(F.array_join(F.transform(pieces, lambda x: x["piece"]), ""), F.lit("<|im_end|>\n"))
    opening = F.lit("<|im_end|>\n")  # every piece first closes the turn before it; the first has none
    return repaired.groupBy("conv_id").agg(F.substr(text, F.length(opening) + 1).alias("rendered"), F.sum("cost").alias("cost"))
