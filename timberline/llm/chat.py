"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, and ends with
the assistant.  Each given turn is kept, given another role, or merged into the turn before; empty
turns can be put in.  Dynamic programming over the automaton of legal turns finds the cheapest
repair.  A turn is then a 4 x 4 matrix of costs between the states start, system, user, assistant,
and turns in a row are the (min, +) product of their matrices.  So a conversation of any length is
cut into chunks: chunks give their matrices, one row each; the cheapest states at the cuts follow
from those; and each chunk then finds its own turns between its two states.  Chunks are cut by the
rank of a row in its conversation, whatever its turn: all rows are sorted over ranges, in which equal
rows are told apart, and ranks are the rows of a conversation in the ranges before and the place here.

Order of turns: turn (NULL last), role, text.  A NULL conv_id is a conversation of its own.  Roles
count without case and outer blanks; a role that is NULL or not among the three can be given
any role.  NULL texts are empty.  Further columns are not read.  Of equally cheap repairs one is
chosen by a fixed order: keep, merge, relabel, insert as late as possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import partitions, prepare, stored

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal next states.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, NAME, INSERT = 1, 3, 1, 4  # NAME: a role for a turn without a known one
END = ASSISTANT
CHUNK = 4096
INFINITE = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
ROWS = "conv_id long, turn long, chunk long, place int, piece int, role string, action string, rendered string, cost long"


def _insertions() -> tuple[np.ndarray, list[list[list[int]]]]:
    """Cheapest empty turns from one state to another: the costs, and the states gone through."""
    cost = np.full((4, 4), INFINITE)
    path: list[list[list[int]]] = [[[] for _ in range(4)] for _ in range(4)]
    for a in range(4):
        cost[a, a] = 0
        reached = [a]
        for x in reached:
            for y in NEXT[x]:
                if cost[a, y] == INFINITE:
                    cost[a, y], path[a][y] = cost[a, x] + INSERT, [*path[a][x], y]
                    reached.append(y)
    return cost, path


GAP, GAP_PATH = _insertions()


def steps(kind: int) -> list[list[tuple[int, str, int, int]]]:
    """For each pair of states, encoded 4 * before + after: the cheapest way (cost, action, role, state before its own turn).

    `kind` is 1, 2, 3 for the known roles and 0 for others.
    """
    out: list[list[tuple[int, str, int, int]]] = [[] for _ in range(16)]
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            rename = 0 if kind == after else NAME if kind == 0 else RELABEL
            ways = []
            if after == before:
                ways.append((MERGE + rename, "merge", after, before))
            for middle in range(4):
                if after in NEXT[middle] and GAP[before, middle] < INFINITE:
                    name = "keep" if rename == 0 else "relabel"
                    ways.append((int(GAP[before, middle]) + rename, name, after, middle))
            order = ("keep", "merge", "relabel")
            out[4 * before + after] = sorted(ways, key=lambda w: (w[0], order.index(w[1]), w[3]))
    return out


STEPS = [steps(kind) for kind in range(4)]
#: Cost of the cheapest way of each kind of turn between two states.
COST = np.array([[[s[4 * a + b][0][0] if s[4 * a + b] else INFINITE for b in range(4)] for a in range(4)] for s in STEPS])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), INFINITE)


def repair(kinds: list[int], start: int, end: int) -> list[tuple[list[int], str, int]]:
    """The cheapest repair between two states: for each turn the states put in before it, its action and its role."""
    best = np.full((len(kinds) + 1, 4), INFINITE)
    best[0, start] = 0
    for i, kind in enumerate(kinds):
        best[i + 1] = np.minimum((best[i][:, None] + COST[kind]).min(0), INFINITE)
    out, state = [], end
    for i in range(len(kinds) - 1, -1, -1):
        rest = best[i] + COST[kinds[i]][:, state]
        before = int(np.argmin(rest))
        _, action, role, middle = STEPS[kinds[i]][4 * before + state][0]
        out.append((GAP_PATH[before][middle] if action != "merge" else [], action, role))
        state = before
    return out[::-1]


def turns_of(conversations: DataFrame) -> DataFrame:
    kind = F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))))
    number = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, r in enumerate(ROLES) for x in (r, i + 1))), kind), F.lit(0))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        number.cast("int").alias("kind"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def in_chunks(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows with their chunk, and with `row`, a number in the order of each conversation."""
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text", "tie"]
    given = stored(turns.withColumn("tie", F.monotonically_increasing_id()), "given")
    ranged = given.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    # in this number, which is stored, the range stands above the place inside it
    rows = stored(ranged.drop("tie").withColumn("row", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("range", F.shiftright("row", 33))
    cells = rows.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cells = cells.select(F.col("conv_id").alias("conv"), F.col("range").alias("part"), "first", "before")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("range") == F.col("part"))
    rank = F.col("before") + F.col("row") - F.col("first")
    return rows.join(cells, same).select(*turns.columns, "row", F.floor(rank / chunk).cast("long").alias("chunk"))


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """Rows of one conversation and chunk; they come one after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.select(names).to_pylist():
            if held and (row["conv_id"], row["chunk"]) != (held[0]["conv_id"], held[0]["chunk"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: list[tuple] = []

    def out() -> pa.RecordBatch:
        conv, chunk, cost = zip(*made)
        return pa.record_batch([pa.array(conv, pa.int64()), pa.array(chunk, pa.int64()), pa.array(cost, pa.list_(pa.int64()))], ["conv_id", "chunk", "cost"])

    for rows in _chunks(batches, ["conv_id", "chunk", "kind"]):
        whole = None
        for row in rows:
            whole = COST[row["kind"]] if whole is None else product(whole, COST[row["kind"]])
        made.append((rows[0]["conv_id"], rows[0]["chunk"], whole.ravel().tolist()))
        if len(made) >= 1000:
            yield out()
            made = []
    if made:
        yield out()


PLAN = "conv_id long, chunk long, entry int, exit int, total long, last boolean"


def _plan(group: pa.Table) -> pa.Table:
    """States at the cuts of one conversation, from the matrices of its chunks."""
    group = group.sort_by("chunk")
    matrices = [np.array(x).reshape(4, 4) for x in group.column("cost").to_pylist()]
    best = [np.where(np.arange(4) == START, 0, INFINITE)]
    for m in matrices:
        best.append(np.minimum((best[-1][:, None] + m).min(0), INFINITE))
    final = best[-1] + GAP[:, END]
    state = int(np.argmin(final))
    total, states = int(final[state]), [state]
    for b, m in zip(best[-2::-1], matrices[::-1]):
        state = int(np.argmin(b + m[:, state]))
        states.append(state)
    states.reverse()
    n = len(matrices)
    return pa.table(
        {
            "conv_id": group.column("conv_id"), "chunk": group.column("chunk"), "entry": pa.array(states[:-1], pa.int32()),
            "exit": pa.array(states[1:], pa.int32()), "total": pa.array([total] * n, pa.int64()), "last": pa.array([i == n - 1 for i in range(n)]),
        }
    )


def escaped(text: str) -> str:
    """A text that holds no mark of the template: `<|` becomes `<||`, which no mark begins with."""
    return text.replace("<|", "<||")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "chunk", "turn", "role", "kind", "text", "entry", "exit", "total", "last"]
    made: list[tuple] = []

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
        columns = ["conv_id", "turn", "chunk", "place", "piece", "role", "action", "rendered", "cost"]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made), kinds)], columns)

    for rows in _chunks(batches, names):
        first = rows[0]
        conv, total, opened = first["conv_id"], first["total"], first["entry"] != START
        chosen = repair([r["kind"] for r in rows], first["entry"], first["exit"])
        for i, (row, (put_in, action, role)) in enumerate(zip(rows, chosen)):
            pieces = []
            for state in put_in:
                pieces.append((ROLES[state - 1], "insert", (CLOSE if opened else "") + OPEN.format(ROLES[state - 1])))
                opened = True
            name = ROLES[role - 1]
            if action == "merge":
                action = "merge" if row["kind"] == role else "merge relabel"
                pieces.append((name, action, "\n" + escaped(row["text"])))
            else:
                pieces.append((name, action, (CLOSE if opened else "") + OPEN.format(name) + escaped(row["text"])))
                opened = True
            if first["last"] and i == len(rows) - 1:
                for state in GAP_PATH[first["exit"]][END]:
                    pieces.append((ROLES[state - 1], "insert", CLOSE + OPEN.format(ROLES[state - 1])))
                pieces[-1] = (*pieces[-1][:2], pieces[-1][2] + CLOSE)
            made += [(conv, row["turn"], row["chunk"], i, p, r, a, text, total) for p, (r, a, text) in enumerate(pieces)]
            if len(made) >= 1000:
                yield out()
                made.clear()
    if made:
        yield out()


def format_chats(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations in pieces.

    One row per given turn and one per empty turn put in: conv_id, turn (of an empty turn that of
    its neighbour), chunk, place (of the turn in its chunk), piece (at one place), role, action
    (keep, relabel, merge, merge relabel, insert), rendered, cost (of the whole conversation).
    The pieces of a conversation in order of chunk, place and piece, joined, are its text:
    `<|role|>`, a line end, the text and `<|end|>` for each turn, and a line end between texts that
    were merged.  `<|` in a text is written `<||`, so that no text can pass for a turn.  An empty table gives an empty result.
    """
    prepare(conversations.sparkSession)
    rows = stored(in_chunks(turns_of(conversations), chunk), "chunks")
    by = ["conv_id", "chunk"]
    dealt = rows.select(*by, "row", "kind").repartition(*by).sortWithinPartitions(*by, "row")
    matrices = dealt.select(*by, "kind").mapInArrow(_matrices, "conv_id long, chunk long, cost array<long>")
    plan = matrices.groupBy("conv_id").applyInArrow(_plan, PLAN)
    same = rows["conv_id"].eqNullSafe(plan["conv_id"]) & (rows["chunk"] == plan["chunk"])
    joined = rows.join(plan, same).select(*(rows[c] for c in rows.columns), "entry", "exit", "total", "last")
    return joined.repartition(*by).sortWithinPartitions(*by, "row").mapInArrow(_render, ROWS)
