"""Conversation structure repair on a suffix-shared automaton of role and fault signatures.

A row is one symbol: its role class and its fault.  A conversation is the word of its symbols.  What
is cheapest from a row on depends only on the rows behind it, so words are read from the end and share
their suffixes: a node is a symbol in front of a node, and holds, for each state of the role grammar,
the cost to go, the edits taken there and the best audit suffix, worked out once for all
conversations of a task; the words come sorted from their ends, so that equal suffixes meet.

Two suffixes are also the same for everything in front of them if their costs to go differ by a
constant.  There are few such classes (CLASSES), whatever the data.  This cuts long conversations: rows
go into chunks of their order, a chunk maps the class behind it to the class in front of it, the chunks' maps
are followed from the end, and each chunk is then repaired by itself.  No conversation is held in
one piece; only its digest and audit, which are single values, are written in its order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import BATCH_ROWS, column, prepare, stored

#: Rows in a chunk: 2 ** CHUNK_BITS.
CHUNK_BITS = 12
#: Nodes that a task keeps before it starts anew; results do not depend on it.
NODES = 1 << 18
#: Nodes with longer suffixes do not hold their audit but point to it.
HELD = 64

# The role grammar (s?(ua)+)? : states start, after s, after u, after a.
STATES = range(4)
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a rerole or an insertion gives in each state, and the state after it.
GIVES, AFTER = "uuau", (2, 2, 3, 2)
NAMES = {"u": "user", "a": "assistant"}
#: Costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

ROLES, FAULTS = "suax", ("", "truncated", "blank", "duplicate")
#: Symbols A to P: role class times fault; what matters to the edits is fewer: `x` must go, else role and truncation.
SYMBOLS = {chr(65 + 4 * r + f): (ROLES[r], FAULTS[f]) for r in range(4) for f in range(4)}
KINDS = ["gone", *(role + cut for role in ROLES for cut in ("", "!"))]
KIND = {s: 0 if fault in ("blank", "duplicate") else KINDS.index(role + ("!" if fault else "")) for s, (role, fault) in SYMBOLS.items()}

Costs = tuple[int, ...]


def edits(kind: int, behind: Costs) -> tuple[Costs, list[str], list[int]]:
    """Of a row of this kind before costs to go: the costs, letters up to the row's own, and the state after, by state."""
    own: list[dict[str, tuple[int, int]]] = []
    name = KINDS[kind]
    for q in STATES:
        options = {"D": (DELETE + behind[q], q)}
        if kind:
            extra = TRUNCATED if name.endswith("!") else 0
            options["R"] = (REROLE + extra + behind[AFTER[q]], AFTER[q])
            if (q, name[0]) in KEEP:
                options["K"] = (extra + behind[KEEP[q, name[0]]], KEEP[q, name[0]])
        own.append(options)
    best = [min(c for c, _ in options.values()) for options in own]
    for _ in STATES:
        best = [min(best[q], INSERT + best[AFTER[q]]) for q in STATES]
    letters, after = [], []
    for q in STATES:
        taken = ""
        while True:  # the least letter among the cheapest; every insertion lowers the cost to go
            least = min((c, x) for x, c in [*((x, c) for x, (c, _) in own[q].items()), ("I", INSERT + best[AFTER[q]])])[1]
            taken += least
            if least != "I":
                break
            q = AFTER[q]
        letters.append(taken)
        after.append(own[q][least][1])
    return tuple(best), letters, after


#: Costs to go behind the last row: nothing, or insertions up to the end of a pair.
END: Costs = (0, 2 * INSERT, INSERT, 0)
END_AUDIT = ("", "II", "I", "")


def _classes() -> tuple[list[Costs], np.ndarray, np.ndarray]:
    """All classes of costs to go, the class in front of (kind, class), and the states after its edits."""
    found, front, after = [END], {}, {}
    for i in count():
        if i == len(found):
            break
        for kind in range(len(KINDS)):
            costs, _, after[kind, i] = edits(kind, found[i])
            plain = tuple(c - min(costs) for c in costs)
            if plain not in found:
                found.append(plain)
            front[kind, i] = found.index(plain)
    shape = (len(KINDS), len(found))
    return found, np.array([front[k] for k in np.ndindex(shape)]).reshape(shape), np.array([after[k] for k in np.ndindex(shape)]).reshape(*shape, 4)


CLASSES, FRONT, STEPS = _classes()


class Suffixes:
    """The nodes of suffixes: a kind of row in front of another node, the ends first."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.node: dict[tuple[int, int], int] = {}
        self.costs = [END, *CLASSES]
        self.audit: list[tuple[str, ...] | None] = [END_AUDIT, *[("",) * 4] * len(CLASSES)]
        self.letters: list[list[str]] = [[""] * 4] * len(self.costs)
        self.after: list[list[int]] = [list(STATES)] * len(self.costs)
        self.next = [-1] * len(self.costs)
        self.depth = [0] * len(self.costs)

    def add(self, word: str, end: int) -> int:
        """The node of a word before an end: -1 where the conversation ends, else the class of what follows."""
        if len(self.next) > NODES:
            self._clear()
        at = end + 1
        for symbol in reversed(word):
            key = (KIND[symbol], at)
            found = self.node.get(key)
            if found is None:
                costs, letters, after = edits(key[0], self.costs[at])
                held = self.audit[at]
                deep = self.depth[at] >= HELD or held is None
                self.costs.append(costs)
                self.audit.append(None if deep else tuple(letters[q] + held[after[q]] for q in STATES))
                self.letters.append(letters)
                self.after.append(after)
                self.depth.append(self.depth[at] + 1)
                self.next.append(at)
                found = self.node[key] = len(self.next) - 1
            at = found
        return at

    def best(self, node: int, state: int, end: int) -> tuple[int, str]:
        """The cost of the rows of a node from a state on, and their audit."""
        cost, parts = self.costs[node][state], []
        while self.audit[node] is None:
            parts.append(self.letters[node][state])
            node, state = self.next[node], self.after[node][state]
        parts.append(self.audit[node][state])
        if end >= 0:
            while self.next[node] >= 0:
                node, state = self.next[node], self.after[node][state]
            cost -= self.costs[node][state]
        return cost, "".join(parts)


def chunk_map(word: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class behind a word: the class in front of it, and where each state leads."""
    kinds = [KIND[s] for s in word]
    behind = np.zeros((len(word) + 1, len(ends)), np.int64)
    behind[-1] = ends
    for i in range(len(word) - 1, -1, -1):
        behind[i] = FRONT[kinds[i], behind[i + 1]]
    state = np.tile(np.arange(4), (len(ends), 1))
    for i, kind in enumerate(kinds):
        state = np.take_along_axis(STEPS[kind, behind[i + 1]], state, axis=1)
    return behind[0], state


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage of the query; NULLs are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20)).alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_"))
    return rows.drop("_")


def _ordered(rows: DataFrame) -> DataFrame:
    """All rows in the order of their conversations, written once: cid, chunk, place and the row's own columns.

    Ranges of the whole order go to tasks, so a long conversation is split; equal rows split by where they were read.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("cid"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.sha2("text", 256).alias("digest"),
        F.when(blank, 2).when(cut, 1).otherwise(0).alias("fault"), F.monotonically_increasing_id().alias("read"),
    )
    order = ["cid", "turn", "role", "digest", "read"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("read").withColumn("place", F.monotonically_increasing_id())
    return stored(rows.withColumn("chunk", F.shiftright("place", CHUNK_BITS)), "turns")


def _words(rows: DataFrame) -> DataFrame:
    """cid, chunk, word: the symbols of each chunk."""
    some = rows.select("cid", "chunk", "place", "role", "digest", "fault")
    first = some.where("fault <> 2").groupBy("cid", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    some = some.join(first, ["cid", "role", "digest"], "left")
    fault = F.when(F.col("fault") == 2, 2).when(F.col("place") > F.col("first"), 3).otherwise(F.col("fault"))
    role = F.coalesce(*(F.when(F.col("role").startswith(r), F.lit(i)) for i, r in enumerate(ROLES[:3])), F.lit(3))
    symbol = F.char(F.lit(65) + 4 * role + fault)
    return some.groupBy("cid", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", symbol.alias("s")))), lambda x: x["s"]), "").alias("word"))


def _resolved(words: DataFrame) -> DataFrame:
    """cid, chunk, word, end, state: what follows each chunk (-1 nothing, else its class), and the state before it.

    Only conversations of several chunks are followed, one summary row a chunk, as a stream.
    """
    sizes = words.groupBy("cid").agg(F.count("*").alias("n"), F.max("chunk").alias("last"))
    sized = stored(words.join(sizes, "cid"), "words")
    single = sized.where("n = 1").select("cid", "chunk", "word", F.lit(-1).alias("end"), F.lit(0).alias("state"))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fronts, states = [], []
            for word, chunk, last in zip(*(column(batch, c).to_pylist() for c in ("word", "chunk", "last"))):
                front, state = chunk_map(word, np.arange(1 if chunk == last else len(CLASSES)))
                fronts.append(front.tolist())
                states.append(state.ravel().tolist())
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (fronts, states)]
            yield pa.record_batch([*(column(batch, c) for c in ("cid", "chunk", "last")), *lists], ["cid", "chunk", "last", "fronts", "states"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = -1
        for batch in batches:
            ends, leads = [], []
            for chunk, last, fronts, states in zip(*(column(batch, c).to_pylist() for c in ("chunk", "last", "fronts", "states"))):
                end = -1 if chunk == last else end
                at = max(end, 0)
                ends.append(end)
                leads.append(states[4 * at : 4 * at + 4])
                end = fronts[at]
            yield pa.record_batch([column(batch, "cid"), column(batch, "chunk"), pa.array(ends, pa.int32()), pa.array(leads, pa.list_(pa.int32()))], ["cid", "chunk", "end", "leads"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for batch in batches:
            states = []
            for cid, leads in zip(column(batch, "cid").to_pylist(), column(batch, "leads").to_pylist()):
                state = state if cid == now else 0
                now = cid
                states.append(state)
                state = leads[state]
            yield pa.record_batch([column(batch, "cid"), column(batch, "chunk"), column(batch, "end"), pa.array(states, pa.int32())], ["cid", "chunk", "end", "state"])

    many = sized.where("n > 1").select("cid", "chunk", "last", "word").mapInArrow(summary, "cid string, chunk long, last long, fronts array<int>, states array<int>")
    many = many.repartition("cid").sortWithinPartitions("cid", F.desc("chunk")).mapInArrow(backward, "cid string, chunk long, end int, leads array<int>")
    many = many.repartition("cid").sortWithinPartitions("cid", "chunk").mapInArrow(forward, "cid string, chunk long, end int, state int")
    return single.unionByName(sized.select("cid", "chunk", "word").join(many, ["cid", "chunk"]))


def _plans(resolved: DataFrame) -> DataFrame:
    """cid, chunk, word, state, cost, audit: each chunk's cheapest edits, words sorted from their ends."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for batch in batches:
            found = []
            for word, end, state in zip(*(column(batch, c).to_pylist() for c in ("word", "end", "state"))):
                found.append(suffixes.best(suffixes.add(word, end), state, end))
            columns = [*(column(batch, c) for c in ("cid", "chunk", "word", "state")), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.record_batch(columns, ["cid", "chunk", "word", "state", "cost", "audit"])

    spread = resolved.withColumn("back", F.reverse("word"))
    spread = spread.repartitionByRange("end", "back", "cid", "chunk").sortWithinPartitions("end", "back").drop("back")
    return spread.mapInArrow(plan, "cid string, chunk long, word string, state int, cost long, audit string")


REPORT = "cid string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of one conversation while its chunks and rows go by."""

    def __init__(self, cid: str) -> None:
        self.cid, self.cost, self.audit = cid, 0, []
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.role = 0, ""
        self.low = self.high = None
        self.turns = 0
        self.hash, self.some = hashlib.sha256(), False
        self.left = iter(())

    def chunk(self, word: str, state: int, cost: int, audit: str) -> None:
        self.finish()
        self.cost += cost
        self.audit.append(audit)
        self.state, self.left = state, iter(audit)
        for symbol in word:
            role, fault = SYMBOLS[symbol]
            self.faults[fault] += 1
            self.illegal += bool(self.role) and self.role + role not in LEGAL
            self.role = role

    def _write(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.some else b"") + f"{role}:".encode())
        self.hash.update(text.encode())
        self.some = True

    def _give(self, text: str) -> None:
        self._write(NAMES[GIVES[self.state]], text)
        self.state = AFTER[self.state]

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        for letter in self.left:
            if letter == "I":
                self._give("")
                continue
            if letter == "R":
                self._give(text)
            elif letter == "K":
                self._write(role, text)
                self.state = KEEP[self.state, role[0]]
            break

    def finish(self) -> None:
        for _ in self.left:  # only insertions are left behind the last row
            self._give("")

    def report(self) -> tuple:
        self.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.cid, gaps, *(self.faults[f] for f in ("blank", "duplicate", "truncated")), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _reports(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """One row a conversation, its chunks' plans and its rows read in order as a stream."""
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    told = plans.select("cid", "chunk", F.lit(-1).cast("long").alias("place"), none("long", "turn"), none("string", "role"), none("string", "text"), "word", "state", "cost", "audit")
    said = rows.select("cid", "chunk", "place", "turn", "role", "text", none("string", "word"), none("int", "state"), none("long", "cost"), none("string", "audit"))
    both = told.unionByName(said).repartition("cid").sortWithinPartitions("cid", "chunk", "place")
    names = [c.split()[0] for c in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for cid, place, turn, role, text, word, state, cost, audit in zip(*(column(batch, c).to_pylist() for c in ("cid", "place", "turn", "role", "text", "word", "state", "cost", "audit"))):
                if now is None or cid != now.cid:
                    if now is not None:
                        done.append(now.report())
                    now = _Conversation(cid)
                if place < 0:
                    now.chunk(word, state, cost, audit)
                else:
                    now.row(turn, role, text)
            if len(done) >= BATCH_ROWS:
                yield batch_of(done)
                done = []
        if now is not None:
            yield batch_of([*done, now.report()])

    return both.mapInArrow(run, REPORT)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation (conv_id) of a table (conv_id, turn, role, text): faults, cost and audit of the cheapest repair.

    Rows are taken by turn, NULL first; rows of one turn by role and by the SHA-256 of their text.  The
    conversation of NULL ids is one of its own; other NULLs must be gone (see `damage`).  A role that begins
    with none of s, u, a can only be given another or deleted.  Empty and very long texts and
    repeated rows are rows as any; other columns do not matter.
    """
    prepare(rows.sparkSession)
    ordered = _ordered(rows)
    return _reports(ordered, _plans(_resolved(_words(ordered))))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report of every conversation of the given table after `damage`; one that lost all rows has zeros."""
    ids = conversations.select("conv_id").distinct()
    found = repair(damage(conversations))
    joined = ids.withColumn("cid", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))).join(found, "cid", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
