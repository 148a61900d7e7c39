"""Conversation structure repair: cheapest edits by a graph of tight arcs, seen from both ends.

A conversation's rows, in order, are read by an automaton whose accepted sequences of role initials are
`(s?(ua)+)?`. A node is a row's place and a state. An edit is an arc: keep, rerole and delete lead over
a row, insert stays before it. Minimum costs from the start and to the end, added to an arc's own cost,
tell which arcs lie on a cheapest path (the tight ones); they form a graph without cycles, as an insert
costs something and every other edit passes a row. A set of nodes, the frontier, then moves along it:
at each step it takes the least letter that any tight arc from it bears, and all nodes that this letter leads to.

Rows of a conversation are brought together once, ordered; equal rows of one turn are counted before that,
so copies don't travel. A task keeps some forty bytes a row of the conversation at hand while it looks for the edits
(the audit has a letter a row anyway), and no text; texts stream by a second time, past the known edits,
into the repaired text's hash. So one conversation may hold a third of all rows.

Nulls in role and text are one blank, as are null conv_id and turn in the key of the damage. Rows without a conv_id are a
conversation of their own; rows without a turn come first. Rows of one turn are ordered by role, then text. The initial of
an empty role is none of s, u and a. Repeated rows are duplicates; a copy of a row follows it. Texts may have any length. An
empty table gives no rows. Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.session import cut

from ._memory import freed

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an initial; accepted at the end are START and ASSISTANT.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTED = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = "b", "d", "t"
FAR = float("inf")
BATCH = 4096


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text of the rows after damage, equal ones as one row with its number of copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    kept = rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return kept.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("copies"))


def _fault(first: Column) -> Column:
    """The row's first fault: blank, seen earlier, without an end."""
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(end == "", BLANK_FAULT).when(~first, DUPLICATE_FAULT).when(~end.isin(".", "!", "?"), TRUNCATED_FAULT).otherwise("")


class Graph:
    """The edits of one conversation. rows: initial and fault of each row."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.rows, n = rows, len(rows)
        self.ahead = [[FAR] * 4 for _ in range(n + 1)]
        self.behind = [[FAR] * 4 for _ in range(n + 1)]
        self.ahead[0][START] = 0
        for k in range(n + 1):
            self._settle(self.ahead[k], k)
            for q in range(4):
                for _, cost, place, state in self.arcs(k, q):
                    if place > k:
                        self.ahead[place][state] = min(self.ahead[place][state], self.ahead[k][q] + cost)
        for q in ACCEPTED:
            self.behind[n][q] = 0
        for k in range(n, -1, -1):
            for _ in range(3):  # an insert leads to another state of the same place
                for q in range(4):
                    for _, cost, place, state in self.arcs(k, q):
                        self.behind[k][q] = min(self.behind[k][q], cost + self.behind[place][state])
        self.cost = self.behind[0][START]

    def _settle(self, costs: list[float], k: int) -> None:
        for _ in range(3):
            for q in range(4):
                for _, cost, place, state in self.arcs(k, q):
                    if place == k:
                        costs[state] = min(costs[state], costs[q] + cost)

    def arcs(self, k: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """Letter, cost, place and state of every edit at a node."""
        for initial in ROLES:
            if initial in NEXT[q]:
                yield "I", INSERT, k, NEXT[q][initial]
        if k == len(self.rows):
            return
        own, fault = self.rows[k]
        yield "D", DELETE, k + 1, q
        if fault in (BLANK_FAULT, DUPLICATE_FAULT):
            return
        left = TRUNCATED if fault == TRUNCATED_FAULT else 0
        if own in NEXT[q]:
            yield "K", left, k + 1, NEXT[q][own]
        for initial in ROLES:
            if initial in NEXT[q]:
                yield "R", REROLE + left, k + 1, NEXT[q][initial]

    def audit(self) -> str:
        """The letters of the cheapest edits, of several the least in order of their characters."""
        letters, frontier, n = [], {(0, START)}, len(self.rows)
        while not any(k == n and q in ACCEPTED for k, q in frontier):
            tight: dict[str, set[tuple[int, int]]] = {}
            for k, q in frontier:
                for letter, cost, place, state in self.arcs(k, q):
                    if self.ahead[k][q] + cost + self.behind[place][state] == self.cost:
                        tight.setdefault(letter, set()).add((place, state))
            letter = min(tight)
            frontier = tight[letter]
            letters.append(letter)
        return "".join(letters)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of each conversation of ordered rows (copies of a row are told once)."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [*[pa.int64()] * 7, pa.string()]
    out: list[tuple] = []
    rows: list[tuple[str, str]] = []
    turns, low, high, before, illegal = 0, None, None, None, 0
    key = began = None

    def done() -> tuple:
        graph = Graph(rows)
        faults = [f for _, f in rows]
        gaps = high - low + 1 - turns if turns else 0
        return (key[0], gaps, *map(faults.count, (BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT)), illegal, int(graph.cost), graph.audit())

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv, turn, initial, fault, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies")), strict=True):
            if not began or (conv,) != key:
                if began:
                    out.append(done())
                    if len(out) >= BATCH:
                        yield batch_of(out)
                        out = []
                key, began = (conv,), True
                rows, turns, low, high, before, illegal = [], 0, None, None, None, 0
            for k in range(copies):
                rows.append((initial, fault if not k or fault == BLANK_FAULT else DUPLICATE_FAULT))
                illegal += before is not None and before + initial not in LEGAL
                before = initial
            if turn is not None:
                turns += turn != high
                low, high = turn if low is None else low, turn
    if began:
        out.append(done())
    if out:
        yield batch_of(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's repaired text; its audit comes before its rows."""
    out: list[tuple] = []
    key = audit = None
    at, state, lines, digest = 0, START, 0, hashlib.sha256()

    def put(role: str, text: str) -> None:
        nonlocal lines
        digest.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
        lines += 1

    def fill() -> None:
        """What is inserted before the next row, or at the end."""
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            initial = next(i for i in ROLES if i in NEXT[state])
            put(ROLES[initial], "")
            at, state = at + 1, NEXT[state][initial]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.string()), strict=True)], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, told, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")), strict=True):
            if told is not None:
                if key is not None:
                    fill()
                    out.append((key[0], digest.hexdigest()))
                    if len(out) >= BATCH:
                        yield batch_of(out)
                        out = []
                key, audit, at, state, lines, digest = (conv,), told, 0, START, 0, hashlib.sha256()
                continue
            for _ in range(copies):
                fill()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                initial = role[:1] if letter == "K" else next(i for i in ROLES if i in NEXT[state])
                put(role if letter == "K" else ROLES[initial], text)
                state = NEXT[state][initial]
    if key is not None:
        fill()
        out.append((key[0], digest.hexdigest()))
    if out:
        yield batch_of(out)


def repair(conversations: DataFrame) -> DataFrame:
    """A row for every conv_id of the table: counts of faults, the cheapest edits and the repaired text's hash."""
    rows = damaged(conversations).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    known = rows.withColumn("first", F.row_number().over(earlier) == 1)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    brief = known.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), _fault(F.col("first")).alias("fault"), "copies").sortWithinPartitions(*order)
    counts = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    judged = cut(brief.select("conv_id", "turn", "initial", "fault", "copies").mapInArrow(freed(_judged), counts))
    told = judged.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    both = told.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *order[1:])
    hashed = both.select("conv_id", "role", "text", "copies", "audit").mapInArrow(freed(_hashed), "conv_id long, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").cast("long").alias("every")).distinct()
    found = judged.join(hashed.withColumnRenamed("conv_id", "hashed"), F.col("conv_id").eqNullSafe(F.col("hashed")))
    found = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(F.col("every").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
