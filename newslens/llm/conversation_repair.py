"""Conversation structure repair: the cheapest edits that make a conversation one of ``(s?(ua)+)?`` by role initials.

A Viterbi search runs over the rows of a conversation in order. Its states are what the repaired conversation ends with so
far: nothing, a system turn, a user turn, an assistant turn. For every state the survivor - the cheapest edits that lead to
it, of equal costs the ASCII-least - is a leaf of a backpointer tree, whose nodes count their children and survivors; nodes
that nobody refers to go at once. As soon as all survivors descend from one node, the edits up to it are final and are
emitted. Deletions are counted on the survivor until its next other edit, so that any run of blank or repeated rows is one
number. A survivor goes when another one can follow any of its continuations for less: an assistant turn stands in for the
empty start at 4 more (a system turn to delete), and for a system turn at nothing. So the memory is that of the rows whose
edits are still open, a few as a rule, and not of the conversation. Survivors of one state and equal cost are compared by all
their open edits; the emitted part is common to them. One can't be a proper prefix of another: it would need an insertion, at
a cost.

A conversation is read by one task as a stream: Spark sorts the rows by conversation and turn, spilling where needed, and
repeated rows are flagged by a window in the same exchange. A conversation is never held in memory and its rows aren't
collected, but neither is it parted: the digest of its repaired text runs over all its rows in order, whoever computes it.

Cases: null roles and texts count as one space; rows without a turn come first; rows of one turn are ordered by role and
text; rows without a conversation id are one conversation without id; a role of another initial (or none) can't be kept; a
conversation without rows left has no edits, zeros and the digest of the empty string; empty tables give no rows; texts are
read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.llm.common import release

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of this initial, if it may follow.
_NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Edit = tuple[str, str | None, str | None]  # D, I, K or R; role and text of the repaired turn


class _Node:
    __slots__ = ("parent", "deletes", "edit", "refs")

    def __init__(self, parent: _Node | None, deletes: int, edit: Edit | None):
        self.parent, self.deletes, self.edit, self.refs = parent, deletes, edit, 0


class Repair:
    """One conversation, turn by turn. ``push`` and ``finish`` return the edits that became final."""

    def __init__(self):
        self.root = _Node(None, 0, None)
        self.survivors: dict[int, tuple[int, _Node, int]] = {}  # state: cost, node, deletions after it
        self._replace(self._closed({EMPTY: (0, self.root, 0, None)}))
        self.cost = 0

    def _edits(self, candidate: tuple) -> str:
        """All open edits of a candidate (cost, node, deletions, further edit)."""
        _, node, deletes, edit = candidate
        parts = [edit[0] if edit else "", "D" * deletes]
        while node is not self.root:
            parts += [node.edit[0], "D" * node.deletes]
            node = node.parent
        return "".join(reversed(parts))

    def _offer(self, best: dict[int, tuple], state: int, candidate: tuple) -> None:
        held = best.get(state)
        if held is None or candidate[0] < held[0] or candidate[0] == held[0] and self._edits(candidate) < self._edits(held):
            best[state] = candidate

    def _closed(self, best: dict[int, tuple]) -> dict[int, tuple]:
        """With insertions: to a user turn, then to an assistant turn. More in a row only come back at a cost."""
        settled = {}
        for state, (cost, node, deletes, edit) in best.items():
            if edit is not None:
                node, deletes, edit = _Node(node, deletes, edit), 0, None
                node.parent.refs += 1
            settled[state] = (cost, node, deletes, edit)
        for state, sources in ((USER, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            before = settled.get(state)
            for source in sources:
                if source in settled:
                    cost, node, deletes, _ = settled[source]
                    self._offer(settled, state, (cost + INSERT, node, deletes, ("I", _ROLE[state], "")))
            if state in settled and settled[state][3] is not None:
                cost, node, deletes, edit = settled[state]
                settled[state] = (cost, _Node(node, deletes, edit), 0, None)
                node.refs += 1
                if before is not None:
                    self._drop(before[1])
        return settled

    def _replace(self, settled: dict[int, tuple]) -> None:
        cost = {state: s[0] for state, s in settled.items()}
        never = 1 << 62
        if cost.get(ASSISTANT, never) + DELETE < cost.get(EMPTY, never) < never:
            self._drop(settled.pop(EMPTY)[1])
        if min(cost.get(ASSISTANT, never), cost.get(EMPTY, never)) < cost.get(SYSTEM, never) < never:
            self._drop(settled.pop(SYSTEM)[1])
        old = self.survivors
        self.survivors = {state: s[:3] for state, s in settled.items()}
        for _, node, _ in self.survivors.values():
            node.refs += 1
        for _, node, _ in old.values():
            node.refs -= 1
            self._drop(node)

    def _drop(self, node: _Node) -> None:
        """Forget a node that neither child nor survivor refers to, and its line as far as nobody else needs it."""
        while node.refs == 0 and node is not self.root and node.parent is not None:
            parent, node.parent = node.parent, None
            parent.refs -= 1
            node = parent

    def push(self, role: str, text: str, truncated: bool, doomed: bool) -> list[Edit]:
        """The next row; ``doomed`` rows must go."""
        best: dict[int, tuple] = {}
        extra = TRUNCATED if truncated else 0
        for state, (cost, node, deletes) in self.survivors.items():
            self._offer(best, state, (cost + DELETE, node, deletes + 1, None))
            if doomed:
                continue
            kept = _NEXT.get((state, role[:1]))
            if kept is not None:
                self._offer(best, kept, (cost + extra, node, deletes, ("K", role, text)))
            other = ASSISTANT if state == USER else USER
            self._offer(best, other, (cost + extra + REROLE, node, deletes, ("R", _ROLE[other], text)))
        self._replace(self._closed(best))
        return self._settled()

    def _settled(self) -> list[Edit]:
        """Edits that all survivors share; the tree then begins after them."""
        out: list[Edit] = []
        leaves = list(self.survivors.values())
        line, node = [], leaves[0][1]
        while node is not self.root:
            line.append(node)
            node = node.parent
        while line and self.root.refs == 1 and all(s[1] is not self.root for s in leaves):
            child = line.pop()
            out += [("D", None, None)] * child.deletes
            out.append(child.edit)
            self.root.refs -= 1
            child.parent, child.deletes, child.edit, self.root = None, 0, None, child
        if all(s[1] is self.root for s in leaves) and (shared := min(s[2] for s in leaves)):
            out += [("D", None, None)] * shared
            self.survivors = {state: (cost, node, deletes - shared) for state, (cost, node, deletes) in self.survivors.items()}
        return out

    def finish(self) -> list[Edit]:
        """The rest of the cheapest edits; ``cost`` is then that of all."""
        ends = [(*self.survivors[s], None) for s in (EMPTY, ASSISTANT) if s in self.survivors]
        least = min(e[0] for e in ends)
        self.cost, node, deletes, _ = min((e for e in ends if e[0] == least), key=self._edits)
        line = []
        while node is not self.root:
            line.append(node)
            node = node.parent
        out: list[Edit] = []
        for n in reversed(line):
            out += [("D", None, None)] * n.deletes
            out.append(n.edit)
        return out + [("D", None, None)] * deletes


def _last_solid(text: str) -> str | None:
    stripped = text.rstrip(_BLANKS)
    return stripped[-1] if stripped else None


class _Report:
    """Counts and digest of one conversation."""

    def __init__(self, conv):
        self.conv, self.repair = conv, Repair()
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, turn, role: str, text: str, repeated: bool) -> list[Edit]:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        end = _last_solid(text)
        blank, duplicate = end is None, end is not None and repeated
        truncated = not blank and not duplicate and end not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        return self.take(self.repair.push(role, text, truncated, blank or duplicate))

    def take(self, edits: list[Edit]) -> list[Edit]:
        for op, role, text in edits:
            self.audit.append(op)
            if op != "D":
                self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
                self.lines += 1
        return edits

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.repair.cost, "".join(self.audit), self.digest.hexdigest())


def _ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, present) by conversation and turn, with whether a role and text occurred before."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "present").repartition("conv_id")
    same = Window.partitionBy("conv_id", "present", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))
    flagged = dealt.withColumn("repeated", F.row_number().over(same) > 1)
    return flagged.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "repeated")


def _reports(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Report, list[Edit], bool]]:
    """Every report with its newly final edits, and whether it is complete."""
    report = None
    for batch in batches:
        for conv, turn, role, text, present, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "repeated"))):
            if report is None or report.conv != conv:
                if report is not None:
                    yield report, report.take(report.repair.finish()), True
                report = _Report(conv)
            if present:
                yield report, report.add(turn, role, text, repeated), False
    if report is not None:
        yield report, report.take(report.repair.finish()), True


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    release()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _named(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), (F.lit(True) if present is None else present).alias("present"))


def audits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation. Rows that aren't
    ``present`` only name their conversation."""
    ordered = _ordered(_named(rows, conv, turn, role, text, present))
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.column("conv_id").type), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        yield from _batches((r.row() for r, _, done in _reports(_chain(first, batches)) if done), schema)

    found = ordered.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("conv_id", conv)


def edits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired conversations: (conv, step, edit, role, text), a row for each edit in order; a deletion has neither role nor text."""
    ordered = _ordered(_named(rows, conv, turn, role, text, present))
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.column("conv_id").type), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

        def numbered() -> Iterator[tuple]:
            step, of = 0, None
            for report, some, _ in _reports(_chain(first, batches)):
                if report is not of:
                    step, of = 0, report
                for op, r, t in some:
                    yield report.conv, step, op, r, t
                    step += 1

        yield from _batches(numbered(), schema)

    found = ordered.mapInArrow(run, f"conv_id {kind}, step long, edit string, role string, text string")
    return found.withColumnRenamed("conv_id", conv)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` modulo 20 - 0 drops a row (present is
    false), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))), F.lit(20))
    marked = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = marked.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"),
                         F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return once.drop("copy")
