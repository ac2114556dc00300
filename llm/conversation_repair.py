"""Conversation repair by one integer minimum over edits.

A conversation's rows are kept, given another role, deleted, or completed by inserted empty
rows, so that the initials of its roles read ``(s?(ua)+)?``: an optional system row, then
users and assistants in turn. Of the cheapest edits those count whose audit, the string of
edits' initials in order, is the least in ASCII order.

Both questions are one integer minimum. The weight of a way to finish a conversation is one
big integer: its high digits hold the cost, its low digits the audit's letters from the first
on, in as many places as any audit can have, with zeros after the last letter. So weights
compare by cost, then by audit, an audit that ends earlier being the lesser. The nodes of the DAG are
(row, what the grammar has read); taken from the last row to the first, a node's weight is the
least over its edges of the edge's cost and letter put before the weight of where it leads.
The least weight's digits are the answer: nothing else is kept, compared or traced back.

A conversation's rows are read twice in one sorted stream: first what the decision needs
(an initial, three flags and a digest a row), then the rows themselves, which are edited, hashed and
forgotten. So a task never holds the texts of a conversation, and one of any length
streams through. Its weights grow with its rows, so time grows with the square of a conversation's rows
(README has figures). One conversation is one task's work, since a hash of its text has one order.

Defined results: a null role, text, id or turn counts as one space, and a null id is a
conversation of its own. Rows with the same turn are taken by role and by the MD5 of the text, equal rows one after
the other. Null turns come first. A conversation without rows has zeros, an empty audit and no text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import SPACES, ship

#: Initials of the edits by their digit; 0 ends an audit. In ASCII order, as ties are decided by it.
LETTERS = "\0DIKR"
BITS = 3
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: What the grammar has read: nothing, the system row, a user, an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads from each of these, and the role that an insertion or a new role has there.
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def damaged(conversations: DataFrame, hashed: Column) -> DataFrame:
    """Rows (conv_id, turn, role, text, times) with a fault by ``hashed`` modulo 20: 0 dropped (times 0), 1 emptied,
    2 without ``[.!?]``, 3 repeated (times 2), 4 with the role user. Nulls of role and text are one space."""
    h = F.pmod(hashed, F.lit(20))
    blank = F.lit(" ")
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    return conversations.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("times"), F.md5(text.cast("binary")).alias("tie"), role.alias("own_role"),
    )


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit for rows (initial, has to go, truncated) by one integer minimum."""
    places = 2 * len(rows) + 2  # before each row and at the end at most one insertion pays; two are weighed
    places += len(rows) + 2
    top, first = BITS * places, BITS * (places - 1)
    letters = (1 << top) - 1

    def before(letter: int, cost: int, rest: int) -> int:
        """The weight of an edit followed by what ``rest`` weighs: its letters move one place on."""
        return ((rest >> top) + cost << top) + (letter << first) + ((rest & letters) >> BITS)

    def inserted(rest: list[int | None]) -> list[int]:
        """The least of no, one and two insertions; more come back to the same node at a cost."""
        one = [None if rest[NEXT[s]] is None else before(INSERT, 2, rest[NEXT[s]]) for s in range(4)]
        two = [None if one[NEXT[s]] is None else before(INSERT, 2, one[NEXT[s]]) for s in range(4)]
        return [min(w for w in ways if w is not None) for ways in zip(rest, one, two, strict=True)]

    best = inserted([0, None, None, 0])
    for initial, gone, truncated in reversed(rows):
        row = []
        for s in range(4):
            ways = [before(DELETE, 3, best[s])]
            if not gone:
                if initial in MOVES[s]:
                    ways.append(before(KEEP, int(truncated), best[MOVES[s][initial]]))
                ways.append(before(REROLE, 2 + truncated, best[NEXT[s]]))
            row.append(min(ways))
        best = inserted(row)
    weight = best[START]
    digits, audit = weight & letters, []
    while digits:
        audit.append(LETTERS[digits >> first])
        digits = (digits << BITS) & letters
    return weight >> top, "".join(audit)


class Repair:
    """One conversation of the stream: first ``note`` for every row, then ``decide``, then ``edit`` for every row."""

    def __init__(self):
        import hashlib

        self.rows, self.seen, self.turns = [], set(), []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.sha, self.first, self.state = hashlib.sha256(), True, START
        self.audit, self.at, self.cost = None, 0, 0

    def note(self, times: int, turn, initial: str, blank: bool, truncated: bool, digest: str) -> None:
        for _ in range(times):
            fault = "blank" if blank else "duplicate" if digest in self.seen else "truncated" if truncated else None
            self.seen.add(digest)
            if fault:
                self.count[fault] += 1
            if self.rows and (self.rows[-1][0], initial) not in LEGAL:
                self.count["illegal"] += 1
            self.rows.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if times and turn is not None and (not self.turns or self.turns[2] != turn):
            # sorted by turn: the first, how many different ones, the last
            self.turns = [self.turns[0], self.turns[1] + 1, turn] if self.turns else [turn, 1, turn]

    def decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest(self.rows)
            self.rows, self.seen = [], set()

    def _written(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self._written(ROLES[self.state], "")
            self.at += 1

    def edit(self, times: int, role: str, text: str) -> None:
        self.decide()
        for _ in range(times):
            self._insert()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.state = MOVES[self.state][role[:1]]
                self._written(role, text)
            elif letter == "R":
                self.state = NEXT[self.state]
                self._written(ROLES[self.state], text)

    def result(self) -> dict:
        self.decide()
        self._insert()
        gaps = self.turns[2] - self.turns[0] + 1 - self.turns[1] if self.turns else 0
        return {"gaps": gaps, **self.count, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.sha.hexdigest()}


def _stream(rows: DataFrame) -> DataFrame:
    """Each row once for the decision and once, later, as it is; conversations whole and in order within a partition."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    flags = {"blank": bare == "", "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "digest": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))}
    none = F.lit("")
    light = F.struct(F.lit(0).alias("phase"), F.substring("role", 1, 1).alias("role"), none.alias("text"), *[c.alias(n) for n, c in flags.items()])
    whole = F.struct(F.lit(1).alias("phase"), F.col("role"), F.col("text"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), none.alias("digest"))
    both = rows.select("conv_id", "turn", "times", "tie", "own_role", F.explode(F.when(F.col("times") > 0, F.array(light, whole)).otherwise(F.array(light))).alias("r"))
    order = [F.asc_nulls_first("conv_id"), "r.phase", F.asc_nulls_first("turn"), "own_role", "tie"]
    dealt = both.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "r.phase", "turn", "times", "r.role", "r.text", "r.blank", "r.truncated", "r.digest")


def _rows(batches) -> Iterator[tuple[bool, tuple]]:
    """Rows of the sorted stream with a flag: whether the row is the first of its conversation."""
    from llm.tokens import in_batches

    last, begun = None, False
    for batch in batches:
        for a, b in in_batches(batch.column("text")):
            for row in zip(*[column.slice(a, b - a).to_pylist() for column in batch.columns], strict=True):
                new = not begun or row[0] != last
                last, begun = row[0], True
                yield new, row


def repaired(conversations: DataFrame, fault: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ship(conversations.sparkSession)
    rows = (fault or undamaged)(conversations)

    def run(batches):
        import pyarrow as pa

        found: list[tuple] = []

        def table():
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
            columns = [pa.array([c for c, _ in found], kind), *[pa.array([r[n] for _, r in found], pa.int64()) for n in names]]
            columns += [pa.array([r[n] for _, r in found], pa.string()) for n in ("audit", "repaired_sha256")]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *names, "audit", "repaired_sha256"])

        now, conv, kind = None, None, None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for new, (conv_id, phase, turn, times, role, text, blank, truncated, digest) in _rows(typed()):
            if new:
                if now is not None:
                    found.append((conv, now.result()))
                now, conv = Repair(), conv_id
                if len(found) >= 5_000:
                    yield table()
                    found.clear()
            if phase:
                now.edit(times, role, text)
            else:
                now.note(times, turn, role, blank, truncated, digest)
        if now is not None:
            found.append((conv, now.result()))
            yield table()

    kind = conversations.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{n} bigint" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _stream(rows).mapInArrow(run, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, once each, in the form of ``damaged``."""
    return damaged(conversations, F.lit(5))
