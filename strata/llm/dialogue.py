"""Conversation structure repair by a checkpointed dynamic program.

A conversation is its rows by turn (null turns first; rows of one turn by role,
then by a hash of their text). Each row's first fault counts: blank (no character
but white space), duplicate (an earlier row has its role and text), truncated (its
last character that is no white space is none of ``.!?``). The repair is the
cheapest list of edits after which the initials of the roles read ``(s?(ua)+)?``:

    D  delete a row                     4, required for blank and duplicate rows
    I  insert an empty user or
       assistant row, anywhere          3
    K  keep a row                       0, and 3 more if it is truncated
    R  rerole a row to user or
       assistant                        3, and 3 more if it is truncated

Of lists of equal cost the one whose letters are the least ASCII string counts.

Four states (nothing yet, after a system row, after a user row, after an
assistant row) make the program. A first pass reads a conversation's rows
backwards, without their texts, and holds the vector of the states' costs only at
checkpoints, about the square root of the rows apart: when there are too many,
every second one goes and their distance doubles, so the number of rows need not be
known. A second pass reads the rows forwards in blocks that end at a checkpoint,
computes a block's vectors again from there, and walks through it along tight edits.
So a task holds two square roots of a conversation, whatever its length, apart from
the audit string it returns. The rows of both passes are sorted by Spark and
streamed. A conversation passes through one task of each pass, as SHA-256
over its repaired text can only be taken in order; what needs no order (faults,
which text came first) is computed over all tasks with partial aggregates.

Nulls: a null role or text counts as one space, a null conv_id is a conversation of
its own. Equal rows are duplicates of the first. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strata.llm.common import staged

# What the edits cost, white space, the marks that end a sentence.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# States: nothing yet, after a system, a user, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The state after the user or assistant row that may follow each state, and its role.
_WANTED = [USER, USER, ASSISTANT, USER]
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FINAL = (START, ASSISTANT)

# Faults of a row, as numbers; 0 is none.
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(2):
        for s in (USER, ASSISTANT, START, SYSTEM):
            costs[s] = min(costs[s], INSERT + costs[_WANTED[s]])
    return costs


def _at_end() -> list[int]:
    return _with_inserts([0 if s in _FINAL else 1 << 62 for s in range(4)])


def _before(after: list[int], initial: str, fault: int) -> list[int]:
    """The states' costs before a row, from those after it."""
    out = [DELETE + c for c in after]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        for s in range(4):
            out[s] = min(out[s], REROLE + more + after[_WANTED[s]])
            kept = _NEXT.get((s, initial))
            if kept is not None:
                out[s] = min(out[s], more + after[kept])
    return _with_inserts(out)


class Backward:
    """Costs of a conversation whose rows come last to first, held at checkpoints."""

    def __init__(self) -> None:
        self.n, self.step = 0, 1
        self.costs = _at_end()
        # The vector with 0, step, 2 * step ... rows after it.
        self.held = [self.costs]

    def add(self, initial: str, fault: int) -> None:
        self.costs = _before(self.costs, initial, fault)
        self.n += 1
        if self.n % self.step == 0:
            self.held.append(self.costs)
            if len(self.held) > 2 * self.step + 2:
                self.held = self.held[::2]
                self.step *= 2


class Forward:
    """The edits of a conversation whose rows come first to last, block by block."""

    def __init__(self, n: int, step: int, held: list[int]):
        self.left, self.step = n, step
        self.held = held
        self.state, self.block = START, []

    def add(self, row: tuple) -> Iterator[tuple]:
        """``row``: (initial, fault, ...). Yields (letter, new role or None, row or None) once its block is full."""
        self.block.append(row)
        self.left -= 1
        if self.left % self.step == 0:
            yield from self._walk()

    def _walk(self) -> Iterator[tuple]:
        at = self.left // self.step * 4
        vectors = [self.held[at : at + 4]]
        for row in reversed(self.block):
            vectors.append(_before(vectors[-1], row[0], row[1]))
        vectors.reverse()
        s = self.state
        for i, row in enumerate(self.block):
            now, after = vectors[i], vectors[i + 1]
            forced = row[1] in (BLANK, DUPLICATE)
            more = TRUNCATED if row[1] == CUT_OFF else 0
            # The letters in ASCII order: D, I, K, R.
            while True:
                kept = _NEXT.get((s, row[0]))
                if now[s] == DELETE + after[s]:
                    yield "D", None, row
                elif now[s] == INSERT + now[_WANTED[s]]:
                    s = _WANTED[s]
                    yield "I", _ROLE[s], None
                    continue
                elif not forced and kept is not None and now[s] == more + after[kept]:
                    s = kept
                    yield "K", None, row
                else:
                    s = _WANTED[s]
                    yield "R", _ROLE[s], row
                break
        if not self.left:
            while s not in _FINAL:
                s = _WANTED[s]
                yield "I", _ROLE[s], None
        self.state, self.block = s, []


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _checkpoints(kind: pa.DataType):
    """Rows (conv_id, turn, initial, fault, name, later), last to first: one row of costs for each conversation."""
    fields = [("conv_id", kind), ("n", pa.int64()), ("step", pa.int64()), ("held", pa.list_(pa.int64())), ("cost", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, wait = [], None, None
        for row in chain(_streamed(batches), [None]):
            if wait is not None:
                # A row that equals the one before it (which is read next) comes again.
                again = wait[5] or (row is not None and row[0] == wait[0] and (row[1], row[4]) == (wait[1], wait[4]))
                own.add(wait[2], wait[3] if wait[3] == BLANK or not again else DUPLICATE)
                if row is None or row[0] != wait[0]:
                    out.append((wait[0], own.n, own.step, [c for v in own.held for c in v], own.costs[START]))
                    own = None
            own, wait = own or Backward(), row
            if out and (row is None or len(out) >= 1024):
                yield _batch(out, fields)
                out = []

    return run


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


class _Report:
    """What the query returns of one conversation, gathered as its rows pass."""

    def __init__(self) -> None:
        self.counts = [0, 0, 0, 0]
        self.turns, self.least, self.most, self.turn = 0, None, None, None
        self.illegal, self.initial = 0, None
        self.audit, self.digest, self.any = [], hashlib.sha256(), False

    def row(self, turn: int | None, initial: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial

    def edit(self, letter: str, role: str, text: str) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.digest.update((("\n" if self.any else "") + role + ":" + text).encode())
            self.any = True

    def result(self, cost: int) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


_REPORT = [
    ("gaps", pa.int64()),
    ("blank", pa.int64()),
    ("duplicate", pa.int64()),
    ("truncated", pa.int64()),
    ("illegal", pa.int64()),
    ("cost", pa.int64()),
    ("audit", pa.string()),
    ("repaired_sha256", pa.string()),
]
_EDITS = [("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
# Bytes of text, about, in one batch that a task returns.
_BATCH = 8 << 20


def _walks(kind: pa.DataType, report: bool):
    """Rows (conv_id, n, step, held, cost, turn, role, text, fault, name, later): the costs of a conversation, then its rows in order."""
    fields = [("conv_id", kind), *(_REPORT if report else _EDITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, n, step, held, total, turn, role, text, fault, name, later in _streamed(batches):
            if n is not None:
                walk, said, cost, last, position = Forward(n, step, held), _Report(), total, None, 0
                continue
            if fault != BLANK and (later or (turn, name) == last):
                fault = DUPLICATE
            last = (turn, name)
            said.row(turn, role[:1], fault)
            for letter, new, row in walk.add((role[:1], fault, turn, role, text)):
                final, body = new or row[3], row[4] if row else ""
                if report:
                    said.edit(letter, final, body)
                else:
                    out.append((conv, position, letter, row[2] if row else None, final, body))
                    size += len(body) + 64
                    position += letter != "D"
            if report and not walk.left:
                out.append((conv, *said.result(cost)))
                size += len(said.audit) + 256
            if size > _BATCH:
                yield _batch(out, fields)
                out, size = [], 0
        if out:
            yield _batch(out, fields)

    return run


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, a name of role and text, and the fault so far (blank or cut off)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(F.concat(role, F.lit("\0"), text), 256)).alias("name"),
    )
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.instr(F.lit(ENDS), last) == 0, CUT_OFF).otherwise(0)
    return rows.withColumn("fault", fault)


def _passes(conversations: DataFrame, report: bool) -> DataFrame:
    rows = _rows(conversations)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # What comes in several turns of its conversation, and the first of them.
    spread = rows.where(F.col("fault") != BLANK).groupBy(F.col("conv_id").alias("of"), F.col("name").alias("again"))
    spread = spread.agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where("first < last").drop("last")
    spread = staged(spread, "dialogue-spread")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("name") == F.col("again"))
    later = F.coalesce(turn > F.col("first"), F.lit(False)).alias("later")
    marked = rows.join(spread, same, "left").select(*rows.columns, later)
    conv = conversations.schema["conv_id"].dataType
    kind = to_arrow_type(conv)
    conv = f"conv_id {conv.simpleString()}"
    order = ["turn", "role", "name"]
    backwards = marked.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "name", "later", "role")
    backwards = backwards.repartition("conv_id").sortWithinPartitions("conv_id", *(F.col(c).desc() for c in order))
    costs = backwards.drop("role").mapInArrow(
        _checkpoints(kind), f"{conv}, n bigint, step bigint, held array<bigint>, cost bigint"
    )
    costs = staged(costs, "dialogue-checkpoints")
    own = ["turn", "role", "text", "fault", "name", "later"]
    none = [F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in own]
    missing = [F.lit(None).cast(costs.schema[c].dataType).alias(c) for c in costs.columns[1:]]
    both = costs.select(*costs.columns, *none).unionByName(marked.select("conv_id", *missing, *own))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("n").isNull(), *order)
    types = {pa.int64(): "bigint", pa.string(): "string"}
    schema = ", ".join(f"{name} {types[t]}" for name, t in (_REPORT if report else _EDITS))
    return both.mapInArrow(_walks(kind, report), f"{conv}, {schema}")


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit and the hash of the repaired rows."""
    return _passes(conversations, True)


def edits(conversations: DataFrame) -> DataFrame:
    """The edits themselves: conv_id, position (of what stays, from 0), edit, turn, role, text."""
    return _passes(conversations, False)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn: dropped, emptied, without marks, repeated or made the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = F.crc32(name) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    text = F.when(code == 1, "").when(code == 2, F.translate(text, ENDS, "")).otherwise(text)
    role = F.when(code == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" ")))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")
    ).drop("_")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for each conversation there was before."""
    found = repair(damage(conversations))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(F.col(c), F.lit(nothing.get(c, 0))).alias(c) for c, _ in _REPORT),
    )
