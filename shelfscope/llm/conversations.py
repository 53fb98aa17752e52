"""Conversation structure repair: the cheapest edits that make the roles of a conversation take turns.

The rows of all conversations are put in one order over the cluster, and that
order is cut into pieces of at most ``1 << PIECE`` rows whatever conversation
they belong to, so a conversation of any size is worked on by many tasks.  Of a
conversation's rows inside a piece a min-plus product of 4 x 4 matrices tells
the cost between any two states of the role grammar; products of the pieces it
reaches into give the cost that is still to come behind each.

With that, a piece knows the cost to go of every node (a place between rows and
a state of the grammar) and which of its arcs are optimal.  Nodes are ranked by
the audits that begin there, first of one letter, then of two, four and so on,
each ranking made from the last one at a node and at the end of its pointer;
the arc with the least letter and rank is taken, and the pointers, doubled with
the ranks, give all places of the least path at once.  Where a conversation
goes on in another piece, that is done for each state it may be entered in, and
a walk over its pieces picks the ones that fit together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfscope.llm.base import struct, written
from shelfscope.session import intermediates

PIECE = 14  # bits: rows of the common order that a task looks at together
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
LETTERS = "DIKR"  # in ASCII order: delete, insert, keep, rerole
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; the first and the last may end.
STATES, NEVER = 4, 1 << 40
NEXT = np.array([2, 2, 3, 2])  # where the role that is due leads
KEPT = {"s": [1, -1, -1, -1], "u": [2, 2, -1, 2], "a": [-1, -1, 3, -1], "": [-1] * 4}  # -1: not allowed
INITIALS = ["s", "u", "a", ""]
SOUND, DEAD, CUT = range(3)  # a row may stay; must go; costs more if it stays
END, OPEN = 12, 13  # kinds of what lies behind the last row: the conversation's end, or more of it elsewhere
KINDS = 14
LAST = np.array([0, 2 * INSERT, INSERT, 0])  # cost to go behind the last row


def arcs() -> tuple[np.ndarray, np.ndarray]:
    """By letter, kind and state: the cost of an edit and the state it leads to."""
    cost = np.full((len(LETTERS), KINDS, STATES), NEVER)
    to = np.zeros((len(LETTERS), KINDS, STATES), np.int64)
    for kind in range(KINDS):
        if kind != OPEN:
            cost[1, kind], to[1, kind] = INSERT, NEXT
        if kind < END:
            fault, initial = divmod(kind, len(INITIALS))
            cost[0, kind], to[0, kind] = DELETE, np.arange(STATES)
            if fault != DEAD:
                more = TRUNCATED if fault == CUT else 0
                kept = np.array(KEPT[INITIALS[initial]])
                cost[2, kind], to[2, kind] = np.where(kept >= 0, more, NEVER), np.maximum(kept, 0)
                cost[3, kind], to[3, kind] = REROLE + more, NEXT
    return cost, to


COST, TO = arcs()


def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of matrices."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), NEVER)


def steps() -> np.ndarray:
    """By kind: the least cost from state to state over any inserts and then the edit of the row."""
    inserts = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
    inserts[np.arange(STATES), NEXT] = INSERT
    inserts = after(inserts, inserts)
    found = np.full((END, STATES, STATES), NEVER)
    for kind in range(END):
        for letter in (0, 2, 3):
            for q in range(STATES):
                at = (kind, q, TO[letter, kind, q])
                found[at] = min(found[at], COST[letter, kind, q])
    return after(inserts[None], found)


STEPS = steps()


class Piece:
    """The rows of a piece, in order, as runs of conversations."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("pos")
        known = rows["conv"].combine_chunks()
        self.kinds = rows["kind"].to_numpy().astype(np.int64)
        n = len(self.kinds)
        if n > 1:
            a, b = known.slice(0, n - 1), known.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            change = ~same.to_numpy(zero_copy_only=False)
        else:
            change = np.zeros(0, bool)
        self.run = np.concatenate([[0], np.cumsum(change)]).astype(np.int64)
        self.begins = np.concatenate([[0], np.flatnonzero(change) + 1]).astype(np.int64)
        self.sizes = np.diff(np.append(self.begins, n))
        self.convs = known.take(pa.array(self.begins))

    def products(self) -> np.ndarray:
        """For each row the product of the steps from it to the end of its run, by doubled strides."""
        found = STEPS[self.kinds]
        stride = 1
        while stride < self.sizes.max():
            here = np.flatnonzero(self.run[stride:] == self.run[:-stride])
            found[here] = after(found[here], found[here + stride])
            stride *= 2
        return found

    def paths(self, ends: np.ndarray, going_on: np.ndarray, entered: np.ndarray) -> Iterator[tuple]:
        """(run, state, last state, audit, cost) of the least path of every run, from each state it may be entered in.

        ``ends`` has the cost to go behind each run, ``going_on`` whether it goes
        on in another piece and ``entered`` whether it began in an earlier one.
        """
        n_runs = len(self.sizes)
        layers = len(self.kinds) + n_runs  # a layer of nodes before each row and one behind each run
        of_row = np.arange(len(self.kinds)) + self.run
        behind = np.cumsum(self.sizes) + np.arange(n_runs)
        kind = np.empty(layers, np.int64)
        kind[of_row], kind[behind] = self.kinds, np.where(going_on, OPEN, END)
        to_go = np.empty((layers, STATES), np.int64)
        to_go[behind] = ends
        to_go[of_row] = (self.products() + ends[self.run][:, None, :]).min(-1)

        # Optimal arcs: those whose cost and cost to go make up that of their node.
        node = np.arange(layers * STATES).reshape(layers, STATES)
        optimal = np.zeros((len(LETTERS), layers * STATES), bool)
        target = np.empty_like(optimal, np.int64)
        for letter in range(len(LETTERS)):
            layer = np.arange(layers) + (letter != 1)
            layer = np.where(kind >= END, np.arange(layers), layer)
            goal = layer[:, None] * STATES + TO[letter, kind]
            target[letter] = goal.ravel()
            optimal[letter] = (COST[letter, kind] + to_go.ravel()[goal] == to_go).ravel()
        letters, pointers = ranked(optimal, target)

        starts = np.array([node[b + r, q] for r, b in enumerate(self.begins) for q in range(STATES if entered[r] else 1)])
        owner = np.repeat(np.arange(n_runs), np.where(entered, STATES, 1))
        # All places of the paths: what lies 2**k further, from the longest stride to the shortest.
        place, path, offset = starts, np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for k in reversed(range(len(pointers))):
            further = pointers[k][place]
            place = np.concatenate([place, further])
            path, offset = np.concatenate([path, path]), np.concatenate([offset, offset + (1 << k)])
            inside = letters[place] > 0
            place, path, offset = place[inside], path[inside], offset[inside]
        order = np.lexsort((offset, path))
        written_out = np.frombuffer(("-" + LETTERS).encode(), np.uint8)[letters[place[order]]].tobytes().decode()
        ends_at = np.cumsum(np.bincount(path, minlength=len(starts)))
        last = pointers[-1][starts] % STATES
        for i, (run, start) in enumerate(zip(owner.tolist(), starts.tolist(), strict=True)):
            begin = int(ends_at[i - 1]) if i else 0
            yield run, start % STATES, int(last[i]), written_out[begin : int(ends_at[i])], int(to_go.ravel()[start])


def ranked(optimal: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The letter of each node's arc on its least path (0: none, 1 and on by ASCII) and its pointers over 1, 2, 4 ... letters."""
    own = np.arange(optimal.shape[1])
    none = ~optimal.any(0)
    first = optimal.argmax(0)  # letters come in order, and no two arcs of a node share one
    rank = np.where(none, 0, first + 1)
    pointers = [np.where(none, own, target[first, own])]
    while (pointers[-1][pointers[-1]] != pointers[-1]).any():
        at = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[at], return_inverse=True)[1]
        pointers.append(at[at])
    # The least arc by letter and rank of what follows; pointers over one letter follow it.
    letter = np.arange(len(optimal))[:, None] + 1
    least = np.where(optimal, letter * (rank.max() + 1) + rank[target], NEVER).argmin(0)
    pointers[0] = np.where(none, own, target[least, own])
    return np.where(none, 0, least + 1), pointers


def stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = spaced(F.col(f"`{role_col}`")), spaced(F.col(f"`{text_col}`"))
    return conversations.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")
    ).withColumn("mark", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text"))))




def order() -> list[Column]:
    """The order of a conversation's rows: by turn, nulls first; rows of a turn by role and then by their digest."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mark").asc()]


def judged(rows: DataFrame) -> DataFrame:
    """``conv``, ``pos`` (a place in one order of all rows), ``turn`` and what is wrong with every row."""
    body = stripped(F.col("text"))
    fault = F.when(body == "", "blank").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "cut")
    lean = rows.select("conv", "turn", "role", "mark", fault.alias("fault"), F.monotonically_increasing_id().alias("at"))
    # The place in the input spreads equal rows of a turn over tasks.
    keys = [F.col("conv").asc_nulls_first(), *order(), F.col("at").asc()]
    placed = written(
        lean.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "mark", "fault", F.monotonically_increasing_id().alias("pos"))
    )
    firsts = placed.groupBy("conv", "mark").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    known = placed.join(firsts, "pos", "left")
    fault = (
        F.when(F.col("fault") == "blank", "blank").when(F.col("first").isNull(), "duplicate").when(F.col("fault") == "cut", "truncated")
    )
    code = F.when(fault.isin("blank", "duplicate"), DEAD).when(fault == "truncated", CUT).otherwise(SOUND)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return known.select(
        "conv", "turn", "pos", fault.alias("fault"), (code * len(INITIALS) + initial).alias("kind"), F.shiftright("pos", PIECE).alias("piece")
    )


def in_order(of: Callable[[pa.Table], Iterator[dict]], schema: T.StructType) -> Callable[[pa.Table], pa.Table]:
    arrow = to_arrow_schema(schema)
    return lambda table: pa.Table.from_pylist(list(of(table)), schema=arrow)


def edges(rows: DataFrame) -> DataFrame:
    """The products of the first and the last run of every piece: what may reach into another."""
    schema = T.StructType([rows.schema["conv"], *struct(piece=T.LongType(), costs=T.ArrayType(T.LongType())).fields])

    def of(table: pa.Table):
        piece = Piece(table)
        products = piece.products()
        for run in sorted({0, len(piece.sizes) - 1}):
            yield {"conv": piece.convs[run].as_py(), "piece": table["piece"][0].as_py(), "costs": products[piece.begins[run]].ravel().tolist()}

    return rows.select("conv", "pos", "kind", "piece").groupBy("piece").applyInArrow(in_order(of, schema), schema)


def borders(found: DataFrame) -> DataFrame:
    """For every run at the edge of a piece the cost to go behind it and on which sides it has more of its conversation.

    A group is a row for each piece of one conversation.
    """
    kind = struct(piece=T.LongType(), ends=T.ArrayType(T.LongType()), entered=T.BooleanType(), going_on=T.BooleanType())
    schema = T.StructType([found.schema["conv"], *kind.fields])

    def of(table: pa.Table):
        rows = table.sort_by("piece").to_pylist()
        ends = LAST
        for i in reversed(range(len(rows))):
            costs = np.array(rows[i].pop("costs")).reshape(STATES, STATES)
            yield rows[i] | {"ends": ends.tolist(), "entered": i > 0, "going_on": i < len(rows) - 1}
            ends = (costs + ends).min(1)

    return found.groupBy("conv").applyInArrow(in_order(of, schema), schema)


def runs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The least paths of all runs of conversations in pieces."""
    kind = struct(
        piece=T.LongType(), state=T.IntegerType(), last=T.IntegerType(), audit=T.StringType(), cost=T.LongType(), whole=T.BooleanType()
    )
    schema = T.StructType([rows.schema["conv"], *kind.fields])
    arrow = to_arrow_schema(schema)

    def of(table: pa.Table, sides: pa.Table) -> pa.Table:
        piece = Piece(table)
        n = len(piece.sizes)
        ends, entered, going_on = np.tile(LAST, (n, 1)), np.zeros(n, bool), np.zeros(n, bool)
        about = {row["conv"]: row for row in sides.to_pylist()}
        for run in {0, n - 1}:
            row = about[piece.convs[run].as_py()]
            ends[run], entered[run], going_on[run] = row["ends"], row["entered"], row["going_on"]
        run, state, last, audit, cost = zip(*piece.paths(ends, going_on, entered), strict=True)
        number = pa.array(np.full(len(run), table["piece"][0].as_py()))
        whole = pa.array(~(entered | going_on)[list(run)])
        columns = [piece.convs.take(pa.array(run)), number, pa.array(state), pa.array(last), pa.array(audit), pa.array(cost), whole]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return (
        rows.select("conv", "pos", "kind", "piece").groupBy("piece").cogroup(known.groupBy("piece")).applyInArrow(of, schema)
    )


def audits(rows: DataFrame) -> DataFrame:
    """``conv``, ``audit`` and ``cost`` of every conversation in judged rows."""
    found = written(runs(rows, written(borders(edges(rows)))))
    schema = T.StructType([rows.schema["conv"], *struct(audit=T.StringType(), cost=T.LongType()).fields])

    def walk(table: pa.Table):
        by_piece: dict = {}
        for row in table.sort_by("piece").to_pylist():
            by_piece.setdefault(row["piece"], {})[row["state"]] = row
        state, parts, cost = 0, [], None
        for choices in by_piece.values():
            row = choices[state]
            state, cost = row["last"], row["cost"] if cost is None else cost
            parts.append(row["audit"])
        yield {"conv": row["conv"], "audit": "".join(parts), "cost": cost}

    several = found.filter("not whole").groupBy("conv").applyInArrow(in_order(walk, schema), schema)
    return found.filter("whole").select("conv", "audit", "cost").union(several)


def faults(rows: DataFrame) -> DataFrame:
    """Counts of faults and the gaps between turns of every conversation; a turn is folded first, so none is a hot group."""
    names = ["blank", "duplicate", "truncated"]
    turns = rows.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == name).alias(name) for name in names])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(name).alias(name) for name in names])


HEAD = ["gaps", "blank", "duplicate", "truncated", "cost", "audit"]


def with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of every conversation in order behind one row with what is known about it.

    Hashing and writing out a conversation is one pass from its first row to its
    last, so its rows go through one task, a batch at a time: their number does
    not matter for memory.  The sort spills.
    """
    both = heads.withColumn("head", F.lit(True)).unionByName(rows.withColumn("head", F.lit(False)), allowMissingColumns=True)
    names = ["conv", "head", *HEAD, "role", "text"]
    return (
        both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.desc("head"), *order()).select(*names)
    )


class Edited:
    """Replays an audit over the rows of its conversation as they come: edits are (letter, role, text)."""

    def __init__(self, head: dict):
        self.head, self.audit = head, head["audit"]
        self.at = self.state = self.lines = self.illegal = 0
        self.before: str | None = None
        self.hash = hashlib.sha256()

    def due(self, letter: str, text: str) -> tuple[str, str, str]:
        """The role that is due, put in."""
        role = "assistant" if self.state == 2 else "user"
        self.at += 1
        self.state = int(NEXT[self.state])
        return letter, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self.due("I", "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        yield from self.inserted()
        letter = self.audit[self.at]
        if letter == "R":
            yield self.due(letter, text)
            return
        self.at += 1
        if letter == "K":
            self.state = KEPT[initial][self.state]
            yield letter, role, text

    def closed(self) -> Iterator[tuple[Edited, tuple[str, str, str] | None]]:
        for edit in self.inserted():
            yield self, edit
        yield self, None


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Edited, tuple[str, str, str] | None]]:
    """Every edit that leaves a row, and None behind the last of a conversation."""
    now = None
    for batch in batches:
        is_head = batch.column("head")
        heads = iter(batch.select(["conv", *HEAD]).filter(is_head).to_pylist())
        for head, role, text in zip(is_head.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not head:
                for edit in now.row(role, text):
                    yield now, edit
                continue
            if now:
                yield from now.closed()
            now = Edited(next(heads))
    if now:
        yield from now.closed()


def batched(found: Iterator[dict], schema: pa.Schema, most: int = 4096, most_characters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(rows) >= most or size >= most_characters:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def reported(ordered: DataFrame) -> DataFrame:
    """What is known about every conversation, its ``illegal`` neighbours and the hash of its repaired form."""
    more = struct(illegal=T.LongType(), repaired_sha256=T.StringType())
    schema = T.StructType([*(ordered.schema[c] for c in ["conv", *HEAD]), *more.fields])
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for now, edit in replayed(batches):
            if edit:
                now.hash.update(f"{chr(10) * (now.lines > 0)}{edit[1]}:{edit[2]}".encode())
                now.lines += 1
            else:
                yield now.head | {"illegal": now.illegal, "repaired_sha256": now.hash.hexdigest()}

    return ordered.mapInArrow(lambda batches: batched(rows(batches), arrow), schema)


def rewritten(ordered: DataFrame) -> DataFrame:
    """The repaired rows themselves."""
    kind = struct(place=T.LongType(), edit=T.StringType(), role=T.StringType(), text=T.StringType())
    schema = T.StructType([ordered.schema["conv"], *kind.fields])
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for now, edit in replayed(batches):
            if edit:
                yield {"conv": now.head["conv"], "place": now.lines, "edit": edit[0], "role": edit[1], "text": edit[2]}
                now.lines += 1

    return ordered.mapInArrow(lambda batches: batched(rows(batches), arrow), schema)


def prepared(conversations: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = rows_of(conversations, *names)
    with intermediates(conversations.sparkSession):
        known = written(judged(rows))
        heads = written(
            faults(known).alias("f").join(audits(known).alias("a"), F.expr("f.conv <=> a.conv")).select("f.*", "audit", "cost"), outlives=True
        )
    return rows, heads


def repair_report(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A row for every conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows are taken by turn, nulls first, and rows of one turn by role and then
    by the MD5 of role and text (rows that are equal in all of that are alike
    anyway).  A null role or text is one blank.  Rows whose conversation is null
    make one conversation.  Repeated rows are duplicates.  Of other columns
    nothing is read, so their names do not matter.  An empty table gives none.
    """
    rows, heads = prepared(conversations, [conv_col, turn_col, role_col, text_col])
    return reported(with_heads(rows, heads)).withColumnRenamed("conv", conv_col)


def repaired(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The rows of all repaired conversations: the conversation, ``place`` from 0, ``edit`` (K, R or I), ``role`` and ``text``."""
    rows, heads = prepared(conversations, [conv_col, turn_col, role_col, text_col])
    return rewritten(with_heads(rows, heads)).withColumnRenamed("conv", conv_col)


def damaged(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows dropped, emptied, cut of their marks, repeated or given to the user, by a checksum of conversation and turn."""
    chance = F.crc32(F.concat(spaced(F.col(conv_col)), F.lit(":"), spaced(F.col(turn_col)))) % 20
    role, text = spaced(F.col(role_col)), spaced(F.col(text_col))
    text = F.when(chance == 1, "").when(chance == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(chance == 4, "user").otherwise(role)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(chance == 3, 2).otherwise(1)))
    return (
        conversations.filter(chance != 0)
        .select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), copies.alias("_copy"))
        .drop("_copy")
    )
