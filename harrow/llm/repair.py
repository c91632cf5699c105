"""Conversations put in order at the least cost: bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and of an undeleted row that is cut short.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Faults of a row, in the order in which the first one counts.
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3

#: What stands before the next row: nothing, a system row, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row of each initial, and the states it may follow.
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
MAY_FOLLOW = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
#: The state behind a row that an edit gives the role which fits.
FITTING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}

FAR = 1 << 30


class Lattice:
    """Nodes are (rows passed, state); edits lead from one to another, each with its letter and cost.

    From a node no two edits have the same letter, so a node and letters tell a path.
    ``initials`` and ``faults`` have one byte for each row.
    """

    def __init__(self, initials: bytes, faults: bytes):
        self.initials, self.faults, self.n = initials, faults, len(initials)

    def onward(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, row, state) of the edits that leave a node."""
        if i < self.n:
            initial, fault = chr(self.initials[i]), self.faults[i]
            yield "D", DELETE, i + 1, state
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT_SHORT else 0
                if state in MAY_FOLLOW.get(initial, ()):
                    yield "K", more, i + 1, AFTER[initial]
                yield "R", REROLE + more, i + 1, FITTING[state]
        yield "I", INSERT, i, FITTING[state]

    def back(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, row, state) of the edits that lead to a node, with where they come from."""
        if i > 0:
            initial, fault = chr(self.initials[i - 1]), self.faults[i - 1]
            yield "D", DELETE, i - 1, state
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT_SHORT else 0
                if AFTER.get(initial) == state:
                    for before in MAY_FOLLOW[initial]:
                        yield "K", more, i - 1, before
                for before in BEFORE.get(state, ()):
                    yield "R", REROLE + more, i - 1, before
        for before in BEFORE.get(state, ()):
            yield "I", INSERT, i, before


class Side:
    """One search: least costs, and the best letter to or from each node with the node beyond it."""

    def __init__(self, nodes: int):
        self.cost = array("i", [FAR]) * nodes
        self.letter = bytearray(nodes)
        self.link = array("q", [-1]) * nodes
        self.depth = array("i", [0]) * nodes
        self.jump = array("q", [-1]) * nodes
        self.done = bytearray(nodes)
        self.heap: list[tuple[int, int, int]] = []

    def top(self) -> int:
        while self.heap and self.done[self.heap[0][2]]:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else FAR

    def put(self, node: int, cost: int, rank: int, letter: int, link: int) -> None:
        self.cost[node], self.letter[node], self.link[node] = cost, letter, link
        if link < 0:
            self.jump[node] = node
        else:
            self.depth[node] = self.depth[link] + 1
            near = self.jump[link]
            far = self.jump[near]
            # a jump is as long as the two before it together, if these are equal
            self.jump[node] = far if 2 * self.depth[near] == self.depth[link] + self.depth[far] else link
        heapq.heappush(self.heap, (cost, rank, node))

    def letters(self, node: int) -> bytearray:
        """From ``node`` along the links."""
        out = bytearray()
        while self.link[node] >= 0:
            out.append(self.letter[node])
            node = self.link[node]
        return out

    def _climb(self, node: int, depth: int) -> tuple[int, int]:
        """The node's forerunner at a lesser depth, and the letter that leads on from there."""
        while self.depth[node] > depth + 1:
            far = self.jump[node]
            node = far if self.depth[far] > depth else self.link[node]
        return self.link[node], self.letter[node]

    def is_less(self, letter: int, link: int, node: int) -> bool:
        """If the path to ``node`` over ``link`` and ``letter`` has lesser letters than its present one of the same cost.

        Both are followed back to where they part, in steps that grow with the logarithm of their length.
        """
        p, q, mine, own = link, self.link[node], letter, self.letter[node]
        if self.depth[p] > self.depth[q]:
            p, mine = self._climb(p, self.depth[q])
        elif self.depth[q] > self.depth[p]:
            q, own = self._climb(q, self.depth[p])
        while p != q:
            if self.jump[p] != self.jump[q]:
                p, q = self.jump[p], self.jump[q]
            else:
                mine, own = self.letter[p], self.letter[q]
                p, q = self.link[p], self.link[q]
        return mine < own


def cheapest_audit(initials: bytes, faults: bytes) -> tuple[int, str]:
    """(cost, audit): the cheapest edits that leave the role initials ``(s?(ua)+)?``; of equal ones the ASCII-least letters.

    A search runs from the start and one back from both possible ends; the one whose
    next node is cheaper goes on. Edits whose near end the first has settled and whose
    far end the other has are crossings. The searches go on until no path as cheap as
    the best crossing can be left, so that every cheapest path has a crossing, and the
    least of the joined letters is taken.

    Takes some hundreds of bytes for each row.
    """
    lattice = Lattice(initials, faults)
    n = lattice.n
    ahead, behind = Side(4 * n + 4), Side(4 * n + 4)
    ahead.put(START, 0, 0, 0, -1)
    for state in (START, ASSISTANT):
        behind.put(4 * n + state, 0, -n, 0, -1)
    best, crossings = FAR, []

    def cross(near: int, letter: str, cost: int, far: int) -> None:
        nonlocal best
        total = ahead.cost[near] + cost + behind.cost[far]
        if total < best:
            best = total
            crossings.clear()
        if total == best:
            crossings.append((near, letter, far))

    while (x := ahead.top()) + (y := behind.top()) <= best and min(x, y) < FAR:
        # rows rise along free edits, so of equal costs those with fewer rows passed are settled first
        side, other, edits = (ahead, behind, lattice.onward) if x <= y else (behind, ahead, lattice.back)
        cost, _, node = heapq.heappop(side.heap)
        side.done[node] = 1
        forward = side is ahead
        if forward and n == 0 and node == START:
            return 0, ""
        for letter, price, row, state in edits(node >> 2, node & 3):
            to, total, sign = 4 * row + state, cost + price, ord(letter)
            if other.done[to]:
                cross(node, letter, price, to) if forward else cross(to, letter, price, node)
            if side.done[to] or total > side.cost[to]:
                continue
            if total == side.cost[to]:
                # letters of the backward search are read from the node on, so the first one decides
                less = side.is_less(sign, node, to) if forward else side.link[to] >= 0 and sign < side.letter[to]
                if not less:
                    continue
            side.put(to, total, row if forward else -row, sign, node)
    joined = (ahead.letters(a)[::-1] + c.encode() + behind.letters(b) for a, c, b in set(crossings))
    return best, min(joined).decode()


def faults_of(text: Column, earlier: Column) -> Column:
    """The first fault of a row, 0 if it has none; ``earlier`` tells if its role and text were there before."""
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    short = ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(blank, BLANK).when(earlier, DUPLICATE).when(short, CUT_SHORT).otherwise(0)


def edited_rows(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: str | None = None
) -> DataFrame:
    """(conv, place, role, text, gaps, blank, duplicate, truncated, illegal, cost, audit): each conversation's audit, then its repaired rows.

    A row with place 0 holds the numbers and the audit, those from 1 on the repaired
    rows. All of a conversation stand together and in order in one partition.

    Rows stand by turn, nulls first, then by role and by text (its first 64 characters,
    then its hash). Each row's first fault counts: blank, a copy of an earlier row's role
    and text, or a last character (white space aside) that ends no sentence. ``gaps`` are
    turns missing between the least and the greatest; ``illegal`` counts neighbours whose
    roles' initials are not su, ua or au. ``audit`` has a letter for each edit of the
    cheapest repair: Keep, Rerole to the role that fits, Delete, Insert an empty row.

    Null roles and texts are one space. A null conversation is one like others; repeated
    rows are copies. Rows for which the boolean column ``lost`` is true only bear witness
    to their conversation: one without other rows has zeros and no audit. An empty table
    gives no rows. Other columns are not read.

    Rows are shuffled by conversation twice: without texts to find the edits, then with
    them to make these. Both read sorted rows one after another, so of a conversation
    some hundreds of bytes a row are held, never its texts.
    """
    said = rows.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)).alias("lost"),
    )
    kind = rows.schema[conversation].dataType.simpleString()
    order = [F.col("turn").asc_nulls_first(), "role", "mark", "print"]
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # texts that begin alike stand in the order of their hashes
    marked = said.select("*", F.substring("text", 1, 64).alias("mark"), F.sha2(F.col("text").cast("binary"), 256).alias("print"))
    slim = marked.select("conv", "turn", "role", "mark", "print", "lost", faults_of(F.col("text"), F.lit(False)).cast("int").alias("fault"))
    copies = Window.partitionBy("conv", "role", "print", "lost").orderBy(F.col("turn").asc_nulls_first())
    again = (F.row_number().over(copies) > 1) & (F.col("fault") != BLANK)
    slim = slim.repartition("conv").withColumn("again", again).withColumn("fault", F.when(F.col("again"), DUPLICATE).otherwise(F.col("fault")))
    slim = slim.sortWithinPartitions("conv", *order, "again").select(
        "conv", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault", "lost"
    )

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Talk | None = None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [id_kind, *[pa.int64()] * len(names), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", *names, "audit"])

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for key, at, initial, fault, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held.key != key:
                    if held is not None:
                        done.append(held.result())
                    held = _Talk(key)
                if not gone:
                    held.add(at, initial, fault)
            if len(done) > 10_000:
                yield out()
                done.clear()
        if held is not None:
            done.append(held.result())
            yield out()

    found = slim.mapInArrow(audits, f"conv {kind}, {', '.join(f'{c} long' for c in names)}, audit string")

    # the second pass: each conversation's audit, then its rows
    nothing = {"turn": F.lit(None), "role": F.lit(None), "text": F.lit(None), "mark": F.lit(None), "print": F.lit(None)}
    kept = marked.where(~F.col("lost")).select(
        "conv", F.lit(1).alias("place"), "turn", "role", "text", "mark", "print", *[F.lit(None).cast("long").alias(c) for c in names], F.lit(None).cast("string").alias("audit")
    )
    heads = found.select("conv", F.lit(0).alias("place"), *[v.cast(marked.schema[c].dataType).alias(c) for c, v in nothing.items()], *names, "audit")
    both = heads.unionByName(kept).repartition("conv").sortWithinPartitions("conv", "place", *order)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come after their audit, which passes through."""
        held: _Editor | None = None
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    done += held.rest() if held else []
                    held = _Editor(row[0], row[-1])
                    done.append(row)
                else:
                    done += held.rows_for(row[2], row[3])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), batch.schema)], batch.schema.names)
            schema = batch.schema
        if held and (done := held.rest()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema.names)

    told = f"conv {kind}, place int, role string, text string, {', '.join(f'{c} long' for c in names)}, audit string"
    return both.select("conv", "place", "role", "text", *names, "audit").mapInArrow(edit, told)


def repaired_rows(rows: DataFrame, conversation: str = "conv_id", **columns) -> DataFrame:
    """(conversation, place, role, text): the rows that the repair leaves, numbered from 1 in each conversation."""
    edited = edited_rows(rows, conversation, **columns)
    return edited.where(F.col("place") > 0).select(F.col("conv").alias(conversation), "place", "role", "text")


def repair_conversations(rows: DataFrame, conversation: str = "conv_id", **columns) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    As ``edited_rows`` gives them; ``repaired_sha256`` is the hash of the repaired rows,
    ``role:text``, joined by newlines.
    """
    edited = edited_rows(rows, conversation, **columns)
    kind = rows.schema[conversation].dataType.simpleString()
    numbers = [c for c in edited.columns if c not in ("conv", "place", "role", "text")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, id_kind = None, None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            kinds = [id_kind, *[pa.int64()] * (len(numbers) - 1), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["conv", *numbers, "repaired_sha256"])

        for batch in batches:
            done, id_kind = [], batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    done += [(*head, sha.hexdigest())] if head else []
                    head, sha = (row[0], *row[4:]), hashlib.sha256()
                else:
                    sha.update(f"{chr(10) if row[1] > 1 else ''}{row[2]}:{row[3]}".encode())
            if done:
                yield made(done)
        if head:
            yield made([(*head, sha.hexdigest())])

    told = f"conv {kind}, {', '.join(f'{c} long' for c in numbers[:-1])}, audit string, repaired_sha256 string"
    return edited.mapInArrow(digest, told).withColumnRenamed("conv", conversation)


class _Talk:
    """What the sorted rows of one conversation add up to."""

    def __init__(self, key):
        self.key, self.initials, self.faults = key, bytearray(), bytearray()
        self.least = self.greatest = self.last = None
        self.turns = self.illegal = 0
        self.before = ""

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.last  # sorted, so equal ones are neighbours
            self.least = turn if self.least is None else self.least
            self.greatest = self.last = turn
        self.illegal += bool(self.initials) and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        # anything but the three is a role that no rule knows
        self.initials.append(ord(initial) if initial in AFTER else 0)
        self.faults.append(fault)

    def result(self) -> tuple:
        cost, audit = cheapest_audit(bytes(self.initials), bytes(self.faults))
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.turns
        return (self.key, gaps, *[self.faults.count(f) for f in (BLANK, DUPLICATE, CUT_SHORT)], self.illegal, cost, audit)


class _Editor:
    """The rows of one conversation as its audit says, each (key, place, role, text) and nulls."""

    def __init__(self, key, audit: str):
        self.key, self.audit, self.at, self.state, self.place = key, audit, 0, START, 0

    def _row(self, role: str, text: str, state: int) -> tuple:
        self.state, self.place = state, self.place + 1
        return (self.key, self.place, role, text, *[None] * 7)

    def _fitting(self, text: str) -> tuple:
        state = FITTING[self.state]
        return self._row("user" if state == USER else "assistant", text, state)

    def rest(self) -> list[tuple]:
        """The rows to insert here."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            out.append(self._fitting(""))
            self.at += 1
        return out

    def rows_for(self, role: str, text: str) -> list[tuple]:
        """What the next row becomes, after what is inserted in front of it."""
        out = self.rest()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            out.append(self._row(role, text, AFTER[role[0]]))
        elif letter == "R":
            out.append(self._fitting(text))
        return out


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn, and a column ``lost`` of those dropped.

    Nulls are one space. Of 20 remainders 0 drops the row, 1 empties its text, 2 removes its
    ends of sentences, 3 repeats the row, 4 makes it the user's.
    """
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation, turn)}
    pick = F.pmod(F.crc32(F.concat(shown[conversation], F.lit(":"), shown[turn]).cast("binary")), F.lit(20))
    said, who = (F.coalesce(F.col(c), F.lit(" ")) for c in (text, role))
    changed = F.when(pick == 1, "").when(pick == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    once = rows.select(
        F.col(conversation), F.col(turn), F.when(pick == 4, "user").otherwise(who).alias(role), changed.alias(text), (pick == 0).alias("lost"),
        F.when(pick == 3, 2).otherwise(1).alias("__times"),
    )
    return once.select("*", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__time")).drop("__times", "__time")
