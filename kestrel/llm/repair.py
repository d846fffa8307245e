"""Conversation structure repair by a generalised LR parser with weighted edits.

A conversation is a sequence of roles that should follow a grammar (by default ``(s?(ua)+)?`` over
the roles' initials). Its rows are shifted onto a graph-structured stack: each row may be kept,
given another role or deleted, and rows may be inserted anywhere; after a shift, finished
productions are reduced through the links below the top. Stacks with equal tops are merged by the
minimum of (cost, audit), the audit being the initials of the edits so far; no two ways of equal
cost have audits of which one begins the other, so what comes later cannot turn the choice.

Rows are sorted into ranges of (conversation, turn, role, digest of the text), so a long
conversation is spread over tasks. A conversation inside one range is repaired there. Otherwise
each of its segments (at most ``SEGMENT`` rows) is parsed from every top that the stack can have,
the costs and audits of its segments are folded in order, and each segment is then rewritten on
its own; per conversation only audits meet, and the rows only in the digest of the query, as a
stream.

Defined cases: a null role or text is one blank; an empty role is a blank, too; rows of one turn
come in the order of role and md5 of the text; null conversation ids are one conversation;
repeated rows are duplicates; a conversation of which no rows are left has zero counts, an
empty audit and nothing repaired; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.staging import drop_staged, stage, text_batches

#: Productions of the role grammar over role initials; C is the goal, L a list of exchanges.
GRAMMAR = (("C", ""), ("C", "L"), ("L", "ua"), ("L", "sua"), ("L", "Lua"))
ROLES = {"u": "user", "a": "assistant"}  # what may be inserted or given
COSTS = {"R": 2, "D": 3, "I": 2}
SEGMENT, SEGMENT_BYTES = 4096, 4 << 20
SPACE = " \t\n\v\f\r"


class RoleParser:
    """LR(0) tables of a grammar whose stacks are told apart by their tops."""

    def __init__(self, grammar=GRAMMAR, goal: str = "C"):
        self.grammar = grammar
        self.terminals = {s for _, body in grammar for s in body} - {head for head, _ in grammar}
        start = self._closed({(k, 0) for k, (head, _) in enumerate(grammar) if head == goal})
        states, self.goto = [start], {}
        for n, items in enumerate(states):  # grows while it is read
            for symbol in sorted({grammar[k][1][at] for k, at in items if at < len(grammar[k][1])}):
                after = self._closed({(k, at + 1) for k, at in items if grammar[k][1][at: at + 1] == symbol})
                if after not in states:
                    states.append(after)
                self.goto[n, symbol] = states.index(after)
        done = [[k for k, at in items if at == len(grammar[k][1])] for items in states]
        self.accepts = {n for n, found in enumerate(done) if any(grammar[k][0] == goal for k in found)}
        self.reduces = {n: k for n, found in enumerate(done) for k in found if grammar[k][0] != goal}
        self.stacks = {0: (0,)}  # the stack below every top
        queue = [(0,)]
        for stack in queue:
            for symbol in sorted(s for n, s in self.goto if n == stack[-1] and s in self.terminals):
                after = self._moved(stack, symbol)
                if self.stacks.setdefault(after[-1], after) != after:
                    raise ValueError("the grammar has two stacks with one top")
                if after not in queue:
                    queue.append(after)

    def _closed(self, items: set) -> frozenset:
        while True:
            wanted = {self.grammar[k][1][at] for k, at in items if at < len(self.grammar[k][1])}
            more = items | {(k, 0) for k, (head, _) in enumerate(self.grammar) if head in wanted}
            if more == items:
                return frozenset(items)
            items = more

    def _moved(self, stack: tuple, symbol: str) -> tuple:
        stack += (self.goto[stack[-1], symbol],)
        while (rule := self.reduces.get(stack[-1])) is not None:
            head, body = self.grammar[rule]
            stack = stack[: len(stack) - len(body)]
            stack += (self.goto[stack[-1], head],)
        return stack

    def shifted(self, node: "Node", symbol: str, cost: int, audit: str) -> "Node | None":
        """The node after shifting a role and reducing, with the way's cost and audit."""
        state = self.goto.get((node.state, symbol)) if symbol in self.terminals else None
        if state is None:
            return None
        below = node
        while (rule := self.reduces.get(state)) is not None:
            head, body = self.grammar[rule]
            for _ in body[1:]:  # the first symbol popped was never pushed
                below = below.below
            state = self.goto[below.state, head]
        return Node(state, below, cost, audit)

    def entry(self, top: int) -> "Node":
        node = None
        for state in self.stacks[top]:
            node = Node(state, node, 0, "")
        return node


class Node:
    """A stack top with the node below it and the cheapest way that led here."""

    __slots__ = ("state", "below", "cost", "audit")

    def __init__(self, state: int, below: "Node | None", cost: int, audit: str):
        self.state, self.below, self.cost, self.audit = state, below, cost, audit


def _merged(tops: dict[int, Node], node: Node | None) -> bool:
    if node is None:
        return False
    held = tops.get(node.state)
    if held is not None and (held.cost, held.audit) <= (node.cost, node.audit):
        return False
    tops[node.state] = node
    return True


def with_inserts(parser: RoleParser, tops: dict[int, Node]) -> dict[int, Node]:
    tops = dict(tops)
    queue = list(tops.values())
    for node in queue:
        if tops.get(node.state) is node:
            for role in ROLES:
                new = parser.shifted(node, role, node.cost + COSTS["I"], node.audit + "I")
                if _merged(tops, new):
                    queue.append(new)
    return tops


def after_row(parser: RoleParser, tops: dict[int, Node], initial: str, fault: str) -> dict[int, Node]:
    """Tops after a row with this role initial and first fault (b, d, t or nothing)."""
    out: dict[int, Node] = {}
    extra = 1 if fault == "t" else 0
    for node in with_inserts(parser, tops).values():
        _merged(out, Node(node.state, node.below, node.cost + COSTS["D"], node.audit + "D"))
        if fault in ("b", "d"):
            continue
        _merged(out, parser.shifted(node, initial, node.cost + extra, node.audit + "K"))
        for role in ROLES:
            _merged(out, parser.shifted(node, role, node.cost + extra + COSTS["R"], node.audit + "R"))
    return out


def best_end(parser: RoleParser, tops: dict[int, Node]) -> Node:
    return min((n for n in with_inserts(parser, tops).values() if n.state in parser.accepts), key=lambda n: (n.cost, n.audit))


def rewritten(parser: RoleParser, entry: int, audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of ``audit``, for rows met with the stack of ``entry``."""
    stack, row = parser.stacks[entry], 0
    out_roles, out_texts = [], []
    for edit in audit:
        role, text = None, ""
        if edit != "I":
            role, text = roles[row], texts[row]
            row += 1
        if edit == "D":
            continue
        if edit != "K":
            role = next(ROLES[r] for r in ROLES if (stack[-1], r) in parser.goto)
        stack = parser._moved(stack, role[:1])
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def fault_of(text: str, duplicate: bool) -> str:
    shown = text.rstrip(SPACE)
    return "b" if not shown else "d" if duplicate else "t" if shown[-1] not in ".!?" else ""


COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Segment:
    """Consecutive rows of one conversation: their counts, and the parse from each entry top."""

    def __init__(self, parser: RoleParser, entries: list[int]):
        self.parser = parser
        self.tops = {e: {e: parser.entry(e)} for e in entries}
        self.counts = dict.fromkeys(COUNTS, 0)
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.turns, self.low, self.high, self.bytes = 0, None, None, 0

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        fault = fault_of(text, duplicate)
        if fault:
            self.counts[{"b": "blank", "d": "duplicate", "t": "truncated"}[fault]] += 1
        if self.roles:
            self.counts["illegal"] += illegal(self.roles[-1], role)
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.tops = {e: after_row(self.parser, tops, role[:1], fault) for e, tops in self.tops.items()}
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT or self.bytes >= SEGMENT_BYTES

    def record(self) -> dict:
        return {**self.counts, "turns": self.turns, "low": self.low, "high": self.high, "first": self.roles[0], "last": self.roles[-1]}


def illegal(before: str, after: str) -> int:
    return before[:1] + after[:1] not in ("su", "ua", "au")


def gaps(record: dict) -> int:
    return 0 if record["low"] is None else record["high"] - record["low"] + 1 - record["turns"]


MOVES = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
RECORD = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _walk(kind: str):
    """Segments of sorted rows (conversation, turn, role, digest, kind, text); whole conversations are repaired."""
    schema = _arrow(f"conv_id {kind}, part int, number int, whole boolean, {RECORD}, gaps long, cost long, audit string, moves {MOVES}, "
                    "roles array<string>, texts array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, part = RoleParser(), TaskContext.get().partitionId()
        every = sorted(parser.stacks)
        out: list[dict] = []
        size = 0
        held: Segment | None = None
        conv, number, begun, cut = None, 0, False, True  # the first conversation of a range may go on from the one before
        marked = last = None

        def close(ended: bool) -> None:
            nonlocal number, size
            size += held.bytes + 100
            row = {"conv_id": conv, "part": part, "number": number, "whole": ended and not cut, **held.record()}
            number += 1
            if row["whole"]:
                best = best_end(parser, held.tops[0])
                roles, texts = rewritten(parser, 0, best.audit, held.roles, held.texts)
                row |= {"gaps": gaps(row), "cost": best.cost, "audit": best.audit, "roles": roles, "texts": texts}
            else:
                row |= {"moves": [{"entry": e, "exit": n.state, "cost": n.cost, "audit": n.audit} for e, tops in held.tops.items()
                                  for n in tops.values()], "roles": held.roles, "texts": held.texts}
            out.append(row)

        for batch in batches:
            for c, turn, role, digest, kind_, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if begun and c != conv:
                    if held is not None:
                        close(ended=True)
                    held, cut, last, marked = None, False, None, None
                conv, begun = c, True
                if kind_ == 0:  # this (turn, role, digest) has come before in an earlier turn
                    marked = (turn, role, digest)
                    continue
                if held is not None and held.full():
                    close(ended=False)
                    held, cut = None, True
                if held is None:
                    held = Segment(parser, every if cut else [0])
                key = (turn, role, digest)
                held.add(turn, role, text, key == marked or key == last)
                last = key
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                    size = 0
        if held is not None:
            close(ended=False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _fold(kind: str):
    """Segments of sorted conversations (without rows): (part, number, entry, edits) of each, and the conversation's result."""
    schema = _arrow(f"conv_id {kind}, part int, number int, entry int, edits string, {FOUND}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = RoleParser()
        total: dict | None = None
        tops: dict[int, tuple[int, str, tuple | None]] = {}  # cost, audit behind the common beginning, way: (way before, segment, entry, edits)

        def close() -> Iterator[pa.RecordBatch]:
            best = None
            for top, (cost, audit, way) in tops.items():
                node = parser.entry(top)
                for end in with_inserts(parser, {top: node}).values():
                    if end.state in parser.accepts and (best is None or (cost + end.cost, audit + end.audit) < best[:2]):
                        best = (cost + end.cost, audit + end.audit, way, end.audit)
            cost, _, way, tail = best
            steps = []
            while way is not None:
                way, (part, number), entry, edits = way
                steps.append({"part": part, "number": number, "entry": entry, "edits": edits})
            steps[0]["edits"] += tail
            steps.reverse()
            audit = "".join(s["edits"] for s in steps)
            first = {"conv_id": total["conv_id"], "gaps": gaps(total), "cost": cost, "audit": audit, **{c: total[c] for c in COUNTS}}
            for lo in range(0, len(steps), 500):
                yield pa.RecordBatch.from_pylist([s | (first if lo + k == 0 else {}) for k, s in enumerate(steps[lo: lo + 500])], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if total is not None and row["conv_id"] != total["conv_id"]:
                    yield from close()
                    total = None
                if total is None:
                    total = {c: 0 for c in COUNTS} | {"conv_id": row["conv_id"], "turns": 0, "low": None, "high": None, "last": None}
                    tops = {0: (0, "", None)}
                if total["last"] is not None:
                    total["illegal"] += illegal(total["last"], row["first"])
                for c in COUNTS:
                    total[c] += row[c]
                if row["low"] is not None:
                    total["turns"] += row["turns"] - (row["low"] == total["high"])
                    total["low"] = row["low"] if total["low"] is None else total["low"]
                    total["high"] = row["high"]
                total["last"] = row["last"]
                new: dict[int, tuple] = {}
                for move in row["moves"]:
                    at = tops.get(move["entry"])
                    if at is None:
                        continue
                    cost, audit = at[0] + move["cost"], at[1] + move["audit"]
                    if move["exit"] not in new or (cost, audit) < new[move["exit"]][:2]:
                        new[move["exit"]] = (cost, audit, (at[2], (row["part"], row["number"]), move["entry"], move["audit"]))
                same = len(commonprefix([a for _, a, _ in new.values()]))
                tops = {s: (c, a[same:], w) for s, (c, a, w) in new.items()}
        if total is not None:
            yield from close()

    return run


def _rewrite(kind: str):
    schema = _arrow(f"conv_id {kind}, part int, number int, roles array<string>, texts array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = RoleParser()
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["roles"], r["texts"] = rewritten(parser, r.pop("entry"), r.pop("edits"), r["roles"], r["texts"])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _stream_digest(kind: str):
    """sha256 of the repaired rows of each conversation, segment after segment."""
    schema = _arrow(f"conv_id {kind}, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun, any_row = None, None, False, False
        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema)
                    conv, state, begun, any_row = row["conv_id"], hashlib.sha256(), True, False
                for role, text in zip(row["roles"], row["texts"]):
                    state.update((("\n" if any_row else "") + f"{role}:{text}").encode())
                    any_row = True
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema)

    return run


def _plain(column: str) -> Column:
    return F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) == "", F.lit(" ")).otherwise(F.col(column).cast("string"))


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """Cheapest repair of every conversation that has rows.

    Returns two tables: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row per
    conversation; and (conv_id, part, number, roles, texts, whole), its repaired rows in order
    of (part, number), in lists of bounded length (all in one list where ``whole``).
    """
    source = text_batches(rows).select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), _plain(role).alias("role"),
                                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text")) \
        .withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    kind = source.schema["conv_id"].dataType.simpleString()
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # the first turn of a text met twice or more; marks say which other turns have it
    group = ["conv_id", "role", "digest"]
    first = source.groupBy(*group).agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1") \
        .select(*[F.col(c).alias(f"_{c}") for c in group], "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    met = source.select(*group, "turn").withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")) \
        & (F.col("salt") == F.col("_salt"))
    marks = met.join(first, same).filter("struct(turn) > first").select("conv_id", "turn", "role", "digest").distinct()

    both = source.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text") \
        .unionByName(marks.select("*", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text")))
    order = ["conv_id", "turn", "role", "digest"]
    walked = both.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "kind").mapInArrow(
        _walk(kind), f"conv_id {kind}, part int, number int, whole boolean, {RECORD}, gaps long, cost long, audit string, moves {MOVES}, "
                     "roles array<string>, texts array<string>")
    walked = stage(walked, "segments")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    open_ = walked.filter("NOT whole")
    light = open_.drop("roles", "texts", "whole", "gaps", "cost", "audit")
    folded = stage(light.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "part", "number")
                   .mapInArrow(_fold(kind), f"conv_id {kind}, part int, number int, entry int, edits string, {FOUND}"), "edits")
    found = walked.filter("whole").select(*names).unionByName(folded.filter("audit IS NOT NULL").select(*names))
    rewritten_ = open_.select("conv_id", "part", "number", "roles", "texts").join(folded.select("part", "number", "entry", "edits"), ["part", "number"]) \
        .select("conv_id", "part", "number", "roles", "texts", "entry", "edits") \
        .mapInArrow(_rewrite(kind), f"conv_id {kind}, part int, number int, roles array<string>, texts array<string>")
    lists = ["conv_id", "part", "number", "roles", "texts"]
    repaired = walked.filter("whole").select(*lists, "whole").unionByName(rewritten_.withColumn("whole", F.lit(False)))
    return found, repaired


def repair_digest(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The result row of every conversation of ``conversations``, repaired from ``rows``."""
    found, repaired = repair_conversations(rows)
    kind = found.schema["conv_id"].dataType.simpleString()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.transform(F.arrays_zip("roles", "texts"), lambda z: F.concat(z["roles"], F.lit(":"), z["texts"]))
    near = repaired.filter("whole").select("conv_id", F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("repaired_sha256"))
    far = repaired.filter("NOT whole").drop("whole").repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "part", "number") \
        .mapInArrow(_stream_digest(kind), f"conv_id {kind}, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    done = found.withColumnRenamed("conv_id", "c1")
    out = every.join(done, F.col("id").eqNullSafe(F.col("c1")), "left") \
        .join(near.unionByName(far).withColumnRenamed("conv_id", "c2"), F.col("id").eqNullSafe(F.col("c2")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(``conv_id:turn``) % 20 deals to every row.

    0 drops it, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's; a
    null is one blank, in the key, too.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), h.alias("h")).filter("h <> 0")
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       copies.alias("copy")).drop("copy")
