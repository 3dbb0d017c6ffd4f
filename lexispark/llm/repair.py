"""Conversation structure repair: generalised LR parsing over the role grammar, with weighted edits.

1. Spark finds the faults: row-local ones by expressions, repeats by an
   aggregate that knows the first row of each (conversation, role, text).
2. A generalised LR parser, its tables built from ``GRAMMAR``, reads a
   conversation's roles. Instead of failing it branches: each row may be kept,
   reroled or deleted, and rows may be inserted before it. The branches are
   kept as a graph-structured stack: nodes (state, node below) are made once
   and shared, and branches that end in one stack are merged by the least
   (cost, audit). A branch that costs over ``SLACK`` more than another cannot
   win any more (see there) and ends.
3. What a step does depends on the stacks and their relative costs only, of
   which there are few; steps are remembered, and a conversation keeps one
   reference for each of its rows.
4. The repaired rows are streamed in order through a running digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (s?(ua)+)?, written so that all that begins with or without s shares its later stacks.
GRAMMAR = (("C", ()), ("C", ("H", "P")), ("H", ()), ("H", ("s",)), ("P", ("P", "T")), ("P", ("T",)), ("T", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The most that one branch can gain on another: the other can delete the s that the first keeps, insert one row to be in
#: step and two that close a pair.
SLACK = DELETE + 3 * INSERT
#: Fault codes: each row's first fault.
NONE, BLANK, DUPLICATE, CUT = "n", "b", "d", "t"
_WHITE = r"\x20\x09-\x0D"


# ---- the parser

class Tables:
    """SLR(1) tables of a grammar whose start symbol is its first rule's."""

    def __init__(self, grammar: tuple[tuple[str, tuple[str, ...]], ...]):
        self.rules = (("", (grammar[0][0],)), *grammar)
        heads = {h for h, _ in grammar}
        first: dict[str, set[str]] = {h: set() for h in heads}
        follow: dict[str, set[str]] = {h: set() for h in heads}
        follow[grammar[0][0]].add("$")
        empty: set[str] = set()
        size = -1
        while size != (size := sum(map(len, (*first.values(), *follow.values(), empty)))):
            for head, body in grammar:
                if all(x in empty for x in body):
                    empty.add(head)
                for i, x in enumerate(body):
                    if all(y in empty for y in body[:i]):
                        first[head] |= first.get(x, {x})
                    if x in heads:
                        rest = body[i + 1:]
                        for j, y in enumerate(rest):
                            follow[x] |= first.get(y, {y})
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[head]
        self.states = [self._closed(frozenset({(0, 0)}), heads)]
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], int] = {}
        for n, state in enumerate(self.states):  # grows while it is read
            for x in sorted({self.rules[r][1][at] for r, at in state if at < len(self.rules[r][1])}):
                moved = frozenset((r, at + 1) for r, at in state if at < len(self.rules[r][1]) and self.rules[r][1][at] == x)
                there = self._closed(moved, heads)
                if there not in self.states:
                    self.states.append(there)
                self.goto[n, x] = self.states.index(there)
            done = [r for r, at in state if at == len(self.rules[r][1])]
            for r in done:
                for x in follow[self.rules[r][0]] if r else {"$"}:
                    if self.reduce.setdefault((n, x), r) != r or r and (n, x) in self.goto:
                        raise ValueError(f"the grammar is not SLR(1): state {n}, {x}")
        # states that hold one finished rule and nothing else reduce whatever comes
        self.eager = {n: next(iter(s))[0] for n, s in enumerate(self.states)
                      if len(s) == 1 and (i := next(iter(s)))[0] and i[1] == len(self.rules[i[0]][1])}

    def _closed(self, items: frozenset, heads: set[str]) -> frozenset:
        out = set(items)
        while more := {(k, 0) for r, at in out for k, (h, _) in enumerate(self.rules)
                       if at < len(self.rules[r][1]) and self.rules[r][1][at] in heads and h == self.rules[r][1][at]} - out:
            out |= more
        return frozenset(out)


class Stack:
    """The nodes of the graph-structured stack: (state, node below), each made once."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.index = {(0, -1): 0}

    def push(self, node: int, symbol: str) -> int | None:
        state = self.tables.goto.get((self.nodes[node][0], symbol))
        if state is None:
            return None
        key = (state, node)
        if key not in self.index:
            self.index[key] = len(self.nodes)
            self.nodes.append(key)
        return self.index[key]

    def _reduced(self, node: int, rule: int) -> int:
        head, body = self.tables.rules[rule]
        for _ in body:
            node = self.nodes[node][1]
        return self.push(node, head)

    def shift(self, node: int, token: str) -> int | None:
        """The stack after ``token``, null if it does not fit; reductions are done as soon as they are certain."""
        while (rule := self.tables.reduce.get((self.nodes[node][0], token))) is not None:
            node = self._reduced(node, rule)
        node = self.push(node, token)
        while node is not None and (rule := self.tables.eager.get(self.nodes[node][0])) is not None:
            node = self._reduced(node, rule)
        return node

    def accepts(self, node: int) -> bool:
        while (rule := self.tables.reduce.get((self.nodes[node][0], "$"))):
            node = self._reduced(node, rule)
        return rule == 0


_STACK = Stack(Tables(GRAMMAR))
#: Branches: (node, cost above the cheapest, rank of the audit) of each, in node order.
Branches = tuple[tuple[int, int, int], ...]


def _inserted(branches: Branches) -> Iterator[tuple[int, int, int, int, str]]:
    """(node, cost, branch, rank, audit) of each branch, after any rows inserted that lead to a stack not yet met."""
    for at, (node, cost, rank) in enumerate(branches):
        met, audit = {node}, ""
        yield node, cost, at, rank, audit
        queue = [(node, cost, audit)]
        while queue:
            node, cost, audit = queue.pop(0)
            for token in ROLES:
                there = _STACK.shift(node, token)
                if there is not None and there not in met:
                    met.add(there)
                    queue.append((there, cost + INSERT, audit + "I"))
                    yield there, cost + INSERT, at, rank, audit + "I"


@lru_cache(maxsize=1 << 16)
def _step(branches: Branches, token: str, fault: str) -> tuple[Branches, int, tuple[tuple[int, int, str], ...]]:
    """One row: the branches after it, by how much the cheapest cost rose, and (node, branch it came from, audit added) of each."""
    found: dict[int, tuple[int, int, str, int]] = {}

    def offer(node: int | None, cost: int, rank: int, audit: str, at: int) -> None:
        if node is not None and (node not in found or (cost, rank, audit) < found[node][:3]):
            found[node] = (cost, rank, audit, at)

    for node, cost, at, rank, audit in _inserted(branches):
        offer(node, cost + DELETE, rank, audit + "D", at)
        if fault not in (BLANK, DUPLICATE):
            left = cost + (TRUNCATED if fault == CUT else 0)
            offer(_STACK.shift(node, token), left + KEEP, rank, audit + "K", at)
            for role in ROLES:
                offer(_STACK.shift(node, role), left + REROLE, rank, audit + "R", at)
    least = min(c for c, *_ in found.values())
    alive = {n: v for n, v in found.items() if v[0] - least <= SLACK}
    order = {x: i for i, x in enumerate(sorted({(rank, audit) for _, rank, audit, _ in alive.values()}))}
    nodes = sorted(alive)
    return (tuple((n, alive[n][0] - least, order[alive[n][1:3]]) for n in nodes), least,
            tuple((n, alive[n][3], alive[n][2]) for n in nodes))


class Repair:
    """The cheapest repair of one conversation, fed row by row."""

    def __init__(self):
        self.branches: Branches = ((0, 0, 0),)
        self.cost = 0
        self.trail: list[tuple] = []  # shared tuples of remembered steps

    def feed(self, initial: str, fault: str = NONE) -> None:
        self.branches, more, how = _step(self.branches, initial if initial in ("s", "u", "a") else "?", fault)
        self.cost += more
        self.trail.append(how)

    def finish(self) -> tuple[int, str]:
        """(cost, audit)"""
        cost, _, tail, at = min((cost, rank, audit, at) for node, cost, at, rank, audit in _inserted(self.branches)
                                if _STACK.accepts(node))
        parts = [tail]
        for how in reversed(self.trail):
            _, at, audit = how[at]
            parts.append(audit)
        return self.cost + cost, "".join(reversed(parts))


class Mended:
    """The rows that an audit makes of a conversation's rows, fed one by one; the roles of new ones follow from the grammar."""

    def __init__(self, audit: str = ""):
        self.audit, self.at, self.made, self.expected = audit, 0, 0, "u"

    def _turned(self) -> str:
        role = ROLES[self.expected]
        self.expected = "a" if self.expected == "u" else "u"
        return role

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at, self.made = self.at + 1, self.made + 1
            yield self._turned(), ""

    def feed(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            head = edit == "K" and role[:1] == "s" and not self.made
            turned = None if head else self._turned()
            self.made += 1
            yield turned if edit == "R" else role, text

    def finish(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


# ---- tables

def faults(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (conv_id, role, text, uid, digest and ``order``) with ``fault``, each row's first: blank, duplicate, truncated, none.

    A duplicate repeats the role and text of an earlier row of its
    conversation. The first row of each is a least struct, combined before the
    shuffle, so a row that a conversation repeats without end is no hot group;
    only groups of several rows are joined back.
    """
    key = F.struct(*order)
    first = (df.groupBy("conv_id", "role", "digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    joined = df.join(first, df["conv_id"].eqNullSafe(first["c"]) & df["role"].eqNullSafe(first["r"]) & (df["digest"] == first["d"]),
                     "left")
    last = F.regexp_extract("text", rf"([^{_WHITE}])[{_WHITE}]*\z", 1)
    return joined.withColumn("fault", F.when(last == "", BLANK).when(F.col("first") < key, DUPLICATE)
                             .when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)).drop("c", "r", "d", "first")


class _Conversation:
    """What is made of one conversation's rows in order: rows that go out by ``add``, and at its end by ``result``."""

    def add(self, *row) -> Iterator[tuple]:
        return iter(())

    def result(self) -> Iterator[tuple]:
        return iter(())


def _streamed(rows: DataFrame, by: list[str], columns: list[str], take: Callable[[], _Conversation], fields: str) -> DataFrame:
    """conv_id and ``fields``: what ``take()`` makes of each conversation's ``columns``, its rows in the order ``by``."""
    names = ["conv_id", *[f.split()[0] for f in fields.split(", ")]]
    types = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, kind = None, None, None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *types], strict=True)], names)

        for b in batches:
            out: list[tuple] = []
            kind = b.schema.field("conv_id").type
            for mine, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now is None or mine != conv:
                    if now is not None:
                        out.extend((conv, *r) for r in now.result())
                    now, conv = take(), mine
                out.extend((conv, *r) for r in now.add(*row))
            if out:
                yield batch(out)
        if now is not None and (out := [(conv, *r) for r in now.result()]):
            yield batch(out)

    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", *by).select("conv_id", *columns)
            .mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, {fields}"))


class _Faults(_Conversation):
    """Counts, and the repair, of a conversation's rows in order."""

    def __init__(self):
        self.repair, self.counts = Repair(), {BLANK: 0, DUPLICATE: 0, CUT: 0, NONE: 0}
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.before = None

    def add(self, turn: int | None, initial: str, fault: str | None) -> Iterator[tuple]:
        if fault is None:  # stands for a conversation all of whose rows may be gone
            return iter(())
        self.counts[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.repair.feed(initial, fault)
        return iter(())

    def result(self) -> Iterator[tuple]:
        cost, audit = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        yield gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, cost, audit


class _Rows(_Conversation):
    """The repaired rows with their places; the audit comes first."""

    def __init__(self):
        self.mended = Mended()

    def add(self, audit: str | None, role: str | None, text: str | None) -> Iterator[tuple]:
        if audit is not None:
            self.mended = Mended(audit)
            return
        for row in self.mended.feed(role, text):
            yield (self.mended.made - 1, *row)

    def result(self) -> Iterator[tuple]:
        for row in self.mended.finish():
            yield (self.mended.made - 1, *row)


class _Digest(_Rows):
    """The running digest of a conversation's repaired rows."""

    def __init__(self):
        super().__init__()
        self.sha = hashlib.sha256()

    def _take(self, rows: Iterator[tuple]) -> None:
        for place, role, text in rows:
            self.sha.update((("\n" if place else "") + f"{role}:{text}").encode("utf-8", "replace"))

    def add(self, audit: str | None, role: str | None, text: str | None) -> Iterator[tuple]:
        self._take(super().add(audit, role, text))
        return iter(())

    def result(self) -> Iterator[tuple]:
        self._take(super().result())
        yield (self.sha.hexdigest(),)


_ORDER = ["turn", "role", "digest", "uid"]


def ordered(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, uid of a table of turns: its rows with what puts them in order.

    Rows are taken by turn, nulls first; rows of one turn by role, then text
    hash; equal rows are interchangeable. A null role or text counts as one
    space. Stored, so that uid is the same for all later uses.
    """
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"),
                     *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return stored(rows.withColumn("digest", F.unhex(F.md5("text"))).withColumn("uid", F.monotonically_increasing_id()), "repair")


def repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of ``ordered`` rows, stored.

    A null conv_id is a conversation of its own. ``conversations`` (conv_id)
    adds those that have no row: zeros and an empty audit. Conversations are
    streamed in order; a parse keeps a reference a row. An empty table gives an
    empty result.
    """
    judged = faults(rows, _ORDER).select("conv_id", F.substring("role", 1, 1).alias("initial"), "fault", *_ORDER)
    if conversations is not None:
        judged = judged.unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)
    return stored(_streamed(judged, _ORDER, ["turn", "initial", "fault"], _Faults,
                            "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "repair")


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows and, sorting before each conversation's, its audit."""
    return (rows.withColumn("part", F.lit(1)).withColumn("audit", F.lit(None).cast("string"))
            .unionByName(audits.select("conv_id", "audit").withColumn("part", F.lit(0)), allowMissingColumns=True))


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the conversations of ``ordered`` rows after the repairs of ``repairs``."""
    return _streamed(_with_audits(rows, audits), ["part", *_ORDER], ["audit", "role", "text"], _Rows,
                     "place long, role string, text string")


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256: ``role:text`` of the repaired rows, newline-joined, as a running digest of one batch at a time."""
    hashes = _streamed(_with_audits(rows, audits), ["part", *_ORDER], ["audit", "role", "text"], _Digest,
                       "repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return audits.join(hashes, audits["conv_id"].eqNullSafe(hashes["c"])).drop("c")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes
    its ``[.!?]`` out, 3 repeats it, 4 sets its role to user; others stay. Nulls count as one space, but a null turn or
    conv_id stays null."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return (df.withColumn("kind", kind).where("kind <> 0")
            .withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text")))
