"""Conversation repair against a search over all edits, and the whole query against a plain Python version."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from lexispark.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string, audit string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Least (cost, audit) over all edits of (initial, fault) rows, whole audits compared."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, p = heapq.heappop(heap)
        if (i, p) in done:
            continue
        done.add((i, p))
        if i == len(rows) and p in (0, 3):
            return cost, audit
        for x in "ua":
            if (p, x) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[p, x]))
        if i < len(rows):
            x, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, p))
            if fault not in "bd":
                more = cost + (fault == "t")
                if (p, x) in NEXT:
                    heapq.heappush(heap, (more, audit + "K", i + 1, NEXT[p, x]))
                for y in "ua":
                    if (p, y) in NEXT:
                        heapq.heappush(heap, (more + 2, audit + "R", i + 1, NEXT[p, y]))


def plain(given):
    """The query's contract on (conv_id, turn, role, text) rows, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in given}:
        rows = []
        for c, turn, role, text in given:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "n"
            seen.add((role, text))
            judged.append((role[:1], fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit = cheapest(judged)
        made, at, it = [], "u", iter(rows)
        for e in audit:
            _, role, text = (None, None, "") if e == "I" else next(it)
            if e == "D":
                continue
            if e == "K" and role[0] == "s":
                made.append((role, text))
                continue
            made.append((role if e == "K" else {"u": "user", "a": "assistant"}[at], text))
            at = "a" if at == "u" else "u"
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
        count = [sum(f == x for _, f in judged) for x in "bdt"]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def test_tables_of_the_grammar():
    assert len(repair.Tables(repair.GRAMMAR).states) == 9
    with pytest.raises(ValueError, match="SLR"):
        repair.Tables((("E", ("E", "E")), ("E", ("x",))))


@pytest.mark.parametrize("length", [0, 1, 2, 3, 6, 12, 30])
def test_cheapest_repair(length):
    rng = random.Random(length)
    for _ in range(400):
        rows = [(rng.choice("suau?a"), rng.choice("nnntbd")) for _ in range(length)]
        r = repair.Repair()
        for x in rows:
            r.feed(*x)
        assert r.finish() == cheapest(rows), rows


def test_equal_tops_are_merged():
    r = repair.Repair()
    for i in range(20_000):
        r.feed("ua?su"[i % 5], "ntb"[i % 3])
        assert len(r.branches) <= 5
    assert len(repair._STACK.nodes) < 20


def answer(spark, given):
    df = spark.createDataFrame([(*r, "x") for r in given], TURNS).repartition(3)
    rows = repair.ordered(repair.damaged(df))
    audits = repair.repairs(rows, df)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired_hashes(rows, audits).collect()}
    return got, rows, audits


def test_whole_query_on_random_conversations(spark):
    rng = random.Random(9)
    texts = ["Yes.", "No", "", " \n", "Why?", "Ok!  ", "é漢.", "x" * 3000, None]
    given = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts))
             for c in range(120) for t in range(rng.choice([1, 2, 5, 9, 25])) if rng.random() < 0.9]
    given += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (500, None, "user", "q?"), (500, None, "assistant", "r."),
              (501, 3, "user", "same."), (501, 3, "user", "same."), (501, 3, "assistant", "same."), (502, -5, "user", "m."), (502, 9, "user", "m.")]
    got, rows, audits = answer(spark, given)
    assert got == plain(given)
    made = {}
    for r in repair.repaired_rows(rows, audits).orderBy("place").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(made.get(c, [])).encode()).hexdigest() == x[-1] for c, x in got.items())


def test_a_conversation_without_rows_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got, _, _ = answer(spark, [(conv, 0, "user", "gone.")])
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_conversation_of_many_equal_rows(spark):
    given = [(1, t, "user", "again.") for t in range(3000)]
    got, _, _ = answer(spark, given)
    assert got == plain(given)


def test_no_rows(spark):
    got, rows, audits = answer(spark, [])
    assert got == {} and repair.repaired_rows(rows, audits).count() == 0


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in queries.op13_repair(spark, sf).collect()} == plain(given)
