import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import batches, repair

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, pairs) by Dijkstra over (place, state) ordered by cost, then by edits; rows are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, pairs = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(pairs)
        wanted = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, wanted[0], (*pairs, (wanted, ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, pairs))
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            if role[:1] == wanted[0] or role[:1] == "s" and last == "":
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*pairs, (role, text))))
            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, wanted[0], (*pairs, (wanted, text))))


def plain(rows):
    """The report of one conversation's (conv_id, turn, role, text) rows, damage included."""
    said = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        said += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    judged, seen = [], set()
    for _, role, text in said:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, audit, pairs = cheapest(judged)
    assert GOOD.fullmatch("".join(role[0] for role, _ in pairs))
    turns = {t for t, *_ in said if t is not None}
    faults = [f for *_, f in judged]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in pairs).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return {conv: plain(own) for conv, own in out.items()}


@settings(max_examples=400, deadline=None)
@given(st.text("suaoSUAO", max_size=9))
def test_search_is_cheapest_and_least(code):
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    rows = [(roles[c.lower()], "x", "truncated" if c.isupper() else "") for c in code]
    assert repair.search(code) == cheapest(rows)[:2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "blank", "duplicate", "truncated"])), max_size=8))
def test_rows_that_must_go(rows):
    code, gone = repair.encode([(role, fault, 1) for role, fault in rows])
    cost, edits = repair.search(code)
    assert (cost + 4 * sum(gone), repair.with_gone(edits, gone)) == cheapest([(role, "x", fault) for role, fault in rows])[:2]


def test_estimates_hold_on_long_repetitions():
    for code in ("u" * 300, "ua" * 200 + "s" * 50, "o" * 200, "UA" * 150 + "aa" * 40):
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
        assert repair.search(code) == cheapest([(roles[c.lower()], "x", "truncated" if c.isupper() else "") for c in code])[:2]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in repair.op11_conversation_repair(spark, FOLDER).collect()}
    assert got == by_conversation(rows)


EDGES = [
    (1, None, "user", "Hello."), (1, 2, None, None), (1, 9, "assistant", "Bye"), (None, 1, "system", "Be kind."), (None, None, "user", "Hi."),
    (2, 0, "", "what."), (2, 1, "tool", "x." * 50_000), (2, 1, "tool", "x." * 50_000), (2, 1, "user", "\x0b \t"), (2, 1, "unknown", "é"),
    (3, None, None, None), (4, -5, "user", "A!"), (4, 5, "system", "\x1c"), (4, 7, "assistant", "ok?\n"),
]


def wild(n, seed, convs):
    pick = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None], ["Yes.", "No", "", " ", None, "So?", "well!"]
    return [(pick.choice(convs), pick.choice([None, *range(n // 2)]), pick.choice(roles), pick.choice(texts) if i % 3 else f"t{i}.") for i in range(n)]


@pytest.mark.parametrize("whole, piece", [(512, 64), (4, 3), (0, 1)])
def test_edge_rows_and_pieces(spark, whole, piece):
    """Whole conversations and pieces of any length give the same reports and texts."""
    batches.session(spark)
    rows = EDGES + wild(160, 5, [7, 7, 7, 8, 9])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, piece int, audit string")
    reports, texts = repair.repair(repair.damage(df), whole, piece)
    expected = by_conversation(rows)
    assert {r.conv_id: tuple(r)[1:] for r in reports.collect()} == expected
    joined = {}
    for r in sorted(texts.collect(), key=lambda r: r.piece):
        joined.setdefault(r.conv_id, []).extend(f"{p.role}:{p.text}" for p in r.repaired)
    for conv, report in expected.items():
        assert hashlib.sha256("\n".join(joined.get(conv, [])).encode()).hexdigest() == report[-1]


def test_one_conversation_of_many_rows(spark):
    """A third of the rows are copies of one row; others of that conversation differ only in late parts of the text."""
    batches.session(spark)
    rows = [(1, 0, "user", "same.")] * 400 + [(1, None, "assistant", "p" * 70 + f"{i}.") for i in range(300)] + wild(500, 8, [1])
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damage(df), piece_rows=16)[0].collect()} == by_conversation(rows)


def test_empty_table(spark):
    batches.session(spark)
    reports, texts = repair.repair(repair.damage(spark.createDataFrame([], SCHEMA)))
    assert reports.count() == texts.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("suaoSUAO", max_size=7), st.text("suaoSUAO", max_size=7))
def test_ways_through_two_pieces(left, right):
    """The cheapest pair of ways through both halves is the way through the whole."""
    pairs = [
        (a[0] + b[0], a[1] + b[1]) for exit in range(4)
        if (a := repair.search(left, 0, exit)) and (b := repair.search(right, exit))]
    assert min(pairs) == repair.search(left + right)
