"""Repair of the turn structure of conversations by cheapest edits.

A conversation's roles must read user, assistant, user, assistant and so on,
after at most one system turn. Iterative-deepening A* finds the cheapest edits:
depth-first search in ASCII order of the edits under a cost bound that rises to
the least estimate beyond it. Within a bound, a table keeps how much could be
spent from a place in the conversation without success. The first accepting
path is the cheapest one and, of those, the least in ASCII order.

A conversation of more than WHOLE_ROWS rows is cut into pieces that are searched
by themselves, from every state to every state, and whose ways are then joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import batches

#: Rows of a conversation that one search takes whole.
WHOLE_ROWS = 512
#: Rows of a piece of a longer conversation.
PIECE_ROWS = 64
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant; the role that each needs next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
#: What closes a conversation in each state.
CLOSING = ("", "II", "I", "")
NEVER = 1 << 60


def _keeps(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is, None if it may not stay."""
    if initial == NEEDS[state][0]:
        return AFTER[state]
    return SYSTEM if state == START and initial == "s" else None


def _estimates(code: str) -> tuple[list[int], list[int], list[int]]:
    """The least cost of each row that isn't first, of all rows from each place on, and of those if none stands before.

    A row that is cut short costs something in any case, and so do a system turn
    that isn't first and one of two neighbours that may not follow each other.
    """
    least = [
        (min(DELETE, REROLE + TRUNCATED) if c in "OS" else TRUNCATED) if c.isupper() else REROLE if c in "os" else 0 for c in code]
    rest, first = [0] * (len(code) + 2), [0] * (len(code) + 1)
    for i in range(len(code) - 1, -1, -1):
        rest[i] = least[i] + rest[i + 1]
        if code[i : i + 2].lower() in ("uu", "aa"):
            a, b = least[i], least[i + 1]
            rest[i] = max(rest[i], min(INSERT + a + b, DELETE + a, DELETE + b) + rest[i + 2])
        stays = (0 if code[i] in "suSU" else REROLE) + (TRUNCATED if code[i].isupper() else 0)
        first[i] = min(DELETE + first[i + 1], stays + rest[i + 1], INSERT + rest[i])
    return least, rest, first


@lru_cache(maxsize=100_000)
def search(code: str, entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest way from ``entry``, ties by ASCII order; None if there is none.

    ``code`` has a letter for each row: s, u or a for the role's initial, o for
    any other one, upper case if the text is cut short. With a ``goal`` the way
    ends there right after the last row; else it closes the conversation.
    """
    n = len(code)
    least, rest, first = _estimates(code)

    def estimate(i: int, state: int) -> int:
        if i == n:
            if goal is None:
                return INSERT * len(CLOSING[state])
            return 0 if state == goal else NEVER
        if goal in (START, SYSTEM):  # all rows go, or all but a system turn
            return NEVER if state > goal else DELETE * (n - i - (state < goal))
        if state == START:
            return first[i]
        if code[i] in "oOsS" or _keeps(state, code[i].lower()) is not None:
            return rest[i]
        return max(rest[i], min(INSERT + least[i], DELETE) + rest[i + 1])

    bound = estimate(0, entry)
    while bound < NEVER:
        beyond, failed = NEVER, {}
        stack: list[tuple] = [(0, entry, 0, None)]
        while stack:
            i, state, spent, trail = stack.pop()
            total = spent + estimate(i, state)
            if total > bound:
                beyond = min(beyond, total)
                continue
            if i == n and (state == goal if goal is not None else not CLOSING[state]):
                edits = []
                while trail:
                    trail, edit = trail
                    edits.append(edit)
                return spent, "".join(reversed(edits))
            # marked on the way in: whoever comes back here by inserts has less left
            if failed.get((i, state), -1) >= bound - spent:
                continue
            failed[i, state] = bound - spent
            # the last one pushed goes first: D, I, K, R
            if i < n:
                more = TRUNCATED if code[i].isupper() else 0
                stack.append((i + 1, AFTER[state], spent + REROLE + more, (trail, "R")))
                if (after := _keeps(state, code[i].lower())) is not None:
                    stack.append((i + 1, after, spent + more, (trail, "K")))
            if i < n or goal is None:
                stack.append((i, AFTER[state], spent + INSERT, (trail, "I")))
            if i < n:
                stack.append((i + 1, state, spent + DELETE, (trail, "D")))
        bound = beyond
    return None


def fault_of(text: str) -> str:
    """blank, truncated or an empty string."""
    said = text.rstrip(BLANKS)
    return "blank" if not said else "" if said[-1] in ".!?" else "truncated"


def encode(rows: list[tuple[str, str, int]]) -> tuple[str, list[int]]:
    """The code of the rows that need not go, and how many go before each of them and at the end.

    A row is (role, fault, copies); copies after the first one have to go. Such
    rows have one way only, and an insert next to them is least after them, so
    they don't take part in the search.
    """
    code, gone = [], [0]
    for role, fault, copies in rows:
        if fault in ("blank", "duplicate"):
            gone[-1] += copies
            continue
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        code.append(letter.upper() if fault == "truncated" else letter)
        gone.append(copies - 1)
    return "".join(code), gone


def with_gone(edits: str, gone: list[int]) -> str:
    """The edits with a D for each row that had to go."""
    if not any(gone):
        return edits
    parts, row = ["D" * gone[0]], 0
    for edit in edits:
        parts.append(edit)
        if edit != "I":
            row += 1
            parts.append("D" * gone[row])
    return "".join(parts)


def apply_edits(rows: list[tuple[str, str, int]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The (role, text) pairs after the edits; rows are (role, text, copies)."""
    out = []
    each = ((role, text) for role, text, copies in rows for _ in range(copies))
    for edit in audit:
        if edit == "I":
            out.append((NEEDS[state], ""))
        else:
            role, text = next(each)
            if edit == "D":
                continue
            out.append((role if edit == "K" else NEEDS[state], text))
            if edit == "K":
                state = _keeps(state, role[:1])
                continue
        state = AFTER[state]
    return out


def _illegal(roles: list[tuple[str, int]]) -> int:
    """Neighbours whose initials may not follow each other; roles are (role, copies)."""
    initials = [(role[:1], copies) for role, copies in roles]
    apart = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return apart + sum(copies - 1 for _, copies in initials)


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in source for row in zip(*(c.to_pylist() for c in batch.columns)))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == batches.BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _map_rows(df: DataFrame, schema: str, make) -> DataFrame:
    """``mapInArrow`` of a generator from record batches to tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(spark_schema)
    return df.mapInArrow(lambda source: _in_batches(make(source), arrow), spark_schema)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows with planted faults, by a checksum of ``conv_id:turn``.

    Nulls of role and text, and of the checksum's parts, count as one space.
    Of twenty remainders 0 drops the row (no copies), 1 empties its text, 2 takes
    its stops away, 3 repeats it and 4 makes its role user.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [part.split()[0] for part in COUNTS.split(", ")]
#: Turns that are missing between the first and the last one.
GAPS = "coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)"
PAIRS = "repaired array<struct<role:string,text:string>>"
WAYS = "ways array<struct<entry:int,exit:int,cost:long,audit:string>>"


def _whole(rows: list[tuple]) -> tuple:
    """Counts, audit, digest and pairs of one conversation of (turn, role, text, copies) rows."""
    rows = [r for r in rows if r[3]]
    seen, judged = set(), []
    blank = duplicate = truncated = 0
    for _, role, text, copies in rows:
        fault = fault_of(text)
        if fault == "blank":
            blank += copies
        else:
            again = (role, text) in seen
            seen.add((role, text))
            duplicate += copies - (not again)
            if again:
                fault = "duplicate"
            truncated += fault == "truncated"
        judged.append((role, fault, copies))
    code, gone = encode(judged)
    cost, edits = search(code)
    audit = with_gone(edits, gone)
    pairs = apply_edits([r[1:] for r in rows], audit)
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in pairs).encode()).hexdigest()
    return (gaps, blank, duplicate, truncated, _illegal([(r[1], r[3]) for r in rows]), cost + DELETE * sum(gone), audit, digest,
            [{"role": role, "text": text} for role, text in pairs])


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of bounded length, each searched whole."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = rows.select("conv_id", "turn", "role", "text", "copies").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(source):
        for conv, held in groupby(_rows(source), key=lambda row: row[0]):
            *counts, pairs = _whole([row[1:] for row in held])
            yield conv, 0, *counts, pairs

    return _map_rows(sorted_rows, f"conv_id {kind}, piece long, {COUNTS}, {PAIRS}", run)


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Pieces of long conversations in the order of (conv_id, part, piece), with the ways through each.

    Equal rows are one row with a number of copies before anything moves, and
    the range of a partition ends anywhere in a conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    said = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
    said = batches.stage(said.withColumn("digest", F.sha2("text", 256)), "repair-said")
    at = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = said.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"))
    a, b = said.alias("a"), firsts.alias("b")
    judged = a.join(b, F.expr("a.conv_id <=> b.conv_id AND a.role = b.role AND a.digest = b.digest")).select(
        "a.conv_id", "a.turn", "a.role", "a.text", "a.copies",
        (~F.struct(F.col("a.turn").isNotNull().alias("given"), F.col("a.turn").alias("turn")).eqNullSafe(F.col("b.first"))).alias("again"))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = judged.repartitionByRange(partitions, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(source):
        part = TaskContext.get().partitionId()

        def made(conv, piece, held):
            judged, blank, duplicate, truncated = [], 0, 0, 0
            for _, role, text, copies, again in held:
                fault = fault_of(text)
                if fault == "blank":
                    blank += copies
                else:
                    duplicate += copies - (not again)
                    fault = "duplicate" if again else fault
                    truncated += fault == "truncated"
                judged.append((role, fault, copies))
            code, gone = encode(judged)
            ways = [
                {"entry": a, "exit": b, "cost": way[0] + DELETE * sum(gone), "audit": with_gone(way[1], gone)}
                for a in range(4) for b in range(4) if (way := search(code, a, b))]
            kept = [{"role": r[1], "text": r[2], "copies": r[3]} for r in held]
            return (conv, part, piece, held[0][1], held[-1][1], blank, duplicate, truncated,
                    _illegal([(r[1], r[3]) for r in held]), ways, kept)

        number = count()
        for conv, rows in groupby(_rows(source), key=lambda row: row[0]):
            while held := [row[1:] for row in islice(rows, piece_rows)]:
                yield made(conv, next(number), held)

    schema = (f"conv_id {kind}, part int, piece long, first_role string, last_role string, blank long, duplicate long, truncated long, "
              f"illegal long, {WAYS}, said array<struct<role:string,text:string,copies:long>>")
    return batches.stage(_map_rows(ranged, schema, run), "repair-pieces")


def _letters(node) -> Iterator[str]:
    while node:
        yield from node[0]
        node = node[3]


def _less(a, b) -> bool:
    """Whether the edits of list ``a`` come before those of ``b`` of equal cost, none of which starts with the other."""
    return next((x < y for x, y in zip(_letters(a), _letters(b)) if x != y), False)


def _joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, piece, entry, audit, cost, illegal): the best way of each piece of each conversation.

    Ways are joined from the last piece to the first one: for each state a linked
    list of the edits from there to the end. A task streams the pieces of a
    conversation and holds four such lists, which are as long as its audit. The first piece's row has the whole
    cost and the illegal neighbours of all pieces.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    narrow = pieces.select("conv_id", "part", "piece", "first_role", "last_role", "illegal", "ways")
    narrow = narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece"))

    def ended(conv, best, illegal):
        cost, node = best[START]
        state = START
        while node[3] is not None:
            edits, part, piece, rest, after = node
            last = rest[3] is None
            yield conv, part, piece, state, edits + rest[0] * last, cost, illegal
            cost = illegal = 0
            node, state = rest, after

    def run(source):
        for conv, rows in groupby(_rows(source), key=lambda row: row[0]):
            # a node: edits, part, piece, the rest of the list, state after the edits
            best = {s: (INSERT * len(CLOSING[s]), (CLOSING[s], -1, -1, None, None)) for s in range(4)}
            illegal, first = 0, None
            for _, part, piece, first_role, last_role, own, ways in rows:
                illegal += own + (first is not None and last_role[:1] + first[:1] not in ("su", "ua", "au"))
                first = first_role
                found: dict[int, tuple] = {}
                for way in ways:
                    if way["exit"] not in best:
                        continue
                    cost, rest = best[way["exit"]]
                    cost, node = cost + way["cost"], (way["audit"], part, piece, rest, way["exit"])
                    held = found.get(way["entry"])
                    if held is None or cost < held[0] or cost == held[0] and _less(node, held[1]):
                        found[way["entry"]] = (cost, node)
                best = found
            yield from ended(conv, best, illegal)

    return _map_rows(narrow, f"conv_id {kind}, part int, piece long, entry int, audit string, cost long, illegal long", run)


def _long(rows: DataFrame, piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """Conversations of any length by pieces; one row per piece, counts on the first one.

    The digest of a conversation runs over its text in order, which one task
    streams; it holds one piece at a time and the audit.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = _pieces(rows, piece_rows)
    ways = batches.stage(_joined(pieces), "repair-ways")
    a, b = pieces.alias("a"), ways.alias("b")
    both = a.join(b, F.expr("a.conv_id <=> b.conv_id AND a.part = b.part AND a.piece = b.piece")).select(
        "a.conv_id", "a.part", "a.piece", "a.blank", "a.duplicate", "a.truncated", "b.illegal", "b.cost", "b.entry", "b.audit", "a.said")

    def fill(source):
        for *kept, entry, audit, said in _rows(source):
            pairs = apply_edits([(r["role"], r["text"], r["copies"]) for r in said], audit, entry)
            yield *kept, audit, [{"role": role, "text": text} for role, text in pairs]

    filled = batches.stage(_map_rows(
        both, f"conv_id {kind}, part int, piece long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, {PAIRS}", fill), "repair-filled")

    def total(conv, held):
        sums, audit, digest, begun = [0] * 5, [], hashlib.sha256(), False
        for *counts, edits, pairs in held:
            sums = [x + y for x, y in zip(sums, counts)]
            audit.append(edits)
            for pair in pairs:
                digest.update(("\n" * begun + f"{pair['role']}:{pair['text']}").encode())
                begun = True
        return conv, *sums, "".join(audit), digest.hexdigest()

    def sum_up(source):
        for conv, held in groupby(_rows(source), key=lambda row: row[0]):
            yield total(conv, (row[1:] for row in held))

    ordered = filled.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select(
        "conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    totals = _map_rows(
        ordered, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", sum_up)
    turns = rows.where("copies > 0").groupBy("conv_id").agg(F.expr(GAPS).alias("gaps"))
    t, g = totals.alias("t"), turns.alias("g")
    reports = t.join(g, F.expr("t.conv_id <=> g.conv_id")).select("t.conv_id", "g.gaps", *(f"t.{c}" for c in NAMES[1:]))
    texts = filled.select("conv_id", (F.col("part").cast("long") * (1 << 40) + F.col("piece")).alias("piece"), "repaired")
    return reports, texts


def repair(rows: DataFrame, whole_rows: int = WHOLE_ROWS, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired texts of conversations of (conv_id, turn, role, text, copies) rows.

    A report is (conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256), one for each conv_id, also if none of its rows has
    copies: zeros, an empty audit and the digest of an empty string. Texts are
    (conv_id, piece, repaired), the pairs of a conversation in order of piece.

    Rows are taken by turn, nulls first; rows of one turn by role and text. A null
    conv_id is one conversation. Role and text must not be null. Repeated rows
    are duplicates. A role that starts with none of s, u and a, or is empty, has
    no place: its row is given another role or goes. Texts of any length are
    taken whole. An empty table gives empty tables. Other columns are not read.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    long = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > whole_rows).select("conv_id")
    long = batches.stage(long, "repair-long")
    if long.isEmpty():
        whole = batches.stage(_short(rows), "repair-whole")
        return whole.select("conv_id", *NAMES), whole.select("conv_id", "piece", "repaired")
    r, x = rows.alias("r"), batches.broadcast_if_small(long).alias("x")
    same = F.expr("r.conv_id <=> x.conv_id")
    whole = batches.stage(_short(r.join(x, same, "left_anti")), "repair-whole")
    reports, texts = _long(r.join(x, same, "left_semi"), piece_rows)
    return (
        whole.select("conv_id", *NAMES).union(batches.stage(reports, "repair-reports")),
        whole.select("conv_id", "piece", "repaired").union(texts))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, fault counts, cost, edits and digest of every conversation, after planted damage."""
    return repair(damage(batches.table(spark, folder, "conversations")))[0]
