"""Row change logs: order, route, compact, apply, describe.

A change log holds one row per changed row, with the columns of
``CHANGE_LOG_COLUMNS``: log position (``file``, ``pos``), transaction,
database, table, event kind, key, after image and some before images.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import coords, text
from ..plans import sizes, skew
from .inspect import Key, key_columns

# Event kinds and their codes in the binary log header.
INSERT, UPDATE, DELETE = "WriteRows", "UpdateRows", "DeleteRows"
ROTATE, QUERY, FORMAT, UNKNOWN = "Rotate", "Query", "FormatDescription", "Unknown"
ROW_EVENTS = (INSERT, UPDATE, DELETE)
EVENT_CODES = {2: QUERY, 4: ROTATE, 15: FORMAT, 19: INSERT, 20: UPDATE, 21: DELETE}
HEADER_BYTES = 19
#: Column that orders the rows of one event: old keys go before new rows come.
ORDINAL = "ord"

#: Rotations up to this number become one expression.
MAX_INLINE_ROTATIONS = 64
#: Log files up to this number are broadcast.
MAX_LOG_FILES = 100_000
#: Transaction domains up to this number are broadcast.
MAX_DOMAINS = 100_000


def _kind() -> Column:
    return F.col("event_type")


def _at(events: DataFrame) -> Column:
    """Place of a row in the log; rows of one event may have an ordinal."""
    return F.struct("seq", "pos", ORDINAL) if ORDINAL in events.columns else F.struct("seq", "pos")


def with_sequence(log: DataFrame) -> DataFrame:
    """Add the file number that orders the log files."""
    return log if "seq" in log.columns else log.withColumn("seq", coords.file_sequence(F.col("file")))


def route_events(log: DataFrame, db: str, table: str, hint_table: str) -> DataFrame:
    """Events a migration handles.

    The hint table always passes, row events only for our table, rotations
    and queries always, all else never.
    """
    keep = (
        F.when(F.col("tbl") == hint_table, True)
        .when(_kind().isin(*ROW_EVENTS), (F.col("db") == db) & (F.col("tbl") == table))
        .otherwise(_kind().isin(ROTATE, QUERY))
    )
    return log.where(keep)


def row_events(log: DataFrame, db: str, table: str) -> DataFrame:
    """Row events of one table, with the file number."""
    return with_sequence(
        log.where(_kind().isin(*ROW_EVENTS) & (F.col("db") == db) & (F.col("tbl") == table))
    )


def order_events(log: DataFrame) -> DataFrame:
    return with_sequence(log).orderBy("seq", "pos")


def events_between(log: DataFrame, start: tuple[str, int], end: tuple[str, int]) -> DataFrame:
    """Events after ``start`` up to and including ``end``; ``reached`` tells
    whether the log goes as far as ``end``."""
    events = with_sequence(log)
    lo, hi = (_sequence_of(f) for f, _ in (start, end))
    seq, pos = F.col("seq"), F.col("pos")
    beyond = events.where(coords.at_or_after(seq, pos, hi, end[1])).select("seq").limit(1)
    reached = len(beyond.collect()) > 0
    return events.where(
        coords.after(seq, pos, lo, start[1]) & coords.up_to(seq, pos, hi, end[1])
    ).withColumn("reached", F.lit(reached))


def _sequence_of(file: str) -> int:
    tail = file.rpartition(".")[2] if "." in file else ""
    return int(tail) if tail.isdigit() else 0


def _whole_key(key: Key) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key_columns(key)])


def split_key_changes(log: DataFrame, key: Key, before_key: Key) -> DataFrame:
    """Updates that change the key as two rows: the old key goes, then the new row comes.

    ``before_key`` names the columns with the key before the event, in the
    order of ``key``. Row logs carry whole images, so the new row comes whether
    or not the old key was there. Of all rows at one position the old keys go
    first, so one event may also exchange keys or shift them all. Rows without
    a whole key on both sides, and all other events, stay as they are.
    """
    keys, olds = key_columns(key), key_columns(before_key)
    if len(keys) != len(olds):
        raise ValueError(f"{len(olds)} columns before, {len(keys)} after")
    old = [F.col(o).cast(log.schema[k].dataType) for k, o in zip(keys, olds)]
    moved = (
        (_kind() == UPDATE) & _whole_key(key) & _whole_key(before_key)
        & ~reduce(lambda a, b: a & b, [F.col(k) == o for k, o in zip(keys, old)])
    )

    def row(ordinal: int, kind: Column, values: list[Column]) -> Column:
        named = [v.alias(k) for k, v in zip(keys, values)]
        return F.struct(F.lit(ordinal).alias(ORDINAL), kind.alias("event_type"), *named)

    now = [F.col(k) for k in keys]
    rows = F.when(moved, F.array(row(0, F.lit(DELETE), old), row(1, F.lit(INSERT), now))).otherwise(
        F.array(row(1, _kind(), now))
    )
    kept = [c for c in log.columns if c not in (*keys, "event_type", ORDINAL)]
    return log.select(*kept, F.inline(rows)).select(*log.drop(ORDINAL).columns, ORDINAL)


def latest_change(log: DataFrame, key: Key) -> DataFrame:
    """Last event per key, combined before the shuffle."""
    keys = key_columns(key)
    events = with_sequence(log).where(_whole_key(key))
    return (
        events.groupBy(*keys)
        .agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), _at(events)).alias("_r"))
        .select(*keys, "_r.*")
    )


# --- applying changes -------------------------------------------------------


def _merge(snapshot: DataFrame, changes: DataFrame, key: Key, cols: Sequence[str],
           broadcast: bool | None = None) -> DataFrame:
    """Apply per-key changes to a snapshot with one row per key.

    ``changes`` holds the key, ``_img`` (new values) and the flags ``_set``
    (overwrite a present row), ``_gone`` (remove it) and ``_new`` (add if
    absent). Both sides meet in one full outer join. Only if the change set
    is small and the snapshot is not, the changes are broadcast: that computes
    them three times and reads the keys twice, but leaves the snapshot where
    it is.
    """
    if broadcast is None:
        broadcast = sizes.fits(changes, sizes.BROADCAST_BYTES) and not sizes.fits(snapshot, sizes.CHEAP_SHUFFLE_BYTES)
    schema = snapshot.schema
    keys = key_columns(key)

    def settle(joined: DataFrame) -> DataFrame:
        kept = joined.where(~F.coalesce(F.col("_gone"), F.lit(False))).select(
            *keys,
            *[
                F.when(F.col("_set"), F.col(f"_img.{c}")).otherwise(F.col(c)).cast(schema[c].dataType).alias(c)
                for c in cols
            ],
        )
        return kept.select(*snapshot.columns)

    if not broadcast:
        joined = snapshot.select(*keys, *cols, F.lit(True).alias("_here")).join(changes, keys, "full")
        absent = F.col("_here").isNull()
        return settle(
            joined.where(~absent | F.col("_new"))
            .withColumn("_set", absent | F.col("_set"))
            .withColumn("_gone", ~absent & F.col("_gone"))
        )
    kept = settle(snapshot.select(*keys, *cols).join(F.broadcast(changes), keys, "left"))
    fresh = changes.where("_new")
    known = snapshot.select(*keys).join(F.broadcast(fresh.select(*keys)), keys, "left_semi")
    added = fresh.join(known, keys, "left_anti").select(
        *keys, *[F.col(f"_img.{c}").cast(schema[c].dataType).alias(c) for c in cols]
    )
    return kept.unionByName(added)


def _values(snapshot: DataFrame, key: Key) -> list[str]:
    return [c for c in snapshot.columns if c not in key_columns(key)]


def apply_inserts(snapshot: DataFrame, log: DataFrame, key: Key, on_conflict: str = "replace") -> DataFrame:
    """Add the after images of inserts.

    On a live key ``replace`` takes the last insert, ``keep`` the row that was
    there first, ``error`` fails the job.
    """
    if on_conflict not in ("replace", "keep", "error"):
        raise ValueError(on_conflict)
    cols = _values(snapshot, key)
    pick = F.min_by if on_conflict == "keep" else F.max_by
    events = with_sequence(log).where((_kind() == INSERT) & _whole_key(key))
    inserts = events.groupBy(*key_columns(key)).agg(
        pick(F.struct(*cols), _at(events)).alias("_img"), F.count(F.lit(1)).alias("_n")
    )
    if on_conflict == "error":
        keys = key_columns(key)
        live = snapshot.select(*keys).join(inserts, keys, "left_semi")
        if inserts.where("_n > 1").select(*keys).union(live).limit(1).collect():
            raise ValueError(f"insert on a live {key}")
    changes = inserts.select(
        *key_columns(key), "_img", F.lit(True).alias("_new"), F.lit(on_conflict == "replace").alias("_set"),
        F.lit(False).alias("_gone"),
    )
    return _merge(snapshot, changes, key, cols)


def apply_updates(snapshot: DataFrame, log: DataFrame, key: Key, before_key: Key | None = None) -> DataFrame:
    """Set all other columns to the last after image; absent keys are skipped.

    With ``before_key`` an update may change the key (see ``split_key_changes``).
    """
    updates = with_sequence(log).where(_kind() == UPDATE)
    if before_key is not None:
        return apply_changes(snapshot, updates, key, before_key=before_key)
    cols = _values(snapshot, key)
    updates = updates.where(_whole_key(key))
    last = updates.groupBy(*key_columns(key)).agg(F.max_by(F.struct(*cols), _at(updates)).alias("_img"))
    schema = snapshot.schema
    updated = snapshot.join(last, key_columns(key), "left").select(
        *key_columns(key),
        *[
            F.when(F.col("_img").isNotNull(), F.col(f"_img.{c}")).otherwise(F.col(c)).cast(schema[c].dataType).alias(c)
            for c in cols
        ],
    )
    return updated.select(*snapshot.columns)


def apply_partial_updates(
    snapshot: DataFrame, log: DataFrame, key: Key, cols: Sequence[str],
    given: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Set only the listed columns, each to the last value given for it.

    ``given`` says per column when an event carries a value; by default when
    it is not NULL.
    """
    given = given or {}
    has = {c: given.get(c, F.col(c).isNotNull()) for c in cols}
    events = with_sequence(log).where((_kind() == UPDATE) & _whole_key(key))
    last = events.groupBy(*key_columns(key)).agg(
        *[F.max_by(F.struct(F.col(c).alias("v")), F.when(has[c], _at(events))).alias(f"_u_{c}") for c in cols]
    )
    schema = snapshot.schema
    return snapshot.join(last, key_columns(key), "left").select(
        *[
            F.when(F.col(f"_u_{c}").isNotNull(), F.col(f"_u_{c}.v")).otherwise(F.col(c)).cast(schema[c].dataType).alias(c)
            if c in cols
            else F.col(c)
            for c in snapshot.columns
        ]
    )


def apply_deletes(snapshot: DataFrame, log: DataFrame, key: Key) -> DataFrame:
    """Remove deleted keys; a NULL key matches nothing."""
    keys = key_columns(key)
    gone = log.where((_kind() == DELETE) & _whole_key(key)).select(*keys).distinct()
    return snapshot.join(gone, keys, "left_anti").select(*snapshot.columns)


def compact_changes(log: DataFrame, key: Key, cols: Sequence[str], before_key: Key | None = None) -> DataFrame:
    """Per key: the last event and the last event that decides if it lives.

    With ``before_key`` an update may change the key (see ``split_key_changes``).
    Compacted logs can be combined in any order and any number of times (see
    ``combine_compacted``).
    """
    events = with_sequence(log).where(_kind().isin(*ROW_EVENTS))
    if before_key is not None:
        events = split_key_changes(events, key, before_key)
    elif ORDINAL not in events.columns:
        events = events.withColumn(ORDINAL, F.lit(1))
    life = F.when(_kind().isin(INSERT, DELETE), _at(events))
    return events.where(_whole_key(key)).groupBy(*key_columns(key)).agg(
        F.max(_at(events)).alias("_at"),
        F.max_by(F.struct(*cols), _at(events)).alias("_img"),
        F.max(life).alias("_life_at"),
        F.max_by(_kind(), life).alias("_life"),
    )


def combine_compacted(parts: DataFrame, key: Key) -> DataFrame:
    """Merge compacted logs: per key the newest of each part wins."""
    return parts.groupBy(*key_columns(key)).agg(
        F.max("_at").alias("_at"),
        F.max_by("_img", "_at").alias("_img"),
        F.max("_life_at").alias("_life_at"),
        F.max_by("_life", "_life_at").alias("_life"),
    )


def apply_compacted(snapshot: DataFrame, compacted: DataFrame, key: Key, broadcast: bool | None = None) -> DataFrame:
    alive, dead = F.col("_life") == INSERT, F.coalesce(F.col("_life") == DELETE, F.lit(False))
    changes = compacted.select(
        *key_columns(key), "_img", F.coalesce(alive, F.lit(False)).alias("_new"), dead.alias("_gone"), F.lit(True).alias("_set")
    )
    return _merge(snapshot, changes, key, _values(snapshot, key), broadcast)


def apply_changes(
    snapshot: DataFrame, log: DataFrame, key: Key, broadcast: bool | None = None, before_key: Key | None = None
) -> DataFrame:
    """Inserts, updates and deletes in log order.

    The last insert or delete of a key decides if it lives, else the snapshot
    does; the values are those of its last event. With ``before_key`` updates
    may change the key. One aggregation of the log replaces the event-by-event
    replay.
    """
    return apply_compacted(snapshot, compact_changes(log, key, _values(snapshot, key), before_key), key, broadcast)


def apply_transactions(
    snapshot: DataFrame, log: DataFrame, key: Key, tx: str, bad: Column, before_key: Key | None = None
) -> DataFrame:
    """As ``apply_changes``, without the transactions that hold a bad event."""
    broken = log.where(bad & F.col(tx).isNotNull()).select(tx).distinct()
    return apply_changes(snapshot, log.join(broken, tx, "left_anti"), key, before_key=before_key)


# --- describing changes -----------------------------------------------------


def changed_cells(log: DataFrame, key: Key, cells: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per changed cell; ``cells`` maps a name to its before and after columns."""
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(before).cast("string").alias("before_value"),
            F.col(after).cast("string").alias("after_value"),
        )
        for name, (before, after) in cells.items()
    ]
    rows = with_sequence(log).where(_kind().isin(*ROW_EVENTS))
    return rows.select("seq", "pos", *key_columns(key), F.inline(F.array(*entries))).where(
        ~F.col("before_value").eqNullSafe(F.col("after_value"))
    )


def change_statements(log: DataFrame, key: Key, cols: Sequence[str], before_key: Key | None = None) -> DataFrame:
    """Audit text of each changed row as an INSERT, UPDATE or DELETE.

    With ``before_key`` an update finds its row by the old key, and sets the
    key columns that changed.
    """
    target = text.combine_database_table(F.col("db"), F.col("tbl"))
    keys = key_columns(key)
    every = [*keys, *cols]
    name = {c: "`" + c.replace("`", "``") + "`" for c in every}

    def value(c: str) -> Column:
        if isinstance(log.schema[c].dataType, T.NumericType):  # digits need no escapes
            return F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("NULL"))
        return text.sql_value(F.col(c))

    where = F.concat(
        F.lit(" WHERE "), F.concat_ws(" AND ", *[F.concat(F.lit(f"{name[k]} = "), value(k)) for k in keys])
    )
    insert = F.concat(
        F.lit("INSERT INTO "), target, F.lit(" (" + ", ".join(name[c] for c in every) + ") VALUES ("),
        F.concat_ws(", ", *[value(c) for c in every]), F.lit(")"),
    )
    olds = keys if before_key is None else key_columns(before_key)
    was = {k: o if o == k else f"_old_{k}" for k, o in zip(keys, olds)}
    # rows without an old key keep their own
    log = log.withColumns({
        was[k]: F.coalesce(F.col(o).cast(log.schema[k].dataType), F.col(k)) for k, o in zip(keys, olds) if o != k
    })
    found = F.concat_ws(" AND ", *[F.concat(F.lit(f"{name[k]} = "), value(was[k])) for k in keys])
    changed = [F.when(F.col(k) != F.col(was[k]), F.concat(F.lit(f"{name[k]} = "), value(k))) for k in keys if was[k] != k]
    update = F.concat(
        F.lit("UPDATE "), target, F.lit(" SET "),
        F.concat_ws(", ", *changed, *[F.concat(F.lit(f"{name[c]} = "), value(c)) for c in cols]),
        F.lit(" WHERE "), found,
    )
    delete = F.concat(F.lit("DELETE FROM "), target, where)
    stmt = F.when(_kind() == INSERT, insert).when(_kind() == UPDATE, update).when(_kind() == DELETE, delete)
    return with_sequence(log).where(_kind().isin(*ROW_EVENTS)).select("seq", "pos", *keys, stmt.alias("stmt"))


def event_counts(log: DataFrame) -> DataFrame:
    """Events and row events per file, table and kind, with all subtotals.

    ``level`` is 0 for the finest groups, 1 and 3 for subtotals, 7 for all.
    """
    return log.rollup("file", "tbl", "event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(_kind().isin(*ROW_EVENTS)).alias("row_events"),
        F.grouping_id().cast("bigint").alias("level"),
    )


# --- raw events and files ---------------------------------------------------


def little_endian(data: Column, start: int, size: int) -> Column:
    """Unsigned whole number from bytes, lowest byte first (start from 0)."""
    hexed = F.hex(F.substring(data, start + 1, size))
    turned = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(turned, 16, 10).try_cast("bigint")


def to_little_endian(value: Column, size: int) -> Column:
    hexed = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size))]))


def decode_events(raw: DataFrame, data: str) -> DataFrame:
    """Header fields of raw log events, and where a rotation leads.

    Short or unknown events keep the kind ``Unknown``.
    """
    b = F.col(data)
    whole = F.length(b) >= HEADER_BYTES
    code = little_endian(b, 4, 1)
    kind = F.lit(None).cast("string")
    for number, label in EVENT_CODES.items():
        kind = F.when(code == number, F.lit(label)).otherwise(kind)
    kind = F.when(whole, F.coalesce(kind, F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN))
    rotate = whole & (code == 4) & (F.length(b) > HEADER_BYTES + 8)
    return raw.select(
        *[c for c in raw.columns if c != data],
        kind.alias("event_type"),
        F.when(whole, little_endian(b, 0, 4)).alias("unix_ts"),
        F.when(whole, little_endian(b, 5, 4)).alias("server_id"),
        F.when(rotate, little_endian(b, HEADER_BYTES, 8)).alias("next_pos"),
        F.when(rotate, F.decode(F.substring(b, F.lit(HEADER_BYTES + 9), F.length(b)), "UTF-8")).alias("next_file"),
    )


def current_file(log: DataFrame, max_inline: int = MAX_INLINE_ROTATIONS,
                 max_group_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """File in force at each event: the one named by the last rotation so far.

    A few rotations become one expression, so the log is not moved. Many are
    carried along the log in range partitions of its position.
    """
    events = with_sequence(log)
    turns = events.where(_kind() == ROTATE).select("seq", "pos", "file")
    rows = sizes.bounded_rows(turns, max_inline)
    if rows is not None:
        name = F.lit(None).cast("string")
        for r in sorted(rows, key=lambda r: (r["seq"], r["pos"])):
            name = F.when(coords.at_or_after(F.col("seq"), F.col("pos"), r["seq"], r["pos"]), r["file"]).otherwise(name)
        return events.withColumn("current_file", name)
    # any other event at the same position comes after the rotation
    tagged = events.withColumn("_rank", F.when(_kind() == ROTATE, 0).otherwise(1))
    seg = skew.segment(tagged, [], ["seq", "pos", "_rank"], max_group_rows)
    seg = skew.last_before(seg, F.when(_kind() == ROTATE, F.col("file")), "current_file", inclusive=True)
    return seg.done("_rank")


def log_files(log: DataFrame) -> DataFrame:
    """Log files with their first and last offset."""
    return with_sequence(log).groupBy("seq", "file").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos")
    )


def locate_events(events: DataFrame, files: DataFrame) -> DataFrame:
    """The log file that holds each position, and its neighbours.

    This is an equality join on file and number; the neighbours come from a
    window over the files of the same base name.
    """
    w = W.partitionBy(F.regexp_extract("file", r"^(.*)\.\d+$", 1)).orderBy("seq")
    around = files.select(
        "seq", F.col("file").alias("in_file"), "start_pos", "end_pos",
        F.lag("file").over(w).alias("previous_file"), F.lead("file").over(w).alias("next_file"),
    )
    small = sizes.bounded_broadcast(around, MAX_LOG_FILES)
    placed = with_sequence(events)
    around = (around if small is None else small).withColumnRenamed("seq", "_seq")
    joined = placed.join(around, (placed.seq == around._seq) & (placed.file == around.in_file), "left").drop("_seq")
    return joined.where(F.col("pos").between(F.col("start_pos"), F.col("end_pos")))


def executed_set(gtids: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Transaction sets as text: highest sequence per domain, comma-joined.

    Texts that are not ``domain:sequence`` with a positive sequence are left out.
    """
    return (
        executed_domains(gtids, column, by)
        .groupBy(*by)
        .agg(
            F.concat_ws(
                ",",
                F.sort_array(F.collect_list(F.concat_ws(":", "domain", F.col("max_seq").cast("string")))),
            ).alias("gtid_set"),
            F.count(F.lit(1)).alias("domains"),
        )
    )


def executed_domains(gtids: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(column)
    return (
        gtids.where(coords.valid_txn(c))
        .groupBy(*by, coords.txn_domain(c).alias("domain"))
        .agg(F.max(coords.txn_sequence(c)).alias("max_seq"))
    )


def pending_events(log: DataFrame, column: str, executed: DataFrame) -> DataFrame:
    """Transactions not covered by a set of (``domain``, ``max_seq``).

    An id that does not parse is not known to be covered, so its row stays,
    with NULL as its domain and sequence.
    """
    c = F.col(column)
    valid = coords.valid_txn(c)
    parsed = log.select(
        "*", F.when(valid, coords.txn_domain(c)).alias("domain"), F.when(valid, coords.txn_sequence(c)).alias("seq")
    )
    small = sizes.bounded_broadcast(executed, MAX_DOMAINS)
    return parsed.join(executed if small is None else small, "domain", "left").where(
        F.col("max_seq").isNull() | (F.col("seq") > F.col("max_seq"))
    ).drop("max_seq")
