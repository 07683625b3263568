"""Repair of conversations: faults as compact signatures, each distinct one solved once, its edits replayed on the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import checkpoint, named, slices

#: Fixed values of the rules: what blank texts are made of, what ends a whole text, what edits cost.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, UNENDED = 1, 2, 5, 5
#: States of a conversation so far: nothing, the system's turn, the user's, the assistant's; whether it may end there,
#: the role that may follow (and the state then) besides the system's at the start.
START, SYSTEM, USER, ASSISTANT = range(4)
MAY_END = (True, False, False, True)
FOLLOWS = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
ROLES = {"u": "user", "a": "assistant"}
#: Rows that a signature's letters gather in one list before these are put together, and recursion's depth.
BLOCK, DEPTH = 4096, 200


# -- faults -----------------------------------------------------------------------------------------------------------


def _columns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = lambda name: F.coalesce(named(turns, name).cast("string"), F.lit(" "))
    return turns.select(named(turns, conv_col).cast("long").alias("conv_id"), named(turns, turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by a digest of conversation and turn, the same at every run.

    Of twenty rows one each is dropped, emptied, loses its sentence ends, comes twice, and becomes the user's. Null roles,
    texts, and numbers in the digest count as one space. Equal rows share their fate. An empty table gives no rows.
    """
    rows = _columns(turns, conv_col, turn_col, role_col, text_col)
    number = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.withColumn("lot", lot).where("lot <> 0").withColumns({"text": text, "role": F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def place(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, turn, role, text, fault, initial, jump, fresh): rows numbered from 1 by turn, with their first fault.

    Order is by turn, null ones first, then by role and text. Faults: ``blank`` (no character but blanks), ``duplicate``
    (role and text seen earlier in the conversation), ``truncated`` (the last character that isn't blank ends no
    sentence), else null. ``jump``: this role may not follow the one before; ``fresh``: the first row of a turn that isn't
    null. Null roles and texts count as one space; rows of null conversations form one. An empty table gives no rows.
    """
    rows = _columns(turns, conv_col, turn_col, role_col, text_col)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    by_turn = Window.partitionBy("conv_id").orderBy(*order)
    initial = F.substring("role", 1, 1)
    before = lambda x: F.lag(x).over(by_turn)
    rows = rows.withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    rows = rows.withColumns({"place": F.row_number().over(by_turn), "pair": F.concat(before("initial"), "initial"), "last_turn": before("turn")})
    # rows of a conversation are together already, so this window needs no other shuffle
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place"))
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", "blank").when(copy > 1, "duplicate").when(~F.substring(stripped, -1, 1).isin(*ENDS), "truncated")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))
    jump = F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))
    return rows.select("conv_id", "place", "turn", "role", "text", fault.alias("fault"), "initial", jump.alias("jump"), fresh.alias("fresh"))


def signatures(placed: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal), one row for each conversation of ``placed``.

    The signature has a letter for each row: x if the row must go, else its role's initial (o for others), upper case if
    the text is truncated. Letters are gathered in blocks first, so that only strings meet. No rows give no rows.
    """
    must_go = F.col("fault").isin("blank", "duplicate")
    letter = F.when(F.coalesce(must_go, F.lit(False)), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    count = lambda what: F.coalesce(F.sum(F.when(what, 1).otherwise(0)), F.lit(0)).cast("long")
    facts = {"blank": count(F.col("fault") == "blank"), "duplicate": count(F.col("fault") == "duplicate"), "truncated": count(F.col("fault") == "truncated"), "illegal": count(F.col("jump"))}
    rows = placed.select("conv_id", F.floor(F.col("place") / BLOCK).alias("block"), "place", letter.alias("letter"), "turn", "fault", "jump", "fresh")
    joined = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
    blocks = rows.groupBy("conv_id", "block").agg(
        joined("place", "letter").alias("letters"), F.min("turn").alias("low"), F.max("turn").alias("high"), count(F.col("fresh")).alias("turns"), *[v.alias(k) for k, v in facts.items()]
    )
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0))
    return blocks.groupBy("conv_id").agg(joined("block", "letters").alias("signature"), gaps.alias("gaps"), *[F.sum(k).alias(k) for k in facts])


# -- solving ----------------------------------------------------------------------------------------------------------


def solve(signature: str) -> tuple[int, str]:
    """The least cost at which a signature becomes a proper conversation, and the initials of the edits, in order.

    K keeps a row, R gives it another role (the one that the place asks for), D deletes it, I inserts a row before it or
    at the end. What is left has to be nothing, or turns of user and assistant in turn, the system's first perhaps. Of equally
    cheap edits those are taken whose initials come first in ASCII. Recursion with a memo goes from each place and state
    to the end; as it starts near the end, it never gets deep.
    """
    n = len(signature)
    memo: list[list[tuple[int, str, int] | None]] = [[None] * 4 for _ in range(n + 1)]

    def best(at: int, state: int) -> tuple[int, str, int]:
        """(cost from here to the end, edits up to and with those of this row, state after them)"""
        if (known := memo[at][state]) is None:
            options, inserted, now = [], 0, state
            while inserted <= 2:  # a third insertion would lead to a state that was there before
                run, paid = "I" * inserted, INSERT * inserted
                if at == n:
                    options += [(paid, run, now)] if MAY_END[now] else []
                else:
                    letter = signature[at]
                    options.append((paid + DELETE + best(at + 1, now)[0], run + "D", now))
                    if letter != "x":
                        paid += UNENDED if letter.isupper() else 0
                        (wanted, then), own = FOLLOWS[now], letter.lower()
                        keep = SYSTEM if now == START and own == "s" else then if own == wanted else None
                        if keep is not None:
                            options.append((paid + best(at + 1, keep)[0], run + "K", keep))
                        options.append((paid + REROLE + best(at + 1, then)[0], run + "R", then))
                inserted, now = inserted + 1, FOLLOWS[now][1]
            known = memo[at][state] = min(options)
        return known

    for at in range(n - n % DEPTH, 0, -DEPTH):
        for state in range(4):
            best(at, state)
    audit, state = [], START
    for at in range(n + 1):
        _, run, state = best(at, state)
        audit.append(run)
    return best(0, START)[0], "".join(audit)


def audits(signed: DataFrame) -> DataFrame:
    """``signed`` with cost and audit of each row's signature; every distinct signature is solved once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [solve(x) for x in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], ["signature", "cost", "audit"])

    distinct = signed.select("signature").distinct()
    return signed.join(distinct.mapInArrow(run, "signature string, cost long, audit string"), "signature")


# -- replaying --------------------------------------------------------------------------------------------------------

#: (conv_id, edit, role, text) of a row that stays or is put in; a conversation ends with a row without an edit.
Row = tuple[int | None, str | None, str, str]


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    """Repaired rows from rows in order, each conversation's audit first; only one row and the audit are held."""
    conv, audit, at, last, ready = None, "", 0, "", False

    def inserted(stop: str) -> Iterator[Row]:
        nonlocal at, last
        while at < len(audit) and audit[at] == stop:
            last = "u" if last != "u" else "a"
            yield conv, "I", ROLES[last], ""
            at += 1

    for batch in slices(batches):
        for conv_id, place_, text, role, edits in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "text", "role", "audit")], strict=True):
            if place_ == 0:
                if ready:
                    yield from inserted("I")
                    yield conv, None, "", ""
                conv, audit, at, last, ready = conv_id, edits, 0, "", True
                continue
            yield from inserted("I")
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES["u" if last != "u" else "a"]
            last = role[:1]
            yield conv, edit, role, text
    if ready:
        yield from inserted("I")
        yield conv, None, "", ""


def _in_order(placed: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows and audits, all of a conversation in one partition and in order, the audit at place 0."""
    none = F.lit(None).cast("string")
    rows = placed.select("conv_id", "place", "text", "role", none.alias("audit"))
    heads = audited.select("conv_id", F.lit(0).alias("place"), none.alias("text"), none.alias("role"), "audit")
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _as_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    flush: Callable[[], pa.RecordBatch] = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kinds[k]) for k in range(len(names))], names)
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield flush()
            held.clear()
    if held:
        yield flush()


def repaired(placed: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the conversations after their edits; ``place`` counts anew from 1.

    ``edit`` is K, R or I. A conversation of which nothing stays has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered() -> Iterator[tuple]:
            at = 0
            for conv, edit, role, text in _replayed(batches):
                at = at + 1 if edit else 0
                if edit:
                    yield conv, at, edit, role, text

        yield from _as_batches(numbered(), ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()])

    return _in_order(placed, audited).mapInArrow(run, "conv_id long, place int, edit string, role string, text string")


def repaired_digests(placed: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each repaired conversation, ``role:text`` of its rows with line feeds between.

    A digest is one sequence of bytes, so a conversation passes through one task; it is read row by row and never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            state, between = hashlib.sha256(), b""
            for conv, edit, role, text in _replayed(batches):
                if edit is None:
                    yield conv, state.hexdigest()
                    state, between = hashlib.sha256(), b""
                    continue
                state.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"

        yield from _as_batches(digests(), ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])

    return _in_order(placed, audited).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    The cheapest edits make each conversation proper: at most one system turn, at the start, then user and assistant in turn,
    ending with the assistant's. Rows that are blank or come twice have to go; a truncated row that stays costs more.
    ``every``: a table whose conversations all get a row, those without a row in ``turns`` too (zeros, no edits).
    ``repaired`` gives the rows themselves.

    Null roles and texts count as one space; a null conversation is one of its own. Rows of one turn come by role and
    text; rows wholly repeated count as duplicates. An empty table gives no rows.
    """
    placed = checkpoint(place(turns, conv_col, turn_col, role_col, text_col))
    audited = checkpoint(audits(signatures(placed)).drop("signature"))
    done = audited.join(repaired_digests(placed, audited).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    if every is None:
        return done
    ids = every.select(named(every, conv_col).cast("long").alias("every")).distinct()
    out = ids.join(done, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    empty = hashlib.sha256(b"").hexdigest()
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
