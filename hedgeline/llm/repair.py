"""Repair of conversations by signature deduplication.

What a cheapest repair looks like depends on no text: only on the order of
roles, on which rows have to go and on which are cut short. So the rows of a
conversation become a signature, a letter for each row. Most conversations
share theirs with others; each distinct signature is solved once, by memoised
recursion over its suffixes, and the edits that come out (the audit, a letter
for each) are joined back and replayed on the rows.

Signatures: `s`, `u`, `a` are rows of a system, user or assistant, `o` of any
other role; capitals are cut short; `x` has to go, as it is blank or repeated.
Audits: K keeps a row, R gives it the role that the place needs, D deletes it,
I inserts an empty row. What roles may follow each other is (s?(ua)+)?, so the
role of an R or I follows from the edits before.

A conversation's rows pass through one task in their order and are never held
together; what is held is a letter for each row. Spark sorts them, on disk if
need be.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a kept row leads to.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that an inserted row or one with a new role leads to, and that role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
WHOLE = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: More inserted rows than these in a row lead back to a state that was there before.
INSERTS = 2
NEVER = 1 << 30
#: Rows of a signature that one descent of the recursion takes in.
STEP = 50


class Signature:
    """The cheapest edits of a signature: the cost from each place and state, computed once."""

    def __init__(self, letters: str):
        self.letters = letters
        places = len(letters) + 1
        self.costs, self.edits = array("i", [-1]) * (places * 4 * (INSERTS + 1)), bytearray(places * 4 * (INSERTS + 1))
        for place in [*range(len(letters), 0, -STEP), 0]:  # from the end, so that no descent is deep
            for state in range(4):
                self.cost(place, state)

    def cost(self, place: int, state: int, inserted: int = 0) -> int:
        """The least cost of what follows, and the ASCII-least edit that reaches it."""
        at = (place * 4 + state) * (INSERTS + 1) + inserted
        if self.costs[at] < 0:
            best = (0, 0) if place == len(self.letters) and state in WHOLE else (NEVER, 0)
            for edit, paid, *after in self.choices(place, state, inserted):
                best = min(best, (min(NEVER, paid + self.cost(*after)), ord(edit)))
            self.costs[at], self.edits[at] = best
        return self.costs[at]

    def choices(self, place: int, state: int, inserted: int) -> Iterator[tuple]:
        if place < len(self.letters):
            letter = self.letters[place]
            yield "D", DELETE, place + 1, state, 0
            if letter != "x":
                cut = CUT if letter.isupper() else 0
                yield "R", REROLE + cut, place + 1, NEXT[state], 0
                if (state, letter.lower()) in KEPT:
                    yield "K", cut, place + 1, KEPT[state, letter.lower()], 0
        if inserted < INSERTS:
            yield "I", INSERT, place, NEXT[state], inserted + 1

    def audit(self) -> str:
        out, place, state, inserted = bytearray(), 0, START, 0
        while edit := self.edits[(place * 4 + state) * (INSERTS + 1) + inserted]:
            out.append(edit)
            place, state, inserted = next(after for name, _, *after in self.choices(place, state, inserted) if ord(name) == edit)
        return out.decode()


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with fault: blank, duplicate, truncated or null, the first that holds.

    blank: no character but ASCII white space; duplicate: role and text were there before in the conversation;
    truncated: the last such character ends no sentence. Rows of one turn stand in the order of role and text.
    """
    whole = F.btrim("text", F.lit(SPACE))
    again = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    fault = F.when(whole == "", "blank").when(again, "duplicate").when(~F.right(whole, F.lit(1)).isin(*ENDS), "truncated")
    # hashed by conversation, which is all that the window and the sort behind it ask for: one shuffle
    return rows.repartition("conv_id").withColumn("fault", fault)


def letter(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(own)).otherwise(own)


SIGNED = "conv_id bigint, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as a row for each conversation; what is carried from row to row is a few numbers and the letters."""
    known, conv, out = False, None, []

    def close() -> tuple:
        gaps = turns[-1] - turns[0] + 1 - distinct if turns else 0
        return conv, letters.decode(), gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal

    def packed() -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[part.split()[0] for part in SIGNED.split(", ")])

    for batch in batches:
        for conv_id, turn, initial, fault, mark in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "letter")), strict=True):
            if not known or conv_id != conv:
                if known:
                    out.append(close())
                known, conv, letters, turns, distinct, illegal, before = True, conv_id, bytearray(), [], 0, 0, None
                counts = {"blank": 0, "duplicate": 0, "truncated": 0}
            letters += mark.encode()
            if fault:
                counts[fault] += 1
            if turn is not None and (not turns or turn != turns[-1]):
                distinct, turns = distinct + 1, [turns[0] if turns else turn, turn]
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
        if out:
            yield packed()
            out = []
    if known:
        out.append(close())
        yield packed()


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(s, Signature(s)) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([x.audit() for _, x in found], pa.string()), pa.array([x.cost(0, START) for _, x in found], pa.int64())], names=["signature", "audit", "cost"])


def clean(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; a null role or text is one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), filled("role"), filled("text"))


def audits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each conversation what is wrong with it, its signature, the cheapest audit and its cost."""
    marked = faults(clean(rows)).sortWithinPartitions("conv_id", "turn", "role", "text")
    columns = marked.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", letter(F.col("role"), F.col("fault")).alias("letter"))
    found = scratch.keep(columns.mapInArrow(signed, SIGNED), "signed")
    solutions = found.select("signature").distinct().mapInArrow(solved, "signature string, audit string, cost bigint")
    return scratch.keep(found.join(solutions, "signature"), "audits")


REPAIRED = "conv_id bigint, place bigint, edit string, role string, text string"


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit and then the rows of its conversation, again and again, as the rows that stay or come in."""
    state, place, edits, ahead = START, 0, iter(()), None
    for batch in batches:
        out = []
        for conv_id, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if audit is not None:
                state, place, edits = START, 0, iter(audit)
            elif ahead != "D":
                state, place = KEPT[state, role[0]] if ahead == "K" else NEXT[state], place + 1
                out.append((conv_id, place, ahead, role if ahead == "K" else ROLES[state], text))
            ahead = next(edits, None)
            while ahead == "I":
                state, place = NEXT[state], place + 1
                out.append((conv_id, place, ahead, ROLES[state], ""))
                ahead = next(edits, None)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["conv_id", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of all conversations after their audits (found): conv_id, place from 1, edit (K, R or I), role and text.

    A conversation's rows are in one partition and in their order.
    """
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = found.select("conv_id", F.lit(0).alias("kind"), empty("turn", "bigint"), empty("role", "string"), empty("text", "string"), "audit")
    both = heads.union(clean(rows).select("conv_id", F.lit(1), "turn", "role", "text", empty("audit", "string")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").select("conv_id", "audit", "role", "text").mapInArrow(replayed, REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows by crc32 of conv_id:turn modulo 20: 0 drops one, 1 empties its text, 2 takes out what ends sentences, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    filled = clean(rows)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return filled.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each conversation's rows, which come one after the other."""
    known, conv, digest, out = False, None, hashlib.sha256(), []
    packed = lambda: pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"])
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if known and conv_id == conv:
                digest.update(b"\n")
            else:
                if known:
                    out.append((conv, digest.hexdigest()))
                known, conv, digest = True, conv_id, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        if out:
            yield packed()
            out = []
    if known:
        out.append((conv, digest.hexdigest()))
        yield packed()


def digests(conversations: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each conv_id of conversations what was wrong with its rows, the audit, its cost and repaired_sha256 (role:text, joined by line feeds).

    Rows without a conv_id are one conversation. Without a turn a row stands
    first and takes no part in gaps, the turns that are missing between the
    smallest and the largest. Rows of one turn stand in the order of role and
    text; repeated rows are duplicates. Columns other than conv_id, turn, role
    and text take no part. A conversation without rows has zeros, no edits and
    the digest of nothing; an empty table gives no rows.
    """
    found = audits(rows, scratch)
    hashes = repaired(rows, found).mapInArrow(hashed, "conv_id bigint, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().alias("i")
    joined = ids.join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").join(hashes.alias("h"), F.col("i.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    numbers = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return joined.select("i.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", nothing).alias("repaired_sha256"))
