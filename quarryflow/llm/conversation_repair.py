"""Repair of conversation structure at the least cost.

A conversation's rows are kept (K), given another role (R), deleted (D), and empty turns are
inserted (I), so that the initials of its roles read ``(s?(ua)+)?``.  The edits are a path through
a graph of (row, state of that pattern).  A path's weight is one integer: the high digits are its
cost, the low ones the letters of its edits, one digit of fixed width each, the first letter
highest and zeros after the last.  The least integer is then the cheapest path, and of those the one
whose letters come first in ASCII order; the smallest weight from each node on, from the last row
to the first, is all there is to compute.

Work is spread by conversation.  Rows without their texts (turn, role, digest, faults) come to the
dynamic program in order; of a conversation it holds a digest and three small values a row, not
its rows.  Then the texts pass in the same order and are hashed as they pass.  One conversation is
one row of the result and one hash of all its texts in order, so its rows pass one task, without
being gathered there; the integers grow with the conversation, so its time grows with the square of
its rows (20,000 rows: about 10 seconds).

Defined cases: a null conv_id is a conversation like others; a null turn comes first and counts for
no gap; null role and text are one blank; a role without letters has an empty initial and cannot be
kept; rows alike in turn are taken in order of role and digest, so rows that are alike are
duplicates; texts may be of any length; a conversation of which nothing is left has zeros, an empty
audit and the hash of the empty string; other columns play no part, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialise

_WHITE = "\\x20\\x09-\\x0D"
LETTERS = " DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = range(1, 5)
_COST = {_DELETE: 4, _INSERT: 3, _KEEP: 0, _REROLE: 3}
_UNFINISHED = 3
#: States: nothing yet, after s, after u, after a.  What an initial leads to, and the turn that may be put in.
_STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_PUT = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
_DONE = (0, 3)
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, dropped: rows damaged by crc32 of ``conv_id:turn`` modulo 20."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("r"), known("text").alias("t"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("r")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"))


def least_edits(initials: list[str], lost: bytes, unfinished: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows with these initials; ``lost`` rows must go, ``unfinished`` ones cost more if they stay."""
    n = len(initials)
    # no path that could win costs more than deleting all rows and opening a pair: so many turns at most are put in
    width = n + (4 * n + 6) // 3 + 1
    bits = 3 * width
    low, top = (1 << bits) - 1, bits - 3

    def before(edit: int, rest: int, more: int = 0) -> int:
        return ((rest >> bits) + _COST[edit] + more << bits) + (edit << top) + ((rest & low) >> 3)

    def with_inserts(best: list[int]) -> list[int]:
        once = [before(_INSERT, best[_NEXT[q]]) for q in range(4)]
        twice = [before(_INSERT, once[_NEXT[q]]) for q in range(4)]
        return [min(x) for x in zip(best, once, twice)]

    never = 8 * n + 64 << bits
    best = with_inserts([0 if q in _DONE else never for q in range(4)])
    for i in range(n - 1, -1, -1):
        ways = [[before(_DELETE, best[q])] for q in range(4)]
        if not lost[i]:
            more = _UNFINISHED if unfinished[i] else 0
            for q in range(4):
                to = _STEP[q].get(initials[i])
                if to is not None:
                    ways[q].append(before(_KEEP, best[to], more))
                ways[q].append(before(_REROLE, best[_NEXT[q]], more))
        best = with_inserts([min(w) for w in ways])
    letters = format(best[0] & low, "o").zfill(width).rstrip("0") if best[0] & low else ""
    return best[0] >> bits, letters.translate({ord(str(k)): LETTERS[k] for k in range(1, 5)})


class _Conversation:
    """What is held of the conversation that passes."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initials: list[str] = []
        self.lost, self.unfinished = bytearray(), bytearray()
        self.seen: set = set()

    def add(self, turn, role: str, digest: bytes, blank: bool, unfinished: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        repeated = (role, digest) in self.seen
        self.seen.add((role, digest))
        self.initials.append(initial)
        self.lost.append(blank or repeated)
        self.unfinished.append(not blank and not repeated and unfinished)
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += self.unfinished[-1]

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit = least_edits(self.initials, self.lost, self.unfinished)
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _plan(id_type: pa.DataType):
    kinds = [id_type, *[pa.int64()] * len(_COUNTS), pa.string()]
    names = ["conv_id", *_COUNTS, "audit"]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        at, done = None, []
        for batch in batches:
            for conv_id, turn, role, digest, blank, unfinished, dropped in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "unfinished", "dropped"))):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        done.append(at.result())
                        if len(done) >= 1024:
                            yield packed(done)
                            done = []
                    at = _Conversation(conv_id)
                if not dropped:
                    at.add(turn, role, digest, blank, unfinished)
        if at is not None:
            done.append(at.result())
        if done:
            yield packed(done)

    return run


class _Repaired:
    """Hashes a conversation's repaired turns as its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines = audit, 0, 0, 0
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.lines += 1
        self.hash.update(f"{role}:".encode())
        self.hash.update(text.encode())
        self.state = _STEP[self.state][role[:1]]

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(_PUT[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._line(role, text)
        elif edit == "R":
            self._line(_PUT[self.state], text)


def _hashes(id_type: pa.DataType):
    def run(batches):
        conv_id, at = None, None
        for batch in batches:
            ids, digests = [], []
            for own, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                if audit is not None:  # comes before the rows
                    if at is not None:
                        at.inserts()
                        ids.append(conv_id)
                        digests.append(at.hash.hexdigest())
                    conv_id, at = own, _Repaired(audit)
                else:
                    at.row(role, text)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(digests)], ["conv_id", "repaired_sha256"])
        if at is not None:
            at.inserts()
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], id_type), pa.array([at.hash.hexdigest()])], ["conv_id", "repaired_sha256"])

    return run


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, dropped) of conversations in, one row for each conv_id out: counts of faults, cost, audit and the hash of the repaired turns."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_field = StructField("conv_id", rows.schema["conv_id"].dataType)
    id_type = to_arrow_type(id_field.dataType)
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    order = ["conv_id", "turn", "role", "digest", "copy"]
    light = rows.select(*order, "dropped", (~F.col("text").rlike(f"[^{_WHITE}]")).alias("blank"), F.col("text").rlike(f"[^{_WHITE}.!?][{_WHITE}]*\\z").alias("unfinished"))
    schema = StructType([id_field, *(StructField(c, LongType()) for c in _COUNTS), StructField("audit", StringType())])
    plans = materialise(light.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_plan(id_type), schema), "repairs")
    # audits come before the rows of their conversation
    texts = rows.where("not dropped").select(*order, "text", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    audits = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("text"), "audit", F.lit(0).alias("kind"))
    passing = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order[1:]).select("conv_id", "audit", "role", "text")
    hashes = passing.mapInArrow(_hashes(id_type), StructType([id_field, StructField("repaired_sha256", StringType())]))
    hashes = hashes.withColumnRenamed("conv_id", "_id")
    return plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
