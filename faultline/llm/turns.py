"""Repair of a conversation's turn structure: a forward Viterbi search over the four states of the role grammar s?(ua)+."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, schema_with

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: By role initial: the state it leads to, and those it may follow.
STEPS = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
#: Turns that the grammar lets an edit put after each state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL_PAIRS = ("su", "ua", "au")
LETTERS = "KRD"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def filled(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fl_copies (1); null role or text is one space."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", blank("role"), blank("text"), F.lit(1).cast("long").alias("fl_copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """filled() with one turn in five damaged, by crc32 of `conv_id:turn`: dropped (fl_copies 0, without role and text), text
    emptied, its sentence ends removed, said twice, or given to the user.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    d = filled(rows).withColumn("fl_hit", hit)
    text = F.when(F.col("fl_hit") == 1, "").when(F.col("fl_hit") == 2, F.translate("text", ".!?", "")).when(F.col("fl_hit") > 0, F.col("text"))
    role = F.when(F.col("fl_hit") == 4, "user").when(F.col("fl_hit") > 0, F.col("role"))
    copies = F.when(F.col("fl_hit") == 0, 0).when(F.col("fl_hit") == 3, 2).otherwise(1).cast("long")
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("fl_copies"))


def _last_letter(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def _streams(rows: DataFrame) -> DataFrame:
    """rows, a conversation's in one partition and in order: turn (nulls first), role, text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows of filled() or damaged(): fl_copies adds theirs up, fl_blank, fl_cut (truncated) and fl_new (an
    earlier turn doesn't have its role and text). Copies are added up before they are shuffled.
    """
    g = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("fl_copies").alias("fl_copies"))
    # 256 bits stand for role and text, so the join that looks for earlier turns moves no text twice
    g = g.withColumn("fl_said", F.when(F.col("fl_copies") > 0, F.sha2(F.to_json(F.struct("role", "text")), 256)))
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = g.where("fl_copies > 0").groupBy(F.col("conv_id").alias("fl_conv"), F.col("fl_said").alias("fl_same")).agg(F.min(at).alias("fl_first"))
    d = g.join(first, F.col("conv_id").eqNullSafe(F.col("fl_conv")) & (F.col("fl_said") == F.col("fl_same")), "left")
    last = _last_letter(F.col("text"))
    return d.select(
        "conv_id", "turn", "role", "text", "fl_copies",
        F.coalesce(last == "", F.lit(False)).alias("fl_blank"), F.coalesce(~last.isin(".", "!", "?"), F.lit(False)).alias("fl_cut"),
        F.col("turn").eqNullSafe(F.col("fl_first.turn")).alias("fl_new"),
    )


class Path:
    """The cheapest edits that lead to a state: cost, rank of the audit up to the last row among the layer's (`core`), inserts
    since, the state before them, and the running digest of the repaired text.
    """

    __slots__ = ("cost", "core", "inserts", "origin", "digest")

    def __init__(self, cost, core, inserts, origin, digest):
        self.cost, self.core, self.inserts, self.origin, self.digest = cost, core, inserts, origin, digest

    def key(self):
        return self.cost, self.core, self.inserts


def _said(digest, state: int, role: str, text: str):
    digest = digest.copy()
    digest.update(("" if state == START else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
    return digest


class Repair:
    """The search over one conversation, a row at a time. Of a row it keeps four bytes, whatever its text.

    At a row every path has as many letters other than I, so no audit up to its last such letter begins another one, and equal audits
    cost the same: ranks of a layer's audits decide ties as the whole strings would.
    """

    def __init__(self):
        self.back: list[bytearray] = [bytearray() for _ in range(4)]
        self.layer = self._closed({START: Path(0, 0, 0, START, hashlib.sha256())})
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.least, self.most, self.turn, self.initial = 0, None, None, None, None

    def _closed(self, layer: dict[int, Path]) -> dict[int, Path]:
        """The layer with the states that one or two inserted turns reach; a third would only come back."""
        for _ in range(2):
            for state, p in list(layer.items()):
                to = NEXT[state]
                if p.inserts < 2 and (to not in layer or (p.cost + INSERT, p.core, p.inserts + 1) < layer[to].key()):
                    layer[to] = Path(p.cost + INSERT, p.core, p.inserts + 1, p.origin, _said(p.digest, state, ROLES[to], ""))
        return layer

    def row(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        best: dict[int, tuple] = {}

        def offer(to: int, state: int, p: Path, price: int, letter: str) -> None:
            # (cost, rank of the audit so far, what follows it), then how to get there
            new = (p.cost + price, p.core, "I" * p.inserts + letter)
            if to not in best or new < best[to][:3]:
                best[to] = (*new, state, letter)

        for state, p in self.layer.items():
            offer(state, state, p, DELETE, "D")
            if must_go:
                continue
            to, after = STEPS.get(role[:1], (None, ()))
            if state in after:
                offer(to, state, p, KEEP + CUT * cut, "K")
            offer(NEXT[state], state, p, REROLE + CUT * cut, "R")
        ranks = {audit: k for k, audit in enumerate(sorted({b[1:3] for b in best.values()}))}
        layer = {}
        for to, (cost, core, more, state, letter) in best.items():
            p = self.layer[state]
            self.back[to].append(p.origin | p.inserts << 2 | LETTERS.index(letter) << 4)
            digest = p.digest if letter == "D" else _said(p.digest, state, role if letter == "K" else ROLES[to], text)
            layer[to] = Path(cost, ranks[core, more], 0, to, digest)
        for to in set(range(4)) - set(best):
            self.back[to].append(0)
        self.layer = self._closed(layer)

    def add(self, turn, role: str, text: str, copies: int, blank: bool, cut: bool, new: bool) -> None:
        if copies and turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        for k in range(copies):
            fault = "blank" if blank else "duplicate" if k or not new else "truncated" if cut else None
            if fault:
                self.counts[fault] += 1
            if self.initial is not None:
                self.counts["illegal"] += self.initial + role[:1] not in LEGAL_PAIRS
            self.initial = role[:1]
            self.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> dict:
        p = min((self.layer[s] for s in (START, ASSISTANT) if s in self.layer), key=Path.key)
        parts, state, inserts = [], p.origin, p.inserts
        for k in range(len(self.back[0]) - 1, -1, -1):
            step = self.back[state][k]
            parts += ["I" * inserts, LETTERS[step >> 4]]
            state, inserts = step & 3, step >> 2 & 3
        audit = "".join(reversed([*parts, "I" * inserts]))
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": p.cost, "audit": audit, "repaired_sha256": p.digest.hexdigest()}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict] | None]]:
    """(conv_id, row) of each row, and (conv_id, None) behind a conversation's last."""
    conv, some = None, False
    for batch in batches:
        for row in batch.to_pylist():
            if some and row["conv_id"] != conv:
                yield conv, None
            conv, some = row["conv_id"], True
            yield conv, row
    if some:
        yield conv, None


def _repairs(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out, size, search = [], 0, Repair()
    schema = pa.schema([("conv_id", kind), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for conv, row in _groups(batches):
        if row is not None:
            search.add(row["turn"], row["role"], row["text"], row["fl_copies"], row["fl_blank"], row["fl_cut"], row["fl_new"])
            continue
        out.append({"conv_id": conv} | search.result())
        size, search = size + 200 + len(out[-1]["audit"]), Repair()
        if size > 1 << 22:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of filled() or damaged() rows: gaps in its turns; blank, duplicate and truncated turns, each by
    its first fault; illegal pairs of neighbours; and the cost, audit and digest of its cheapest repair.

    The repair keeps (0), reroles (2), deletes (3) or inserts (2) turns until the roles read (s?(ua)+)?; blank and duplicate turns
    have to go, a truncated turn that stays costs 1. Of equally cheap repairs the one with the least audit counts. Turns of
    a conversation go by turn (null first), role, text. Null role or text is one space, null conv_id a conversation of its own;
    roles other than s…, u…, a… can't be kept; equal rows are duplicates; a conversation without rows left has zeros and the digest of an
    empty text. Other columns don't matter. No rows: no rows.

    A conversation's rows pass in order through one task, since its digest can't be put together from parts. They stream: Spark sorts
    and spills them, and the search holds four bytes a row.
    """
    return _streams(with_faults(rows)).mapInArrow(partial(_repairs, kind=_arrow(rows)), schema_with(rows.select("conv_id").schema, RESULT))


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def _rewritten(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The repaired turns of conversations whose first row holds the audit."""
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    out, size, audit, at, place, last = [], 0, "", 0, 0, ""

    def put(role: str, text: str, edit: str) -> None:
        nonlocal place, last, size
        out.append({"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit})
        place, last, size = place + 1, role[:1], size + 100 + len(text)

    def inserted() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put("assistant" if last == "u" else "user", "", "insert")
            at += 1

    for conv, row in _groups(batches):
        if row is None:
            continue
        if row["fl_audit"] is not None:
            audit, at, place, last = row["fl_audit"], 0, 0, ""
            inserted()
            continue
        for _ in range(row["fl_copies"]):
            letter, at = audit[at], at + 1
            if letter != "D":
                put(row["role"] if letter == "K" else "assistant" if last == "u" else "user", row["text"], "keep" if letter == "K" else "rerole")
            inserted()
        if size > 1 << 22:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit (keep, rerole, insert): the repaired conversations of filled() or damaged() rows, by
    repaired() of the same rows. A conversation's audit goes ahead of its turns in their stream.
    """
    d = rows.where("fl_copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("fl_copies").alias("fl_copies")).withColumn("fl_audit", F.lit(None).cast("string"))
    heads = repairs.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("fl_copies"), F.col("audit").alias("fl_audit"))
    both = d.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("fl_audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    return both.mapInArrow(partial(_rewritten, kind=_arrow(rows)), schema_with(rows.select("conv_id").schema, "place long, role string, text string, edit string"))
