"""Conversation structure repair by a shortest path over scalar big-integer weights.

A conversation should read ``(s?(ua)+)?`` in the first letters of its roles: an
optional system turn, then user and assistant in turn, or nothing at all. Every
row is kept, given the other speaker, or deleted, and empty turns may be
inserted; the cheapest sequence of edits wins, and among equally cheap ones the
sequence of edit letters that sorts first.

*Weights.* The weight of a path is one integer: its cost in the high digits, and
below them the letters of its edits as octal digits (``D I K R`` are 1 to 4) at
fixed places, the first letter highest, zeros behind the last. So the order of
integers is the order of (cost, letters), a shorter sequence before its longer
continuations, and plain ``min`` and ``+`` over the edges of a DAG decide
everything; nothing is traced back, since the letters are read off the result.
Nodes are (row, state, inserts so far): paths that meet there have equally many
letters, so whatever follows adds the same to both.

*Inserts.* If an insert costs more than two deletions, no cheapest repair holds
one: leave out the inserted turn and its partner of the same ``ua`` (deleting
the partner's row if it has one, and the system row if no ``ua`` is left), which
saves ``insert`` and adds at most ``2 * delete``. The DAG then has no such edges.
With other costs it has, up to ``delete * n / insert`` of them, as deleting
every row is always possible.

*Long conversations.* Positions come from a range-partitioned sort of narrow rows
(digests, not texts). A conversation is cut into segments of ``SEGMENT`` rows;
each gives the cheapest path between every two states (the same integers), and
a conversation folds these. Texts move once, with the edits of their conversation
as a leading row, and are streamed row by row. What cannot be cut is what is one
value by definition: the letters and the SHA-256 of one conversation; the latter
is streamed in one task with constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import map_batches, schema_with, store
from tessera.operators.ranking import group_positions, join_groups

#: Rows of a conversation that one path table covers.
SEGMENT = 2048

#: Edit letters in ASCII order (octal digits 1 to 4), and the adjacent role letters that are legal.
LETTERS = "DIKR"
LEGAL = ("su", "ua", "au")

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state: the role letter taken, and the state it leads to.
FOLLOWS = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: A row's code: its role letter (any other is ``x``) and its fault.
ROLES, FAULTS = "suax", "-bdt"


@dataclass(frozen=True)
class Costs:
    """What the edits cost (whole numbers; ``truncated`` is added to an undeleted truncated row)."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self) -> None:
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert < 1:
            raise ValueError("costs are not negative, and an insert costs at least 1")

    def inserts(self, rows: int) -> int:
        """Most inserts that a cheapest repair of so many rows can hold."""
        return 0 if self.insert > 2 * self.delete else self.delete * rows // self.insert


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text`` after seeded damage by crc32 of ``conv:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it a user turn.

    Nulls in the key, role and text are one space; ids and turns stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def step(table: dict, code: str, place: dict[int, int], unit: int, costs: Costs) -> dict:
    """Weights after one row: ``(state, inserts) -> integer``. ``place[inserts]`` is the
    digit place of the row's letter (an exponent of 2), ``unit`` that of the costs."""
    role, fault = code
    out: dict = {}

    def offer(node: tuple[int, int], weight: int) -> None:
        if node not in out or weight < out[node]:
            out[node] = weight

    more = costs.truncated if fault == "t" else 0
    for (state, j), weight in table.items():
        at = place[j]
        offer((state, j), weight + (costs.delete << unit) + (1 << at))
        if fault in "bd":
            continue
        for letter, to in FOLLOWS[state].items():
            if role == letter:
                offer((to, j), weight + (more << unit) + (3 << at))
            if letter != "s":
                offer((to, j), weight + (costs.rerole + more << unit) + (4 << at))
    return out


def inserted(table: dict, place: dict[int, int], unit: int, most: int, costs: Costs) -> dict:
    """Weights after any number of inserts before the next row (``place`` as in :func:`step`)."""
    out = dict(table)
    for j in range(most):
        for state in range(4):
            if (state, j) in out:
                for letter, to in FOLLOWS[state].items():
                    weight = out[state, j] + (costs.insert << unit) + (2 << place[j])
                    if letter != "s" and weight < out.get((to, j + 1), weight + 1):
                        out[to, j + 1] = weight
    return out


def paths(codes: list[str], start: int, most: int, costs: Costs) -> dict:
    """``(state, inserts) -> (cost, letters as an integer)`` from ``start`` over all rows."""
    width = len(codes) + most
    unit = 3 * width
    table = {(start, 0): 0}
    for i, code in enumerate(codes):
        place = {j: 3 * (width - 1 - i - j) for j in range(most + 1)}
        if most:
            table = inserted(table, place, unit, most, costs)
        table = step(table, code, place, unit, costs)
    # letters of a node: as many as rows and inserts, zeros behind them
    return {(s, j): (w >> unit, (w & ((1 << unit) - 1)) >> 3 * (most - j)) for (s, j), w in table.items()}


def fold(segments: list[tuple[int, dict[int, dict]]], most: int, costs: Costs) -> tuple[int, str]:
    """Cost and letters of the cheapest repair from the path tables of all segments
    (``rows, start -> paths``), by the same integers over the whole width."""
    width = sum(n for n, _ in segments) + most
    unit, done = 3 * width, 0
    table = {(EMPTY, 0): 0}
    for n, tables in segments:
        out: dict = {}
        for (state, j), weight in table.items():
            for (to, k), (cost, letters) in tables[state].items():
                if j + k <= most:
                    total = weight + (cost << unit) + (letters << 3 * (width - done - j - n - k))
                    if total < out.get((to, j + k), total + 1):
                        out[to, j + k] = total
        table, done = out, done + n
    if most:
        table = inserted(table, {j: 3 * (width - 1 - done - j) for j in range(most + 1)}, unit, most, costs)
    best = min(w for (state, _), w in table.items() if state in (EMPTY, ASSISTANT))
    octal = format(best & ((1 << unit) - 1), "o").zfill(width) if width else ""
    return best >> unit, octal.rstrip("0").translate(str.maketrans("1234", LETTERS))


def cheapest(codes: list[str], costs: Costs = Costs(), segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of one conversation of row codes."""
    most = costs.inserts(len(codes))
    cut = [codes[i : i + segment] for i in range(0, len(codes), segment)]
    return fold([(len(c), {s: paths(c, s, most, costs) for s in (range(4) if i else [EMPTY])}) for i, c in enumerate(cut)], most, costs)


def _codes(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(0, len(text), 2)]


def _is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))


def narrow_rows(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, digest, blank, open``: what order and faults need of a row, without its text."""
    tail = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return turns.select("conv", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), _is_blank(F.col("text")).alias("blank"), (~tail.isin(".", "!", "?")).alias("open"))


def ordered_codes(turns: DataFrame) -> DataFrame:
    """``conv, pos, group_size, turn, code`` of every row in its conversation's order: by
    turn (nulls first), then role and text digest."""
    rows = store(group_positions(narrow_rows(turns), ["conv"], [F.col("turn").asc_nulls_first(), "role", "digest"]), "turns-in-order")
    # rows whose role and text come more than once, with the first place; most of them have one
    twice = rows.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = join_groups(rows, twice, ["conv", "role", "digest"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("first"), "d").when(F.col("open"), "t").otherwise("-")
    letter = F.substring("role", 1, 1)
    return marked.select("conv", "turn", "pos", "group_size", F.concat(F.when(letter.isin("s", "u", "a"), letter).otherwise("x"), fault).alias("code"))


def find_repairs(turns: DataFrame, costs: Costs = Costs(), segment: int = SEGMENT) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation of
    ``turns(conv, turn, role, text)``.

    A row's first fault counts: ``blank`` (nothing but white space), ``duplicate``
    (role and text stand earlier), ``truncated`` (the last visible character is none of
    ``.!?``). ``illegal`` counts neighbours whose role letters are not ``su``, ``ua`` or
    ``au``; ``gaps`` are the turn numbers missing between the least and the greatest.
    ``audit`` holds the letters of the cheapest repair's edits in order.

    Null ids make one conversation; rows without a turn come first; ties in
    turn go by role, then by the SHA-256 of the text; equal rows are
    interchangeable. Roles and texts must not be null (a null counts as blank text
    and a foreign role). Other columns are ignored; an empty table gives none.
    """
    turns = turns.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    codes = store(ordered_codes(turns), "turn-codes")
    cut = codes.groupBy("conv", "group_size", F.floor(F.col("pos") / segment).alias("seg")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"]), "").alias("codes")  # at most ``segment`` rows
    )

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seg, size, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, most = _codes(text), costs.inserts(size)
                starts = range(4) if seg else [EMPTY]
                out.append([{"start": s, "state": to, "j": j, "cost": c, "letters": format(x, "o")} for s in starts for (to, j), (c, x) in paths(own, s, most, costs).items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])))], names=["id", "seg", "size", "codes", "paths"])

    kind = turns.schema["conv"].dataType
    rest = "seg long, size long, codes string"
    found = map_batches(cut.select(F.col("conv").alias("id"), "seg", F.col("group_size").alias("size"), "codes"), tables, schema_with(kind, f"{rest}, paths array<struct<start:int,state:int,j:int,cost:bigint,letters:string>>"))
    whole = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg", "size", "codes", "paths"))).alias("segments"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for segments in batch.column(1).to_pylist():
                most = costs.inserts(segments[0]["size"])
                parts = []
                for s in segments:
                    by: dict[int, dict] = {}
                    for p in s["paths"]:
                        by.setdefault(p["start"], {})[p["state"], p["j"]] = (p["cost"], int(p["letters"], 8))
                    parts.append((len(s["codes"]) // 2, by))
                text = "".join(s["codes"] for s in segments)
                roles, faults = text[::2], text[1::2]
                cost, audit = fold(parts, most, costs)
                out.append([*(faults.count(f) for f in FAULTS[1:]), sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False)), cost, audit])
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string())], names=["id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    repairs = map_batches(whole, folded, schema_with(kind, "blank long, duplicate long, truncated long, illegal long, cost long, audit string")).withColumnRenamed("id", "conv")
    wide = F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1 - F.col("n")  # turns may lie further apart than a long tells
    spread = codes.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
    gaps = spread.select("conv", F.when(F.col("hi").isNull(), 0).otherwise(F.least(wide, F.lit((1 << 63) - 1)).cast("long")).alias("gaps"))
    return join_groups(repairs, gaps, ["conv"]).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def apply_repairs(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired rows: ``conv, edit, role, text``, deleted ones left out, inserted ones with an
    empty text. Rows of a conversation are in one partition and in order.

    Texts are shuffled once; a conversation's letters lead its rows, and a task
    holds the letters of one conversation and one batch of rows.
    """
    none = F.lit(None).cast("string")
    body = turns.select("conv", F.lit(1).alias("kind"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    body = body.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    lead = repairs.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), none.alias("role"), F.col("audit").alias("text"), none.alias("digest"))
    both = lead.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, before = "", 0, ""

        def follow(keep: str | None) -> str:
            """The role that stands next: a kept one as it is, else user or assistant."""
            nonlocal before
            role = keep if keep is not None else ("assistant" if before == "u" else "user")
            before = role[:1]
            return role

        for batch in batches:
            pick, edits, roles, texts = [], [], [], []

            def inserts(i: int) -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    pick.append(i)
                    edits.append("I")
                    roles.append(follow(None))
                    texts.append("")
                    at += 1

            for i, (kind, role, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if kind == 0:
                    audit, at, before = text, 0, ""
                    inserts(i)
                    continue
                edit = audit[at]
                at += 1
                if edit != "D":
                    pick.append(i)
                    edits.append(edit)
                    roles.append(follow(role if edit == "K" else None))
                    texts.append(text)
                inserts(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick, pa.int64())), pa.array(edits, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["id", "edit", "role", "text"])

    return map_batches(both.select("conv", "kind", "role", "text"), run, schema_with(turns.schema["conv"].dataType, "edit string, role string, text string")).withColumnRenamed("id", "conv")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of the rows of :func:`apply_repairs`: their ``role:text``,
    joined by newlines, hashed as they stream by. Conversations without a row left are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, kind = None, None, None

        def row(ids: list, sums: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], names=["id", "repaired_sha256"])

        for batch in batches:
            kind = batch.column(0).type
            ids, sums = [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                line = f"{role}:{text}".encode()
                if own is None or conv != key:
                    if own is not None:
                        ids.append(key)
                        sums.append(own.hexdigest())
                    own, key = hashlib.sha256(line), conv
                else:
                    own.update(b"\n" + line)
            yield row(ids, sums)
        if own is not None:
            yield row([key], [own.hexdigest()])

    return map_batches(repaired.select("conv", "role", "text"), run, schema_with(repaired.schema["conv"].dataType, "repaired_sha256 string")).withColumnRenamed("id", "conv")


def repair(turns: DataFrame, costs: Costs = Costs(), segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """``(repairs, repaired)``: :func:`find_repairs` and :func:`apply_repairs` of ``turns(conv, turn, role, text)``."""
    repairs = store(find_repairs(turns, costs, segment), "repairs")
    return repairs, apply_repairs(turns, repairs)
