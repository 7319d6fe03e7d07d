"""Conversation structure repair (12): Wagner-Fischer alignment of turns to the alternating grammar ``(s?(ua)+)?``.

Faults, the first of which counts per turn: blank, duplicate (role and text seen earlier in the conversation),
truncated (does not end in one of ``.!?``). Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (a must for blank and
duplicate turns), Insert an empty user or assistant turn 3; a truncated turn that is not deleted costs 3 more. The cheapest
edits win, of equally cheap ones the audit (the edits' initials in order) that is least in ASCII.

Method. Turns that must go are set aside: their D stands right behind the turn before them, since D is less than I. The
others are aligned to the alternating string by Wagner and Fischer's table. The targets of all feasible lengths that end
alike are suffixes of one string, so one table (turns left x symbols left) holds all of them, and its first row all
their distances. A greedy repair (no insertion or one at the front) is the incumbent: its cost bounds how many deletions and insertions
can pay, and only that band of the table (Ukkonen) is computed. Every length at the least cost is traced from the front, taking the least
letter that stays cheapest, and the audits are compared.

Scale. A conversation may hold a third of all rows. Equal rows of a turn are one row with a count. Rows are range-partitioned and
numbered by (conversation, turn, role, text hash), and cut into blocks of BLOCK rows; a conversation inside a block is repaired there. Of
one that reaches over a block's edge every piece is aligned alone, for each symbol that may have come last before it and
each that may come last in it. No piece ends with an insertion (that is the next piece's), so no audit of a piece is the
beginning of another of its audits, and audits of whole conversations compare as their pieces do. Two passes over
the pieces' costs, from the last to the first and back, hold four numbers at a time and choose each piece's audit.

Texts are shuffled once, to be put together in order: the hash of a whole conversation is made in one task, row by row.
Null roles and texts count as one space, null turns come first and are no number, a null id is a conversation of its own. Rows of
equal turn stand in the order of role, then of a hash of the text; a role's initial is its first character, and
any other than s, u and a has to go or be changed, as has an s behind the beginning. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from srcgraph.session import materialize

from .common import hash_pair, strip

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
BLOCK_BITS = 7  # blocks of 128 rows
STATES = "0sua"  # what came last: nothing, system, user, assistant
AT_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # what makes a conversation whole behind its last row, per state
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
_INF = 1 << 60


@dataclass
class Piece:
    """Turns to be aligned: initials, whether cut short, and how many that must go stand before the first and behind each."""
    initials: list[str] = field(default_factory=list)
    short: list[bool] = field(default_factory=list)
    gone: list[int] = field(default_factory=lambda: [0])

    def add(self, initial: str, short: bool, forced: bool, copies: int) -> None:
        if forced:
            self.gone[-1] += copies
        else:
            self.initials.append(initial)
            self.short.append(short)
            self.gone.append(copies - 1)


class Alignment:
    """The cheapest edits of a piece per state before it and after it, as (cost, audit)."""

    def __init__(self, p: Piece, states: str = STATES):
        self.p, self.n, self.states = p, len(p.initials), states
        # what is paid in any case: a turn that must go is deleted, a truncated one costs 3 or is deleted for 4
        self.fixed = DELETE * sum(p.gone) + CUT_SHORT * sum(p.short)
        self.delete = [DELETE - CUT_SHORT if s else DELETE for s in p.short]
        self.least_delete = min(self.delete, default=DELETE)
        self.all_deleted = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            self.all_deleted[i] = self.all_deleted[i + 1] + self.delete[i]

    def _greedy(self, symbol: str) -> int:
        """Keep or rerole every turn, beginning with ``symbol``."""
        other = "a" if symbol == "u" else "u"
        return REROLE * sum(c != (other if i & 1 else symbol) for i, c in enumerate(self.p.initials))

    def _incumbent(self, first: str, last: str) -> int:
        fits = (self.n & 1) == (first == last)
        return self._greedy(first) if fits else INSERT + self._greedy("a" if first == "u" else "u")

    def _table(self, last: str, limit: int) -> list[tuple[int, list[int]]]:
        """Row i: (lowest k of the band, costs): the least cost of aligning turns i.. to the k last symbols of a string that ends in ``last``."""
        other = "a" if last == "u" else "u"
        below, above = limit // self.least_delete, limit // INSERT
        low, row = 0, [0] + [_INF] * above
        out = [(low, row)]
        for i in range(self.n - 1, -1, -1):
            left, cost, initial = self.n - i, self.delete[i], self.p.initials[i]
            begin, new, before = max(0, left - below), [], _INF
            for k in range(begin, left + above + 1):
                j = k - low
                best = row[j] + cost if 0 <= j < len(row) else _INF
                if k:
                    if 0 < j <= len(row):
                        x = row[j - 1] + (KEEP if initial == (last if k & 1 else other) else REROLE)
                        if x < best:
                            best = x
                    if before + INSERT < best:
                        best = before + INSERT
                new.append(best)
                before = best
            low, row = begin, new
            out.append((low, row))
        return out[::-1]

    @staticmethod
    def _at(table: list[tuple[int, list[int]]], i: int, k: int) -> int:
        low, row = table[i]
        return row[k - low] if low <= k < low + len(row) else _INF

    def _trace(self, table, last: str, i: int, k: int) -> str:
        """The least audit of the cheapest edits from turn i on with k symbols left, with the turns that had to go behind turn i."""
        other, out, at = "a" if last == "u" else "u", [], self._at
        while i < self.n:
            here = at(table, i, k)
            if here == self.delete[i] + at(table, i + 1, k):
                out.append("D" + "D" * self.p.gone[i + 1])
                i += 1
            elif k and here == INSERT + at(table, i, k - 1):
                out.append("I")
                k -= 1
            else:
                out.append(("K" if self.p.initials[i] == (last if k & 1 else other) else "R") + "D" * self.p.gone[i + 1])
                i, k = i + 1, k - 1
        return "".join(out)

    def _deleted(self, begin: int, end: int) -> str:
        return "D" * (end - begin + sum(self.p.gone[begin + 1:end + 1]))

    def between(self) -> dict[tuple[str, str], tuple[int, str]]:
        """{(state before, state after): (cost, audit)}; pairs that cannot be are left out."""
        found: dict[tuple[str, str], tuple[int, str]] = {}
        lead = "D" * self.p.gone[0]

        def offer(p: str, q: str, cost: int, audit: str) -> None:
            new = (self.fixed + cost, lead + audit)
            if (p, q) not in found or new < found[p, q]:
                found[p, q] = new

        nothing = self._deleted(0, self.n)
        for p in self.states:
            if p in "0s":
                offer(p, p, self.all_deleted[0], nothing)
        first = {p: "a" if p == "u" else "u" for p in self.states}
        for last in "ua":
            table = self._table(last, max(self._incumbent(f, last) for f in set(first.values())))
            low, row = table[0]
            for p in self.states:
                # lengths of the string that begins and ends as it must; without a symbol the state stays
                lengths = [k for k in range(low, low + len(row)) if (k & 1) == (first[p] == last) and (k or p == last)]
                least = min((row[k - low] for k in lengths), default=_INF)
                for k in lengths:
                    if least < _INF and row[k - low] == least:
                        offer(p, last, least, self._trace(table, last, 0, k))
            if "0" in self.states:
                self._led_by_system(table, last, offer)
        if "0" in self.states:
            for t in range(self.n):
                if self.p.initials[t] == "s":
                    offer("0", "s", self.all_deleted[0] - self.delete[t], self._deleted(0, t) + "K" + "D" * self.p.gone[t + 1] + self._deleted(t + 1, self.n))
        return found

    def _led_by_system(self, table, last: str, offer) -> None:
        """Strings that begin with s: the first turn that is not deleted is a system turn, and is kept."""
        odd = last == "u"
        best, ways = _INF, []
        for t in range(self.n):
            if self.p.initials[t] == "s":
                low, row = table[t + 1]
                before = self.all_deleted[0] - self.all_deleted[t]
                for k in range(max(low, 1), low + len(row)):
                    if (k & 1) == odd and before + row[k - low] <= min(best, _INF - 1):
                        best = before + row[k - low]
                        ways.append((best, t, k))
        for cost, t, k in ways:
            if cost == best:
                offer("0", last, cost, self._deleted(0, t) + "K" + "D" * self.p.gone[t + 1] + self._trace(table, last, t + 1, k))


def whole(p: Piece) -> tuple[int, str]:
    """Cost and audit of a conversation that is one piece."""
    ways = Alignment(p, "0").between()
    return min((cost + AT_END[STATES.index(q)][0], audit + AT_END[STATES.index(q)][1]) for (_, q), (cost, audit) in ways.items())


def _slim(turns: DataFrame) -> DataFrame:
    """turns: (conv, turn, role, text). One row per distinct turn: conv, turn, role, d1, d2, copies, blank, short, again (its role and text stood
    in an earlier turn)."""
    bare = strip(F.col("text"))
    d1, d2 = hash_pair(F.col("text"))
    r = turns.select("conv", "turn", "role", d1.alias("d1"), d2.alias("d2"), (F.length(bare) == 0).alias("blank"),
                     (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("short"))
    r = r.groupBy("conv", "turn", "role", "d1", "d2", "blank", "short").agg(F.count(F.lit(1)).alias("copies"))
    same = Window.partitionBy("conv", "role", "d1", "d2").orderBy(F.col("turn").asc_nulls_first())
    return r.withColumn("again", F.row_number().over(same) > 1)


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "d1", "d2")]


def _arrow(t: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(t)


def _batches(rows: Iterator[tuple], schema: StructType, size: int = 4096) -> Iterator[pa.RecordBatch]:
    arrow, held = _arrow(schema), []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _groups(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in their first ``width`` values, each read as it comes."""
    from itertools import groupby
    return groupby(rows, key=lambda r: r[:width])


_PIECE = "turn long, role string, d1 long, d2 long, blank long, duplicate long, truncated long"


def _pieces(turns: DataFrame, conv_type) -> DataFrame:
    """conv, block, last (of its conversation), cost, audit and counts of the pieces of all conversations, with the key of their first turn."""
    ordered = _slim(turns).repartitionByRange(*_order()).sortWithinPartitions(*_order())
    ordered = materialize(ordered.withColumn("seq", F.monotonically_increasing_id()), "repair-turns")
    blocks = ordered.withColumn("block", F.shiftright("seq", BLOCK_BITS)).repartition("block").sortWithinPartitions("seq")
    blocks = blocks.select("block", "conv", "turn", "role", "d1", "d2", "copies", "blank", "short", "again")
    head = [StructField("conv", conv_type), *StructType.fromDDL("block long").fields]
    keyed = StructType.fromDDL(_PIECE).fields
    schema = StructType([*head, *keyed, *StructType.fromDDL("cost long, audit string, costs array<long>, audits array<string>").fields])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: list[tuple], edge: bool) -> tuple:
            p, blank, again, short = Piece(), 0, 0, 0
            for _, _, _, role, _, _, copies, is_blank, is_short, is_again in rows:
                p.add(role[:1], is_short, is_blank or is_again, copies)
                if is_blank:
                    blank += copies
                else:
                    again += copies if is_again else copies - 1
                    short += is_short and not is_again
            block, conv, *key = rows[0][:6]
            if not edge:
                return (conv, block, *key, blank, again, short, *whole(p), None, None)
            ways = Alignment(p).between()
            got = [ways.get((x, y), (None, None)) for x in STATES for y in STATES]
            return (conv, block, *key, blank, again, short, None, None, [g[0] for g in got], [g[1] for g in got])

        def all_() -> Iterator[tuple]:
            for _, rows in _groups(_rows(batches), 1):
                runs = [list(g) for _, g in _groups(rows, 2)]
                for i, r in enumerate(runs):
                    yield one(r, i in (0, len(runs) - 1))

        return _batches(all_(), schema)

    found = materialize(blocks.mapInArrow(align, schema), "repair-pieces")
    names = ["conv", "block", *[f.name for f in keyed]]
    parts = found.where("audit is null").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("block").desc())
    led = StructType([*schema.fields[:-4], *StructType.fromDDL("costs array<long>, audits array<string>, after array<int>, last boolean").fields])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_() -> Iterator[tuple]:
            for _, rows in _groups(_rows(batches), 1):
                ahead, last = [c for c, _ in AT_END], True
                for r in rows:
                    costs, audits = r[-2:]
                    best = [min(((costs[4 * p + q] + ahead[q], audits[4 * p + q], q) for q in range(4) if costs[4 * p + q] is not None and ahead[q] < _INF),
                                default=(_INF, "", 0)) for p in range(4)]
                    ahead = [b[0] for b in best]
                    yield (*r, [b[2] for b in best], last)
                    last = False

        return _batches(all_(), led)

    back = materialize(parts.select(*names, "costs", "audits").mapInArrow(backward, led), "repair-backward")
    forth = back.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("block").asc())
    done = StructType([*schema.fields[:-4], *StructType.fromDDL("cost long, audit string").fields])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_() -> Iterator[tuple]:
            for _, rows in _groups(_rows(batches), 1):
                state = 0
                for *own, costs, audits, after, last in rows:
                    to = after[state]
                    cost, audit = costs[4 * state + to], audits[4 * state + to]
                    state = to
                    if last:
                        cost, audit = cost + AT_END[state][0], audit + AT_END[state][1]
                    yield (*own, cost, audit)

        return _batches(all_(), done)

    return found.where("audit is not null").select(*names, "cost", "audit").unionByName(forth.mapInArrow(forward, done)).drop("block")


class _Conversation:
    """A conversation read turn by turn: its edits are applied as the turns come."""

    def __init__(self):
        self.letters, self.at, self.audits = "", 0, []
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.initial, self.state, self.hash, self.any = None, "0", hashlib.sha256(), False

    def piece(self, audit: str, cost: int, blank: int, duplicate: int, truncated: int) -> list[tuple]:
        new = self.inserted()
        self.letters, self.at = audit, 0
        self.audits.append(audit)
        self.cost += cost
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        return new

    def _emit(self, edit: str, role: str, text: str) -> tuple:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any, self.state = True, role[:1]
        return edit, role, text

    def _next(self) -> str:
        return ROLE["a" if self.state == "u" else "u"]

    def inserted(self) -> list[tuple]:
        """The turns to insert here."""
        out = []
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            out.append(self._emit("I", self._next(), ""))
            self.at += 1
        return out

    def turn(self, turn: int | None, role: str, text: str) -> list[tuple]:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        out = self.inserted()
        edit = self.letters[self.at]
        self.at += 1
        if edit != "D":
            out.append(self._emit(edit, role if edit == "K" else self._next(), text))
        return out

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_TURN_FIELDS = ("turn", "role", "d1", "d2", "tag", "text", "audit", "cost", "blank", "duplicate", "truncated")


def _stream(turns: DataFrame, conversations: DataFrame | None, conv_type, want_turns: bool) -> DataFrame:
    d1, d2 = hash_pair(F.col("text"))
    none = {c: F.lit(None).cast("string" if c in ("role", "text", "audit") else "long") for c in _TURN_FIELDS}
    texts = turns.select("conv", *[{"turn": F.col("turn"), "role": F.col("role"), "text": F.col("text"), "d1": d1, "d2": d2,
                                    "tag": F.lit(1).cast("long")}.get(c, none[c]).alias(c) for c in _TURN_FIELDS])
    pieces = _pieces(turns, conv_type).withColumns({"tag": F.lit(0).cast("long"), "text": none["text"]}).select("conv", *_TURN_FIELDS)
    rows = texts.unionByName(pieces)
    if conversations is not None:
        rows = rows.unionByName(conversations.distinct().select("conv", *[F.lit(2).cast("long").alias(c) if c == "tag" else none[c].alias(c) for c in _TURN_FIELDS]))
    rows = rows.repartition("conv").sortWithinPartitions(*_order(), "tag")
    shown = "no long, edit string, role string, text string" if want_turns else (
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    schema = StructType([StructField("conv", conv_type), *StructType.fromDDL(shown).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_() -> Iterator[tuple]:
            for (conv,), rows in _groups(_rows(batches), 1):
                c, no = _Conversation(), 0
                for _, turn, role, _, _, tag, text, *piece in rows:
                    new = c.piece(*piece) if tag == 0 else c.turn(turn, role, text) if tag == 1 else []
                    if want_turns:
                        for e in new:
                            yield (conv, no, *e)
                            no += 1
                new = c.inserted()
                if want_turns:
                    for e in new:
                        yield (conv, no, *e)
                        no += 1
                else:
                    yield (conv, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, c.cost, "".join(c.audits), c.hash.hexdigest())

        return _batches(all_(), schema, 512)

    return rows.mapInArrow(read, schema)


def _inputs(turns: DataFrame, conversations: DataFrame | None, conv: str, turn: str, role: str, text: str):
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    ids = None if conversations is None else conversations.select(F.col(conv).alias("conv"))
    return t, ids, t.schema["conv"].dataType


def repair(turns: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per conversation of ``turns``, and of ``conversations`` (a table with the id column; those without turns are empty): the id,
    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of ``role:text`` of the repaired turns, joined by line feeds)."""
    t, ids, kind = _inputs(turns, conversations, conv, turn, role, text)
    return _stream(t, ids, kind, False).withColumnRenamed("conv", conv)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: the id, no (from 0), edit (K, R or I), role and text of every turn."""
    t, _, kind = _inputs(turns, None, conv, turn, role, text)
    return _stream(t, None, kind, True).withColumnRenamed("conv", conv)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of a table of conversations with faults put in by crc32 of ``conv_id:turn`` modulo 20 (nulls are one space): 0 drops
    the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    r = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k")).where("k <> 0")
    r = r.withColumn("text", F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    r = r.withColumn("role", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")))
    return r.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))).drop("col")
