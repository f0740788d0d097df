"""Repair of event ledgers: an optional service entry, then departures and arrivals in turn.

An export without trip ids names the vehicle instead, so all events of one vehicle share a `trip_id`.
Such a ledger is sound when its events read `service? (departure arrival)+`, or when it is empty.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationflow.llm.records import ship_package

TRIP, NUMBER, EVENT, DETAIL = "trip_id", "event_number", "event", "event_text"

DELETE, REKIND, INSERT, CUT = 2, 1, 5, 5  # costs; keeping is free
_SPACES = " \t\n\x0b\x0c\r"
_OPENED, _EMPTY, _OUT, _DONE = 1, 0, 2, 3  # service read; nothing read; after a departure; after an arrival
_MUST, _SHORT = 4, 8  # bits of an event's code above its kind: 0 opening, 1 first, 2 second, 3 other
_MASK, _BASE = (1 << 61) - 1, 1_000_003
_SETTLE = 4096


class Kinds(NamedTuple):
    """Names of the three kinds of events; their first letters must differ."""

    opening: str = "service"
    first: str = "departure"
    second: str = "arrival"


class Edits:
    """A string of edits as a linked node; strings with a common prefix share its nodes.

    `up[j]` is the ancestor 2**j edits back, `hash` a rolling hash of the whole string.
    """

    __slots__ = ("parent", "letter", "depth", "hash", "up")

    def __init__(self, parent: Edits | None = None, letter: str = ""):
        self.parent, self.letter, self.up = parent, letter, []
        self.depth, self.hash = 0, 0
        if parent is not None:
            self.depth, self.hash = parent.depth + 1, (parent.hash * _BASE + ord(letter)) % _MASK
            node: Edits | None = parent
            while node is not None:
                self.up.append(node)
                j = len(self.up) - 1
                node = node.up[j] if len(node.up) > j else None

    def at(self, depth: int) -> Edits:
        """The prefix of that many edits."""
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def text(self) -> str:
        out, node = [], self
        while node.parent is not None:
            out.append(node.letter)
            node = node.parent
        return "".join(reversed(out))


def _mismatch(a: Edits, b: Edits) -> tuple[str, str] | None:
    """First differing edits of two strings of equal length, found by walking back to a shared node."""
    found = None
    while a is not b:
        if a.letter != b.letter:
            found = a.letter, b.letter
        a, b = a.parent, b.parent
    return found


def comes_first(a: Edits, tail_a: str, b: Edits, tail_b: str) -> bool:
    """Whether edits `a` + `tail_a` are less than `b` + `tail_b` in ASCII order; a tail is one edit or none.

    The longest common prefix is sought by leaps over ancestors of equal length with unequal hashes.
    Equal hashes stand for equal strings only once the nodes are the same or their letters compared.
    """
    depth = min(a.depth, b.depth)
    rest_a = a.at(depth + 1).letter if a.depth > depth else tail_a
    rest_b = b.at(depth + 1).letter if b.depth > depth else tail_b
    x, y = a.at(depth), b.at(depth)
    if x.hash == y.hash:
        differing = _mismatch(x, y)
        if differing:
            return differing[0] < differing[1]
        if rest_a != rest_b:
            return rest_a < rest_b
        return a.depth + len(tail_a) < b.depth + len(tail_b)
    for j in reversed(range(len(x.up))):
        if j < len(x.up) and x.up[j].hash != y.up[j].hash:
            x, y = x.up[j], y.up[j]
    differing = _mismatch(x.parent, y.parent)
    return differing[0] < differing[1] if differing else x.letter < y.letter


Head = tuple[int, Edits]
Heads = list[Head | None]


class _Choice:
    """The cheapest way into each state, the ASCII-least of equals; only winners become nodes."""

    def __init__(self):
        self.best: list[tuple[int, Edits, str] | None] = [None] * 4

    def offer(self, state: int, cost: int, node: Edits, letter: str) -> None:
        now = self.best[state]
        if now is None or cost < now[0] or cost == now[0] and comes_first(node, letter, now[1], now[2]):
            self.best[state] = cost, node, letter

    def heads(self) -> Heads:
        return [b and (b[0], Edits(b[1], b[2]) if b[2] else b[1]) for b in self.best]


def with_inserts(heads: Heads) -> Heads:
    """States after insertions: a departure leads to `_OUT`, an arrival from there to `_DONE`."""
    choice = _Choice()
    for state, head in enumerate(heads):
        if head:
            choice.offer(state, *head, "")
            if state != _OUT:
                choice.offer(_OUT, head[0] + INSERT, head[1], "I")
    once = choice.heads()
    if once[_OUT]:
        choice = _Choice()
        for state, head in enumerate(once):
            if head:
                choice.offer(state, *head, "")
        choice.offer(_DONE, once[_OUT][0] + INSERT, once[_OUT][1], "I")
        once = choice.heads()
    return once


def _after(heads: Heads, code: int) -> Heads:
    """States after one event of the ledger."""
    heads = with_inserts(heads)
    kind, choice = code & 3, _Choice()
    for state, head in enumerate(heads):
        if not head:
            continue
        cost, node = head
        choice.offer(state, cost + DELETE, node, "D")
        if code & _MUST:
            continue
        if code & _SHORT:
            cost += CUT
        if kind == 0 and state == _EMPTY:
            choice.offer(_OPENED, cost, node, "K")
        wanted, into = (2, _DONE) if state == _OUT else (1, _OUT)
        if kind == wanted:
            choice.offer(into, cost, node, "K")
        else:
            choice.offer(into, cost + REKIND, node, "R")
    best, done = choice.best, choice.best[_DONE]
    if done:
        # Whatever follows an empty or opened ledger also follows a finished one, at most a deleted opening more.
        if best[_EMPTY] and best[_EMPTY][0] > done[0] + DELETE:
            best[_EMPTY] = None
        if best[_OPENED] and best[_OPENED][0] > done[0]:
            best[_OPENED] = None
    return choice.heads()


def _settled(heads: Heads) -> tuple[str, Heads]:
    """Edits common to all states as text, and the states with only what follows them as nodes."""
    live = [h[1] for h in heads if h]
    depth = min(n.depth for n in live)
    nodes = {n.at(depth) for n in live}
    while len(nodes) > 1:
        nodes = {n.parent for n in nodes}
    shared = nodes.pop()
    fresh = {shared: Edits()}
    for node in live:
        line = []
        while node not in fresh:
            line.append(node)
            node = node.parent
        for old in reversed(line):
            fresh[old] = Edits(fresh[old.parent], old.letter)
    return shared.text(), [h and (h[0], fresh[h[1]]) for h in heads]


def solved(codes: bytes, entry: int) -> list[tuple[int, str] | None]:
    """(cost, edits) of the best audit of a stretch of events from one state into each state."""
    heads: Heads = [None] * 4
    heads[entry] = (0, Edits())
    settled = []
    for k, code in enumerate(codes, 1):
        heads = _after(heads, code)
        if k % _SETTLE == 0:
            text, heads = _settled(heads)
            settled.append(text)
    before = "".join(settled)
    return [h and (h[0], before + h[1].text()) for h in heads]


class Way(NamedTuple):
    """A cost and the pieces of its edits, last one first, as links."""

    cost: int
    pieces: tuple | None

    def text(self) -> str:
        out, at = [], self.pieces
        while at:
            out.append(at[1])
            at = at[0]
        return "".join(reversed(out))


def chained(ways: list[Way | None], costs: list[int | None], audits: list[str | None]) -> list[Way | None]:
    """Ways through one more stretch, given its (entry, exit) table in row order."""
    out: list[Way | None] = [None] * 4
    for entry, way in enumerate(ways):
        if way is None:
            continue
        for state in range(4):
            cost = costs[4 * entry + state]
            if cost is None:
                continue
            new, old = Way(way.cost + cost, (way.pieces, audits[4 * entry + state])), out[state]
            if old is None or new.cost < old.cost or new.cost == old.cost and new.text() < old.text():
                out[state] = new
    return out


def finished(ways: list[Way | None]) -> tuple[int, str]:
    """Cost and edits of the best sound ledger: empty, or ending with an arrival."""
    ends = []
    for state, inserts in ((_EMPTY, ""), (_DONE, ""), (_OUT, "I"), (_OPENED, "II")):
        if ways[state]:
            ends.append((ways[state].cost + INSERT * len(inserts), inserts, ways[state]))
    least = min(e[0] for e in ends)
    return least, min(way.text() + inserts for cost, inserts, way in ends if cost == least)


_STRETCH = (
    "costs array<bigint>, audits array<string>, first_kind string, last_kind string, first_number bigint, last_number bigint,"
    " numbers bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)


class _Stretch:
    """The events of one ledger that one task sees, in order: one byte each, and what the report counts."""

    def __init__(self, kinds: Kinds):
        self.kinds, self.codes = kinds, bytearray()
        self.first_kind = self.last_kind = self.first_number = self.last_number = None
        self.numbers = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, number: int | None, kind: str, blank: bool, repeat: bool, short: bool) -> None:
        letters = [k[:1] for k in self.kinds]
        code = letters.index(kind) if kind in letters else 3
        if blank:
            self.blank += 1
        elif repeat:
            self.duplicate += 1
        elif short:
            self.truncated += 1
            code |= _SHORT
        self.codes.append(code | _MUST if blank or repeat else code)
        if self.last_kind is None:
            self.first_kind = kind
        elif not legal(self.last_kind, kind, self.kinds):
            self.illegal += 1
        self.last_kind = kind
        if number is not None:
            if self.first_number is None:
                self.first_number = number
            self.numbers += number != self.last_number
            self.last_number = number

    def row(self, key: Any, whole: bool) -> dict:
        """Inside a task's rows a ledger starts with its first event; at their borders any state may precede."""
        tables = [solved(self.codes, e) if e == _EMPTY or not whole else [None] * 4 for e in range(4)]
        cells = [cell for table in tables for cell in table]
        return {
            "key": key, "part": TaskContext.get().partitionId() if TaskContext.get() else 0,
            "costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells],
            **{name: getattr(self, name) for name in ("first_kind", "last_kind", "first_number", "last_number",
               "numbers", "blank", "duplicate", "truncated", "illegal")},
        }


def legal(before: str, after: str, kinds: Kinds) -> bool:
    s, u, a = (k[:1] for k in kinds)
    return (before, after) in ((s, u), (u, a), (a, u))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stretches(batches: Iterator[pa.RecordBatch], kinds: Kinds, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        now, key, first = None, None, True
        for k, *event in _rows(batches):
            if now is None or k != key:
                if now is not None:
                    yield now.row(key, whole=not first)
                    first = False
                now, key = _Stretch(kinds), k
            now.add(*event)
        if now is not None:
            yield now.row(key, whole=False)

    return _batched(rows(), schema)


class _Audit:
    """A ledger's report, put together from its stretches in order."""

    def __init__(self, kinds: Kinds):
        self.kinds, self.ways = kinds, [Way(0, None), None, None, None]
        self.lowest = self.highest = self.kind = None
        self.numbers = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, s: dict) -> None:
        self.ways = chained(self.ways, s["costs"], s["audits"])
        for name in ("blank", "duplicate", "truncated", "illegal", "numbers"):
            setattr(self, name, getattr(self, name) + s[name])
        if self.kind is not None and not legal(self.kind, s["first_kind"], self.kinds):
            self.illegal += 1
        self.kind = s["last_kind"]
        if s["first_number"] is not None:
            if self.lowest is None:
                self.lowest = s["first_number"]
            elif s["first_number"] == self.highest:
                self.numbers -= 1
            self.highest = s["last_number"]

    def report(self, key: Any) -> dict:
        cost, audit = finished(self.ways)
        gaps = self.highest - self.lowest + 1 - self.numbers if self.lowest is not None else 0
        return {"key": key, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": audit}


def _replayed(batches: Iterator[pa.RecordBatch], kinds: Kinds) -> Iterator[tuple[Any, dict | None, str, str]]:
    """(key, None, event, text) of each event of the repaired ledgers; after a ledger's last (key, report, "", "").

    The stretches of a ledger come before its events, so each event meets its edit as it streams by.
    """
    audit, report, place, out, key, begun = None, None, 0, False, None, False

    def inserted() -> Iterator[tuple[Any, None, str, str]]:
        nonlocal place, out
        letters = report["audit"]
        while place < len(letters) and letters[place] == "I":
            yield key, None, kinds.second if out else kinds.first, ""
            out, place = not out, place + 1

    for k, stretch, event, detail in _rows(batches):
        if stretch is not None:
            if not begun or k != key or report is not None:
                if begun:
                    yield from inserted()
                    yield key, report, "", ""
                audit, report, place, out, key, begun = _Audit(kinds), None, 0, False, k, True
            audit.add(stretch)
            continue
        if report is None:
            report = audit.report(key)
        yield from inserted()
        edit, place = report["audit"][place], place + 1
        if edit == "D":
            continue
        if edit == "R":
            event = kinds.second if out else kinds.first
        out = event[:1] == kinds.first[:1]
        yield key, None, event, detail
    if begun:
        yield from inserted()
        yield key, report, "", ""


def _reports(batches: Iterator[pa.RecordBatch], kinds: Kinds, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        digest, size = hashlib.sha256(), 0
        for _, report, event, detail in _replayed(batches, kinds):
            if report is None:
                digest.update((("\n" if size else "") + f"{event}:{detail}").encode())
                size += 1
            else:
                yield report | {"n_events": size, "source_record_hash": digest.hexdigest()}
                digest, size = hashlib.sha256(), 0

    return _batched(rows(), schema)


def _events(batches: Iterator[pa.RecordBatch], kinds: Kinds, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        place = 0
        for key, report, event, detail in _replayed(batches, kinds):
            if report is None:
                yield {"key": key, NUMBER: place, EVENT: event, DETAIL: detail}
            place = 0 if report else place + 1

    return _batched(rows(), schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _named(df: DataFrame) -> DataFrame:
    """The four columns under names of their own, the digest that orders equal numbers, and the faults."""
    event, detail = F.coalesce(F.col(EVENT).cast("string"), F.lit(" ")), F.coalesce(F.col(DETAIL).cast("string"), F.lit(" "))
    return df.select(F.col(TRIP).alias("key"), F.col(NUMBER).cast("bigint").alias("number"), event.alias("event"), detail.alias("detail")) \
        .withColumn("mark", F.unhex(F.sha2("detail", 256)))


def _in_order() -> list[Column]:
    return [F.col("number").asc_nulls_first(), F.col("event"), F.col("mark")]


def _joined_stream(events: DataFrame, kinds: Kinds) -> DataFrame:
    """Stretches and events of each ledger in one task, stretches first, both in order."""
    if len({k[:1] for k in kinds}) < 3 or not all(kinds):
        raise ValueError("the kinds of events must differ in their first letters")
    ship_package(events.sparkSession)
    rows = _named(events)
    same = Window.partitionBy("key", "event", "mark").orderBy(F.col("number").asc_nulls_first())
    end = F.rtrim("detail", F.lit(_SPACES))
    judged = rows.select(
        "key", "number", "event", "mark", F.substring("event", 1, 1).alias("kind"), (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("short"),
    ).withColumn("repeat", F.row_number().over(same) > 1)
    dealt = judged.repartitionByRange(F.col("key").asc_nulls_first(), *_in_order())
    sorted_ = dealt.sortWithinPartitions(F.col("key").asc_nulls_first(), *_in_order(), "repeat")
    kind = rows.schema["key"].dataType.simpleString()
    schema = StructType.fromDDL(f"key {kind}, part int, {_STRETCH}")
    stretches = sorted_.select("key", "number", "kind", "blank", "repeat", "short").mapInArrow(
        functools.partial(_stretches, kinds=kinds, schema=_arrow(schema)), schema
    )
    stretch = F.struct(*[c for c in schema.names if c not in ("key", "part")])
    heads = stretches.select(
        "key", F.lit(0).alias("tag"), F.col("part").cast("bigint").alias("number"), F.lit(None).cast("string").alias("event"),
        F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("detail"), stretch.alias("stretch"),
    )
    tails = rows.select("key", F.lit(1).alias("tag"), "number", "event", "mark", "detail", F.lit(None).cast(heads.schema["stretch"].dataType).alias("stretch"))
    both = heads.unionByName(tails).repartition("key")
    return both.sortWithinPartitions(F.col("key").asc_nulls_first(), "tag", *_in_order()).select("key", "stretch", "event", "detail")


def repair_ledgers(events: DataFrame, kinds: Kinds = Kinds()) -> DataFrame:
    """Audit the event ledger of each `trip_id` and find its cheapest repair.

    `events` has `trip_id`, `event_number` (order; nulls first, equal numbers by event, then digest of
    the text), `event` (its kind, told by its first letter) and `event_text`; null kinds and texts count
    as one space. The first fault of an event counts: blank text, duplicate (kind and text seen earlier),
    truncated (last character outside white space is none of `.!?`). Edits: Keep costs 0, Rekind to
    departure or arrival 1, Delete 2 (required for blank and duplicate), Insert an empty departure or
    arrival 5; a truncated event that stays adds 5. The audit is the cheapest string of edits whose
    kinds read `(service? (departure arrival)+)?`, the ASCII-least of equals.

    Edit strings are linked nodes that share prefixes; ties are decided by their longest common prefix,
    sought by binary lifting over rolling hashes and confirmed node by node. Rows are dealt by ranges of
    (`trip_id`, order), so a ledger with any share of all events is audited in stretches by many tasks, each
    from all four states; a second pass chains them and meets the events as a stream.

    One row per `trip_id` (null is one): `gaps` (numbers missing between least and greatest), `blank`,
    `duplicate`, `truncated`, `illegal` (neighbours that may not follow each other), `cost`, `audit`,
    `n_events` and `source_record_hash` (SHA-256 of the repaired `event:event_text` lines). An empty table
    gives an empty result; further columns are ignored.
    """
    stream = _joined_stream(events, kinds)
    kind = stream.schema["key"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    schema = StructType.fromDDL(f"key {kind}, {counts}, audit string, n_events bigint, source_record_hash string")
    return stream.mapInArrow(functools.partial(_reports, kinds=kinds, schema=_arrow(schema)), schema).withColumnRenamed("key", TRIP)


def repaired_events(events: DataFrame, kinds: Kinds = Kinds()) -> DataFrame:
    """The events of the ledgers as `repair_ledgers` mends them, numbered from 0 per `trip_id`."""
    stream = _joined_stream(events, kinds)
    kind = stream.schema["key"].dataType.simpleString()
    schema = StructType.fromDDL(f"key {kind}, {NUMBER} bigint, {EVENT} string, {DETAIL} string")
    return stream.mapInArrow(functools.partial(_events, kinds=kinds, schema=_arrow(schema)), schema).withColumnRenamed("key", TRIP)


def trip_ledgers(trips: DataFrame) -> DataFrame:
    """Departure and arrival events of typed trips; events of one `trip_id` are numbered by clock.

    A null clock or station leaves the event's text without its closing mark, so it counts as truncated,
    or as blank where both are null.
    """
    def event(kind: str, clock: str, station: str) -> Column:
        text = F.concat(F.coalesce(F.col(clock).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(station).cast("string"), F.lit("")))
        whole = F.col(clock).isNotNull() & F.col(station).isNotNull()
        return F.struct(
            F.unix_seconds(F.col(clock)).alias(NUMBER), F.lit(kind).alias(EVENT), F.concat(text, F.when(whole, ".").otherwise("")).alias(DETAIL)
        )

    both = F.array(event("departure", "started_at", "origin"), event("arrival", "ended_at", "destination"))
    return trips.select(TRIP, F.explode(both).alias("e")).select(TRIP, "e.*")
