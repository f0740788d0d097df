"""Repairs of event ledgers against all edit strings, and against a table of cheapest strings."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import pytest

from stationflow.llm import ledger_repair as L
from stationflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "trip_id bigint, event_number bigint, event string, event_text string"
KINDS = L.Kinds()
SOUND = re.compile(r"(s?(da)+)?")
NAMES = {"s": "service", "d": "departure", "a": "arrival", "x": "x"}


def apply(audit, kinds, codes):
    """(cost, kinds left) of an edit string, or None if it does not fit."""
    cost, left, at = 0, "", 0
    for edit in audit:
        wanted = "a" if left[-1:] == "d" else "d"
        if edit == "I":
            cost, left = cost + 5, left + wanted
            continue
        if at == len(kinds):
            return None
        kind, fault = kinds[at], codes[at]
        at += 1
        if edit == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 5 * (fault == "truncated") + (edit == "R")
        left += kind if edit == "K" else wanted
    return (cost, left) if at == len(kinds) and SOUND.fullmatch(left) else None


def every_audit(kinds, codes):
    """The cheapest edit string, the least of equals, by trying all with up to three insertions."""
    best = None
    for edits in itertools.product("DKR", repeat=len(kinds)):
        for n in range(4):
            for places in itertools.combinations_with_replacement(range(len(kinds) + 1), n):
                audit = "".join("I" * places.count(i) + (edits[i] if i < len(kinds) else "") for i in range(len(kinds) + 1))
                got = apply(audit, kinds, codes)
                if got and (best is None or (got[0], audit) < best):
                    best = (got[0], audit)
    return best


def table_audit(kinds, codes):
    """The same by a table of (cost, string) per state: what is left ends in nothing, s, d or a."""
    state = {"": (0, "")}

    def put(into, key, cost, text):
        if key not in into or (cost, text) < into[key]:
            into[key] = (cost, text)

    def inserts(now):
        out = dict(now)
        for _ in range(2):
            for key, (cost, text) in list(out.items()):
                put(out, "a" if key == "d" else "d", cost + 5, text + "I")
        return out

    for kind, fault in zip(kinds, codes):
        after = {}
        for key, (cost, text) in inserts(state).items():
            put(after, key, cost + 2, text + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 5 * (fault == "truncated")
            wanted = "a" if key == "d" else "d"
            if kind == wanted or kind == "s" and key == "":
                put(after, kind, more, text + "K")
            put(after, wanted, more + 1, text + "R")
        state = after
    return min(v for k, v in inserts(state).items() if k in ("", "a"))


def code_of(kind, fault):
    return "sda".find(kind) % 4 | {"blank": L._MUST, "duplicate": L._MUST, "truncated": L._SHORT}.get(fault, 0)


def solved(kinds, codes):
    cells = L.solved(bytes(map(code_of, kinds, codes)), 0)
    ways = L.chained([L.Way(0, None), None, None, None], [c and c[0] for c in cells] + [None] * 12, [c and c[1] for c in cells] + [None] * 12)
    return L.finished(ways)


def made(pick, n):
    return "".join(pick.choice("sdaddaax") for _ in range(n)), [pick.choice([None] * 5 + ["blank", "truncated"]) for _ in range(n)]


def test_equals_all_edit_strings():
    pick = random.Random(1)
    for _ in range(150):
        ledger = made(pick, pick.randint(0, 4))
        assert solved(*ledger) == every_audit(*ledger) == table_audit(*ledger)


def test_equals_the_table_of_strings(monkeypatch):
    pick = random.Random(2)
    for settle in (3, 4096):
        monkeypatch.setattr(L, "_SETTLE", settle)
        for _ in range(400):
            ledger = made(pick, pick.randint(0, 60))
            assert solved(*ledger) == table_audit(*ledger)


def test_stretches_chain_to_the_whole():
    pick = random.Random(3)
    for _ in range(200):
        kinds, codes = made(pick, pick.randint(0, 30))
        data, ways, at = bytes(map(code_of, kinds, codes)), [L.Way(0, None), None, None, None], 0
        while at < len(data):
            to = at + pick.randint(1, 8)
            cells = [c for e in range(4) for c in L.solved(data[at:to], e)]
            ways, at = L.chained(ways, [c and c[0] for c in cells], [c and c[1] for c in cells]), to
        assert L.finished(ways) == table_audit(kinds, codes)


@pytest.mark.parametrize("mask", [(1 << 61) - 1, 7, 1])
def test_colliding_hashes_change_no_comparison(monkeypatch, mask):
    """With a tiny modulus nearly all hashes collide; walking the nodes puts it right."""
    monkeypatch.setattr(L, "_MASK", mask)
    pick, root = random.Random(4), L.Edits()
    nodes = [root]
    for _ in range(300):
        nodes.append(L.Edits(pick.choice(nodes[-30:]), pick.choice("DK")))
    for _ in range(5000):
        a, b, x, y = pick.choice(nodes), pick.choice(nodes), pick.choice(["", "D", "K"]), pick.choice(["", "D", "K"])
        if (a.text() + x).startswith(b.text() + y) or (b.text() + y).startswith(a.text() + x):
            continue  # edits of equal cost never extend one another
        assert L.comes_first(a, x, b, y) == (a.text() + x < b.text() + y)
    for node in nodes:
        assert node.at(node.depth // 2).text() == node.text()[: node.depth // 2]


def test_long_ledgers_stay_small():
    audit = L.solved(bytes([1, 2] * 50_000), 0)[L._DONE]
    assert audit == (0, "K" * 100_000)


def plain(rows, kinds=KINDS):
    """Report and repaired events of one ledger, in plain Python."""
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = [(n, " " if e is None else e, " " if t is None else t) for n, e, t in rows]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
    seen, faults = set(), []
    for _, event, text in rows:
        inked = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not inked else "duplicate" if (event, text) in seen else "truncated" if inked[-1] not in ".!?" else None)
        seen.add((event, text))
    first = [k[:1] for k in kinds]
    letters = "".join("sda"[first.index(e[:1])] if e[:1] in first else "x" for _, e, _ in rows)
    numbers = {n for n, _, _ in rows if n is not None}
    cost, audit = table_audit(letters, faults)
    left, at, out = [], 0, False
    for edit in audit:
        if edit == "I":
            left.append((kinds[2] if out else kinds[1], ""))
        else:
            _, event, text = rows[at]
            at += 1
            if edit == "D":
                continue
            left.append((event if edit == "K" else kinds[2] if out else kinds[1], text))
        out = left[-1][0][:1] == kinds[1][:1]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("sd", "da", "ad") for a, b in zip(letters, letters[1:])), "cost": cost, "audit": audit,
        "source_record_hash": hashlib.sha256("\n".join(f"{e}:{t}" for e, t in left).encode()).hexdigest(),
    }, left


def ledgers(pick, n):
    rows = []
    for trip in [*range(n), None]:
        for k in range(pick.randint(1, 14)):
            text = pick.choice(["Sol 1.", "Sol 2.", "left", "", None, " \n", f"at {k}!", f"from {k}?  "])
            rows.append((trip, pick.choice([k, k, k, k + 1, None]), pick.choice([*NAMES.values(), "departure", "arrival", None]), text))
    return rows


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_ledgers_dealt_over_tasks(spark, partitions):
    """With many ranges every ledger is cut into stretches."""
    rows = ledgers(random.Random(5), 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, SCHEMA)
        found = {r.trip_id: r.asDict() for r in L.repair_ledgers(df).collect()}
        events = {}
        for r in sorted(L.repaired_events(df).collect(), key=lambda r: r.event_number):
            events.setdefault(r.trip_id, []).append((r.event, r.event_text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert len(found) == 41
    for trip, report in found.items():
        expected, left = plain([r[1:] for r in rows if r[0] == trip])
        assert report == expected | {"trip_id": trip, "n_events": len(left)}
        assert events.get(trip, []) == left


def test_one_ledger_with_most_events(spark):
    rows = [(7, k, "departure" if k % 2 == 0 else "arrival", f"dock {k}." if k % 50 else "lost") for k in range(3000)]
    rows += [(k, 0, "departure", "x.") for k in range(8, 20)]
    report = {r.trip_id: r for r in L.repair_ledgers(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    expected, _ = plain([r[1:] for r in rows[:3000]])
    assert {k: report[7][k] for k in expected} == expected


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "departure", "a.", 5, "x")], SCHEMA + ", key int, mark string")
    assert L.repair_ledgers(df).first().audit == "D"
    assert L.repair_ledgers(df.limit(0)).count() == 0 and L.repaired_events(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.repair_ledgers(df, L.Kinds("departure", "dock", "arrival"))


def test_trips_of_a_vehicle(spark):
    trips = spark.sql(
        "SELECT * FROM VALUES ('v1', timestamp'2018-03-25 08:00:00', timestamp'2018-03-25 08:20:00', '1', '2'),"
        " ('v1', timestamp'2018-03-25 09:00:00', null, '2', null) AS t(trip_id, started_at, ended_at, origin, destination)"
    )
    report = L.repair_ledgers(L.trip_ledgers(trips)).first()
    # The unknown arrival is blank and comes first, as its clock is null; it and the second departure go.
    assert (report.audit, report.cost, report.blank) == ("DKKD", 4, 1)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_query_equals_plain_python(spark):
    found = {r.conv_id: r.asDict() for r in QUERIES["op12_conversation_repair"](spark, FOLDER).collect()}
    kinds = L.Kinds("system", "user", "assistant")
    whole = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns = whole.setdefault(r.conv_id, [])
        fault = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", r.text) if fault == 2 else r.text
        turns += [(r.turn, "user" if fault == 4 else r.role, text)] * (2 if fault == 3 else 1)
    assert found.keys() == whole.keys()
    for conv, turns in whole.items():
        expected, _ = plain(turns, kinds)
        expected["repaired_sha256"] = expected.pop("source_record_hash")
        assert found[conv] == expected | {"conv_id": conv}
