"""The operators on the project's own records: lines of trip files and snapshot documents."""

from __future__ import annotations

from record_tables import by_id

from stationflow.llm.credential_scan import find_secrets
from stationflow.llm.ledger_repair import repair_ledgers, trip_ledgers
from stationflow.llm.near_duplicates import near_duplicate_groups
from stationflow.llm.personal_data import find_personal_data
from stationflow.llm.quality_rules import repetition_report
from stationflow.llm.records import records_of_documents, records_of_lines
from stationflow.sources import snapshots, trips

HEADER = "unlock_date,lock_date,station_unlock,station_lock,note"
LINES = [
    HEADER,
    "2021-06-01T08:00:00,2021-06-01T08:20:00,1,2,contact ana.sol@example.org or +34 600 123 456",
    "2021-06-01T09:00:00,2021-06-01T09:20:00,2,3,token=abcdef123456",
    "2021-06-01T09:00:00,2021-06-01T09:20:00,2,3,token=abcdef123456",
    "",
    " ".join(["dock 7 is empty and the next dock is empty too"] * 9),
]


def test_lines_of_a_trip_file(spark, tmp_path):
    (tmp_path / "june.csv").write_text("\n".join(LINES) + "\n")
    records = records_of_lines(trips.numbered_rows(spark.read.text(str(tmp_path)))).cache()
    key = {k.rsplit(":", 1)[1]: k for k in by_id(records, "source_record_id")}
    assert sorted(key) == [str(i) for i in range(len(LINES))]
    secrets, people = by_id(find_secrets(records)), by_id(find_personal_data(records))
    assert [secrets[key[str(i)]].n_assign for i in range(6)] == [0, 0, 1, 1, 0, 0]
    assert (people[key["1"]].n_email, people[key["1"]].n_phone) == (1, 1) and people[key["0"]].n_email == 0
    report = by_id(repetition_report(records))
    assert report[key["5"]].n_repeat_words > 0 and not report[key["5"]].kept and report[key["4"]].n_words == 0
    groups = by_id(near_duplicate_groups(records))
    assert groups[key["3"]].component_id == groups[key["2"]].component_id == key["2"]
    assert groups[key["1"]].component_id == key["1"]


def test_snapshot_documents(spark, tmp_path):
    one = '{"stations": [{"id": "7", "name": "api_key: Zk3mQ9xV2b"}],\n "_id": "2018-05-01T00:00:00"}'
    (tmp_path / "may.json").write_text(one + one.replace("T00", "T01") + "\n" + one)
    records = records_of_documents(snapshots.document_texts(spark, str(tmp_path)))
    found = find_secrets(records).collect()
    assert len(found) == 3 and all(r.n_assign == 1 for r in found) and len({r.source_record_id for r in found}) == 2


def test_events_of_a_flexible_trip_file(spark, tmp_path):
    """Rows of a file without trip ids share the vehicle's id, so its events form one ledger."""
    rows = ["unlock_date,lock_date,station_unlock,station_lock,idBike", "2021-06-01T08:00:00,2021-06-01T08:20:00,1,2,77", "2021-06-01T09:00:00,2021-06-01T09:30:00,2,3,77"]
    (tmp_path / "bikes.csv").write_text("\n".join(rows) + "\n")
    typed = trips.typed_flexible_trips(trips.read_flexible_trips(spark, str(tmp_path)), 2021, "UTC")
    ledger = trip_ledgers(typed.withColumnsRenamed({"started": "started_at", "ended": "ended_at"}))
    report = repair_ledgers(ledger).first()
    assert (report.trip_id, report.audit, report.cost) == ("77", "KKKK", 0)
