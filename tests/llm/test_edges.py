"""Nulls, empty tables, repeated records and further columns, for every operator on source records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stationflow.llm.credential_scan import find_secrets
from stationflow.llm.decontamination import find_contamination
from stationflow.llm.language_model import score_records
from stationflow.llm.licence_scan import find_licences
from stationflow.llm.near_duplicates import near_duplicate_groups
from stationflow.llm.packing import pack_records
from stationflow.llm.personal_data import find_personal_data
from stationflow.llm.quality_classifier import fit_quality_model, score_quality
from stationflow.llm.quality_rules import repetition_report
from stationflow.llm.source_urls import UrlRule, judge_source_urls

SCHEMA = "source_record_id bigint, raw_text string, spans string, id string, score double, kept boolean, digest binary"
LONG = "station demand " * 40_000
ROWS = [
    (1, None, None, None, None, None, None), (1, None, None, None, None, None, None), (None, "Full text", "x", "y", 1.0, True, b"z"),
    (None, None, None, None, None, None, None), (2, "", None, None, None, None, None), (3, LONG, None, None, None, None, None),
    (4, "\x00\ufeff \U0010ffff mixed", None, None, None, None, None), (2, "a@b.co password=abcdefgh", None, None, None, None, None),
]


def quality(df):
    labels = df.sparkSession.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 0)], "source_record_id bigint, quality int")
    return score_quality(df, fit_quality_model(df, labels))


def items(df):
    return df.sparkSession.createDataFrame([(None, "full text of an item"), (5, None), (6, ""), (7, "Full text")], "item_id bigint, item_text string")


PER_RECORD = {
    "secrets": find_secrets, "quality rules": repetition_report, "quality": quality, "groups": near_duplicate_groups,
    "personal data": find_personal_data, "licences": find_licences,
    "language model": lambda df: score_records(df.withColumn("in_training", F.col("kept"))),
}
OTHERS = {"packing": pack_records, "contamination": lambda df: find_contamination(df, items(df))}


@pytest.mark.parametrize("name", [*PER_RECORD, *OTHERS])
def test_rows(spark, name):
    run = (PER_RECORD | OTHERS)[name]
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = run(df)
    if name in PER_RECORD:
        assert found.count() == len(ROWS)
    assert len(found.columns) == len(set(found.columns)) and found.columns[0] == "source_record_id"
    empty = run(df.limit(0))
    assert empty.count() == 0 and empty.columns == found.columns


def test_pages(spark):
    schema = "page_id bigint, url string, html string, host string, verdict int"
    rows = [(1, None, None, None, None), (1, None, None, "h", 3), (None, "http://a.org/x", "<a href='http://b.net'>", None, None)]
    pages = spark.createDataFrame(rows, schema)
    rules = [UrlRule("org", "/", "allow")]
    assert judge_source_urls(pages, rules).count() == 3
    assert judge_source_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_source_urls(pages, []).collect()} == {"allow"}
