"""Source records as small tables, and words as the operators see them."""

from __future__ import annotations

import re

from stationflow.llm.records import ID, TEXT

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def records(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), f"{ID} bigint, {TEXT} string")


def by_id(df, key=ID):
    return {r[key]: r for r in df.collect()}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
