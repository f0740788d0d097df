from __future__ import annotations

from record_tables import by_id, records

from stationflow.llm.licence_scan import find_licences
from stationflow.llm.licence_texts import KNOWN_LICENCES


def test_known_texts_in_other_spellings(spark):
    known = dict(reversed(KNOWN_LICENCES))
    mit = known["MIT"].replace("<year> <holders>", "2021 Example Bikes S.A.")
    texts = [
        mit, mit.upper().replace(",", " ,").replace("\n\n", "\n"), "released  under the MIT licence", mit + " And more.",
        None, "", "?!", "Copyright (c) 2020 nobody", known["BSD-3-Clause"].replace('"', "\u201d"), "Anything else",
    ]
    found = by_id(find_licences(records(spark, texts)))
    assert [found[i].licence_id for i in range(10)] == [
        "MIT", "MIT", "MIT-notice", None, None, None, None, None, "BSD-3-Clause", None
    ]
    assert [found[i].digest is None for i in range(10)] == [False] * 4 + [True] * 4 + [False] * 2


def test_own_licences_and_ties(spark):
    own = spark.createDataFrame(
        [("b", "Open data of the city."), ("a", "open DATA of the city"), ("c", None), (None, "x"), ("d", "...")],
        "licence_id string, licence_text string",
    )
    found = find_licences(records(spark, ["Open data of the city!", "x", ""], ids=[1, 1, None]), own).collect()
    assert sorted((str(r[0]), str(r.licence_id)) for r in found) == [("1", "None"), ("1", "a"), ("None", "None")]


def test_every_known_text_is_found(spark):
    texts = [t for _, t in KNOWN_LICENCES]
    found = by_id(find_licences(records(spark, texts)))
    assert all(found[i].licence_id == name for i, (name, _) in enumerate(KNOWN_LICENCES))
