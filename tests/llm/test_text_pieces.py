"""SentencePiece ids and texts against the library, on ugly texts and on the test tables."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from stationflow.llm import text_pieces as T
from stationflow.llm.queries import QUERIES
from stationflow.llm.records import ID
from record_tables import by_id, records

VOCABULARY = str(public_tokenizers.path("piece_bpe_32k.model"))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)


def ugly_texts():
    pick = random.Random(7)
    letters = "  ▁▁abcdeth\n\t.,ΩЖ中文字日本0123😀é\x00<s>�"
    made = ["".join(pick.choice(letters) for _ in range(pick.choice([0, 1, 5, 60, 300]))) for _ in range(400)]
    return made + ["", " ", "a" * 5000, " " * 3000, "thethe" * 700, "<0x41>", "中" * 100, "x\n" * 9, "Plaza Mayor;07/7;2018-03-25T02:30:00\n"]


def test_encoding_and_decoding_equal_the_library(spark, library):
    texts = ugly_texts()
    found = by_id(T.decode_pieces(T.encode_pieces(records(spark, texts), VOCABULARY), VOCABULARY))
    for k, text in enumerate(texts):
        assert found[k].piece_ids == library.encode(text)
        assert found[k].decoded_text == library.decode(found[k].piece_ids)
    assert by_id(T.encode_and_decode(records(spark, texts), VOCABULARY)) == found
    assert T.encode_and_decode(records(spark, []), VOCABULARY).count() == 0


def test_row_agenda_and_heap_agenda_agree():
    v = T.piece_codec(VOCABULARY).v
    pick = random.Random(3)
    for n in (2, 3, 9, 30):
        rows = v.letter[[[ord(pick.choice("▁thesnaion")) for _ in range(n)] for _ in range(50)]]
        for which, symbols in T.merged_rows(rows.copy(), v):
            for k, row in zip(which.tolist(), symbols.tolist()):
                assert T.merged_unit(rows[k].tolist(), v) == row


def test_texts_longer_than_a_block(library, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    codec = T.PieceCodec(VOCABULARY)
    texts = ["the station was empty " * 20, "", "x" * 100, "é", " ü" * 40]
    from stationflow.llm.arrays import texts_of
    import pyarrow as pa

    ids, counts = codec.encode(texts_of(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts)


def test_forgetting_units_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(T, "HELD_UNITS", 2)
    codec = T.PieceCodec(VOCABULARY)
    from stationflow.llm.arrays import texts_of
    import pyarrow as pa

    for text in ("one two three", "three two one", "one, two"):
        assert codec.encode(texts_of(pa.array([text])))[0].tolist() == library.encode(text)


def test_decoding_any_ids(spark, library):
    pick = random.Random(5)
    some = [0, 1, 2, 259, 38, 0xE5, 0x99, 0x84, 0xF3, 29871, 5000, 300, 0x23]
    rows = [(k, [pick.choice(some) for _ in range(pick.randint(0, 6))]) for k in range(800)]
    rows += [(900, None), (901, []), (None, [300])]
    df = spark.createDataFrame(rows, f"{ID} bigint, piece_ids array<int>")
    found = by_id(T.decode_pieces(df, VOCABULARY))
    for k, ids in rows:
        assert found[k].decoded_text == library.decode(ids or [])


def test_outside_ids_are_refused(spark):
    df = spark.createDataFrame([(1, [32_000])], f"{ID} bigint, piece_ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        T.decode_pieces(df, VOCABULARY).collect()


def test_a_difference_is_an_error(monkeypatch):
    codec = T.PieceCodec(VOCABULARY)
    monkeypatch.setattr(codec.v, "pair_rank", codec.v.pair_rank[::-1].copy())
    from stationflow.llm.arrays import texts_of
    import pyarrow as pa

    with pytest.raises(ValueError, match="disagree"):
        codec.encode(texts_of(pa.array(["the stations of the network are empty"])))


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(None, None, "x"), (1, None, "y"), (1, "a b", "z"), (1, "a b", "z")], f"{ID} bigint, raw_text string, piece_ids string"
    )
    found = T.encode_pieces(df, VOCABULARY)
    assert sorted(len(r.piece_ids) for r in found.collect()) == [0, 0, 2, 2]
    assert T.decode_pieces(T.encode_pieces(df.limit(0), VOCABULARY), VOCABULARY).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_query_equals_the_library(spark, library):
    found = by_id(QUERIES["op11_sentencepiece"](spark, FOLDER), "doc_id")
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "")
        assert found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
