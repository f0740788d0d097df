from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from record_tables import records

from stationflow.llm.packing import pack_records, pack_shard

WINDOW = 2048


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, encode):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.source_record_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids, at = encode(text), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.record_tokens == len(ids) and r.length > 0
            raw = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= WINDOW and at & (at - 1) == 0


def test_every_token_once(spark, encode):
    rng = random.Random(2)
    parts = ["station", "Demand", "é.", "don't", "42!", "\n", "  ", "…x", "<|endoftext|>", "<|EndOfText|>", "tha,t", "na\u00efve;"]
    texts = [None, "", " ".join(["long"] * 5000), "x" * 9000]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    df = records(spark, texts)
    check(pack_records(df).collect(), texts, encode)
    check(pack_records(df, records_per_shard=7).collect(), texts, encode)


def test_neighbours_share_a_window():
    topics = [np.full(100, t, np.uint16) + np.arange(100, dtype=np.uint16) % 5 for t in (100, 200, 300) for _ in range(10)]
    order = [i for k in range(10) for i in (k, 10 + k, 20 + k)]
    ids = [topics[i] for i in order]
    for sequence in pack_shard(ids, 512)[:3]:
        assert len({int(ids[d][0]) for d, _, _ in sequence[:5]}) == 1
    assert pack_shard([], 512) == []
