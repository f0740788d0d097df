from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
from record_tables import by_id, records

from stationflow.llm.personal_data import KINDS, Field, added_spans, base_spans, find_personal_data, fit_field

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(RULES[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x.y", "_", "%", "-", ".", " ", "1", "25", "256", "0", "+1", "(555)", "4111111111111111",
             "4111 1111 1111 1111", "10.0.0.1", "+34 600 123 456", "é", "\n", "x@y.z_q@w.e"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 18))) for _ in range(600)]
    return [None, "", "@", "a@b.co_x@d.ef", "+" * 50, "9" * 300, "a" * 5000 + "@", *made]


def test_base_against_the_stated_patterns(spark):
    for text in texts():
        assert sorted(base_spans(text or "")) == brute(text or ""), text
    found = by_id(find_personal_data(records(spark, texts())))
    for i, text in enumerate(texts()):
        expected = brute(text or "")
        assert (found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone) == tuple(
            sum(k == n for _, k, _ in expected) for n in range(4)
        )
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in expected)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(found[i].spans.split(","))


def test_labels_spread_to_repetitions(spark):
    filler = [f"Station {i} had {i * 7} trips on day {i % 28}." for i in range(40)]
    phones = [f"Call +34 600 123 {100 + i} at night. Dock {i} is full. Again: 600 123 {100 + i} now." for i in range(60)]
    mails = [f"Write to user{i}name.{i}@mail.example.com or ask for user{i}name.{i} there, bike {i}." for i in range(60)]
    train = records(spark, filler + phones + mails)
    field = fit_field(train)
    text = "Mail rider77abc.12@mail.example.com today. The name rider77abc.12 is known. Bike 44 is not."
    base = base_spans(text)
    more = added_spans(text, base, field)
    assert [text[s:e] for s, k, e in more if KINDS[k] == "email"] == ["rider77abc.12"]
    assert added_spans("Bike 44 left dock 12 at 10.", [], field) == []


def rider_texts(rng, n):
    """(text, repeated part) pairs: an e-mail, phone, address or card and, some words later, its part without marks."""
    out = []
    for i in range(n):
        name = f"rider{rng.randrange(1000, 10**6)}.k{rng.randrange(10, 99)}"
        phone = f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        address = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        whole, part = [(f"{name}@mail{i % 7}.example.com", name), (f"+34-{phone}", phone), (address, address)][i % 3]
        noise = " ".join(f"dock {rng.randrange(60)} had {rng.randrange(10**6)} trips" for _ in range(rng.randrange(1, 6)))
        out.append((f"Contact {whole} today. {noise}. Order {rng.randrange(10**15, 10**16)} stays. ", part))
    return out


def test_hidden_repetitions_are_recalled(spark):
    rng = random.Random(21)
    field = fit_field(records(spark, [t for t, _ in rider_texts(rng, 600)]))
    assert all(field.skip[k, k] > 0 for k in (1, 2, 4)) and np.allclose(field.skip, field.skip.T)
    found = extra = 0
    fresh = rider_texts(rng, 300)
    for text, part in fresh:
        whole = f"{text}Later {part} came back with bike {rng.randrange(3000)}."
        at = whole.rindex(part)
        spans = [(s, e) for s, _, e in [*base_spans(whole), *added_spans(whole, base_spans(whole), field)]]
        found += any(s < at + len(part) and at < e for s, e in spans)
        extra += len(added_spans(text, base_spans(text), field))
    assert found >= 0.9 * len(fresh)
    assert extra <= 0.05 * len(fresh)


def test_texts_without_a_fixed_form_pass_through_the_field(spark):
    k = len(KINDS) + 1
    unary = np.zeros((4096, k))
    unary[:, 4] = 5.0
    found = by_id(find_personal_data(records(spark, ["ask 555-1234 there"]), Field(unary, np.zeros((k, k)), np.zeros((k, k)))))
    assert found[0].spans == "phone:4:12" and found[0].n_phone == 0


def test_megabytes_take_time_in_proportion(spark):
    field = fit_field(records(spark, [t for t, _ in rider_texts(random.Random(5), 90)]))
    unit = "the dock of the station was empty all night and nobody came by, " * 4 + "mail a.rider7@x.example.com or +34 600 123 456. "
    seconds = []
    for size in (1_250_000, 5_000_000):
        text = unit * (size // len(unit))
        began = time.perf_counter()
        base = base_spans(text)
        assert len(base) == 2 * (size // len(unit))
        added_spans(text, base, field)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 10 * seconds[0]


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    k = len(KINDS) + 1
    field = Field(rng.normal(size=(4096, k)), rng.normal(size=(k, k)), np.zeros((k, k)))

    class Chain:
        word, base, chain = ["1a", "2b", "3c"], np.zeros(3, int), [(0, 1), (1, 2)]

        def features(self):
            return [[1, 2], [3], [4, 5]]

        def skips(self):
            return []

    p = field.marginals(Chain(), rounds=60)
    score = [field.unary[f].sum(axis=0) for f in Chain().features()]
    joint = np.exp(
        score[0][:, None, None] + score[1][None, :, None] + score[2][None, None, :]
        + field.chain[:, :, None] + field.chain[None, :, :]
    )
    joint /= joint.sum()
    for n, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        assert np.allclose(p[n], joint.sum(axis=axes), atol=1e-3)


def test_without_training_records(spark):
    assert not fit_field(records(spark, ["no data", None])).unary.any()
