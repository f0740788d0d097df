from __future__ import annotations

import random

import pytest
from record_tables import WORD, by_id, records

from stationflow.llm.quality_rules import LINE_LIMIT, MIN_REPEATED_CHARS, NGRAM_LIMITS, good_records, repetition_report


def brute(text):
    words = [(m.start(), m[0]) for m in WORD.finditer(text)]
    n = len(words)

    def covered(size, skipped=0):
        seen = {}
        for i in range(n - size + 1):
            seen.setdefault(tuple(w for _, w in words[i : i + size]), []).append(i)
        return {j for at in seen.values() if len(at) > 1 for i in at[skipped:] for j in range(i, i + size)}

    def over(repeated, limit):
        return repeated / max(chars, 1) / limit if repeated >= MIN_REPEATED_CHARS else 0

    chars = sum(len(w) for _, w in words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    in_lines, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            in_lines += sum(len(w) for w in WORD.findall(line))
        seen.add(line)
    worst = max(
        [over(sum(len(words[j][1]) for j in covered(k, 1)), limit) for k, limit in NGRAM_LIMITS.items()]
        + [over(in_lines, LINE_LIMIT)]
    )
    repeats = len(covered(8))
    failed = n < 20 or 100 * repeats > 30 * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats,
        "base_failed": failed, "kept": not failed and worst <= 1, "worst_ratio": round(worst, 9),
    }


def texts():
    rng = random.Random(5)
    out = [None, "", "  \n\t ", "one", "a\nb\na\n\n\nb", "é\u00a0è# \x1c x|\x85", "line\n" * 40, "x " * 300]
    for _ in range(60):
        vocabulary = [f"w{i}é" if i % 3 else f"W{i}#" for i in range(rng.choice([3, 20, 400]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for w in words)
        out.append(text + (text[: rng.randrange(len(text) + 1)] if rng.random() < 0.4 else ""))
    return out


def test_against_brute_force(spark):
    found = by_id(repetition_report(records(spark, texts())))
    for i, text in enumerate(texts()):
        row = found[i].asDict()
        row["worst_ratio"] = round(row["worst_ratio"], 9)
        expected = brute(text or "")
        assert {k: row[k] for k in expected} == expected, text


def test_good_records_are_the_kept_ones(spark):
    df = records(spark, texts())
    kept = {r[0] for r in repetition_report(df).where("kept").select("source_record_id").collect()}
    assert {r[0] for r in good_records(df).collect()} == kept


def with_copies(n, share, total=1500):
    """Words of 8 letters: passages of n words that occur twice, `share` of all words being copies."""
    copies = int(share * total) // n
    fresh = iter(f"w{i:07d}" for i in range(total))
    passages = [[next(fresh) for _ in range(n)] for _ in range(copies)]
    words = [w for p in passages for w in [*p, next(fresh)]]
    for p in passages:
        words += [*p, next(fresh)]
    return " ".join([*words, *(next(fresh) for _ in range(total - len(words)))])


@pytest.mark.parametrize("n", sorted(NGRAM_LIMITS))
def test_each_length_decides_of_its_own(spark, n):
    # Just over the limit of n words and under that of n - 1; longer ones do not occur twice.
    text = with_copies(n, NGRAM_LIMITS[n] + 0.009)
    others = {k: v for k, v in NGRAM_LIMITS.items() if k != n}
    assert not repetition_report(records(spark, [text])).first().kept
    assert repetition_report(records(spark, [text]), ngram_limits=others).first().kept


def test_lines_decide_of_their_own(spark):
    # Four words a line are too few for any n-gram to lie in one line, and no two lines follow each other twice.
    lines = [f"a{i:05d} b{i:05d} c{i:05d} d{i:05d}" for i in range(100)]
    text = "\n".join([*lines, *(f"{x}\nz{i:05d}" for i, x in enumerate(lines[:40]))])
    report = repetition_report(records(spark, [text])).first()
    assert report.line_coverage > LINE_LIMIT and not report.kept
    assert repetition_report(records(spark, [text]), line_limit=1.0).first().kept


def test_one_repeated_sentence_is_no_fault_of_a_short_text(spark):
    words = [f"word{i}" for i in range(80)]
    text = " ".join([*words, "\n", *words[:12]])
    assert repetition_report(records(spark, [text])).first().kept
    assert not repetition_report(records(spark, [text]), min_repeated_chars=0).first().kept
