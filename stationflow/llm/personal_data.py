"""Personal data in source records: fixed forms, made consistent by a skip-chain random field."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.records import ID, TEXT, map_records, source_records
from stationflow.llm.spans import Span, digest, joined, rows_matching
from stationflow.llm.storage import stored

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
TRAINING_RECORDS = 2000
FEATURES = 4096
MIN_PROBABILITY = 0.9
SKIP_PENALTY = 0.005  # on squared skip potentials, against the mean log-likelihood
ROUNDS = 10

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TOKEN = re.compile(r"[^ \t-\r]+")
_NOT_ALNUM = re.compile(r"[^0-9A-Za-z]+")
_HAS_CANDIDATE = r"[0-9@]"


def _emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping; each `@` is looked at once, so long runs stay linear."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            # No part of a local part holds an `@`, so what lies before it cannot begin a match.
            done, at = at + 1, text.find("@", at + 1)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed forms, leftmost and non-overlapping per kind; failing matches are dropped."""
    found = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


class Nodes:
    """The candidate tokens of one text: those with a digit or `@`, in order."""

    def __init__(self, text: str, base: list[Span]):
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        keep = [i for i, (s, e) in enumerate(tokens) if re.search("[0-9@]", text[s:e])]
        self.span = [tokens[i] for i in keep]
        self.word = [text[s:e] for s, e in self.span]
        self.core = [_NOT_ALNUM.sub("", w).lower() for w in self.word]
        self.near = [
            (text[slice(*tokens[i - 1])].lower() if i else "", text[slice(*tokens[i + 1])].lower() if i + 1 < len(tokens) else "")
            for i in keep
        ]
        self.chain = [(n, n + 1) for n in range(len(keep) - 1) if keep[n + 1] == keep[n] + 1]
        # Tokens are disjoint and in order, so those that a span touches are neighbours.
        label = np.zeros(len(keep), np.int64)
        starts, ends = [s for s, _ in self.span], [e for _, e in self.span]
        for s, k, e in base:
            label[bisect_right(ends, s) : bisect_left(starts, e)] = k + 1
        self.base = label

    def features(self, words: list[str] | None = None) -> list[list[int]]:
        """Hashed features of each node: length, character classes, digits, neighbours; never the word itself.

        `words` stand in for the nodes' own ones.
        """
        out = []
        for word, (before, after) in zip(words or self.word, self.near, strict=True):
            digits = sum(c.isdigit() for c in word)
            shape = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", word)))
            sizes = re.sub("[0-9]+", lambda m: str(len(m[0])), re.sub("[^0-9]+", ".", word))
            number = re.sub("[ -]", "", word.strip(".,;:!?)(\"'"))
            checked = 14 <= digits <= 19 and number.isdecimal() and number.isascii()
            names = (
                "bias", f"checksum {_luhn(number) if checked else None}", f"shape {shape}", f"sizes {sizes}", f"digits {min(digits, 20)}", f"length {min(len(word), 30)}",
                f"share {10 * digits // len(word)}", f"before {before}", f"after {after}",
                *(f"has {c}" for c in "@+.-()/:=%" if c in word),
            )
            out.append([xxhash.xxh32_intdigest(x) % FEATURES for x in names])
        return out

    def masked(self) -> list[str]:
        """The words without what marks a fixed form: an e-mail's host, a phone's plus sign."""
        return [w.split("@")[0].strip("+(<[\"'") or w for w in self.word]

    def skips(self) -> list[tuple[int, int]]:
        """Edges between distant tokens that are equal up to punctuation, or share their long digit or name part.

        Each token is joined to the one before it with the same part, so a part seen m times has m - 1 edges.
        """
        last: dict[str, int] = {}
        edges = set()
        for n, (word, core) in enumerate(zip(self.word, self.core, strict=True)):
            parts = {core, _NOT_ALNUM.sub("", word.split("@")[0]).lower(), *(p for p in re.split(r"[^0-9A-Za-z]+", word.lower()) if len(p) >= 6)}
            digits = re.sub("[^0-9]", "", word)
            if len(digits) >= 7:
                parts |= {digits, digits[-7:]}
            for part in parts:
                if len(part) < 4:
                    continue
                if part in last and last[part] != n:
                    edges.add((last[part], n))
                last[part] = n
        return sorted(edges)


class Field:
    """Weights of the random field: node features, chain and skip potentials (log scale)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, nodes: Nodes, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy message passing on the graph of one text; nodes in base spans are observed."""
        n, k = len(nodes.word), len(LABELS)
        score = np.array([self.unary[f].sum(axis=0) for f in nodes.features()])
        known = np.flatnonzero(nodes.base)
        score[known] = -50.0
        score[known, nodes.base[known]] = 0.0
        skips = nodes.skips()
        edges = np.array(nodes.chain + skips, np.int64).reshape(-1, 2)
        if not len(edges):
            return _normal(score)
        kinds = np.array([0] * len(nodes.chain) + [1] * len(skips))
        forward = np.array([self.chain, self.skip])[kinds]
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([forward, forward.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), k))
        for _ in range(rounds):
            belief = score.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + table
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - message).max() < 1e-4:
                message = new
                break
            message = 0.5 * message + 0.5 * new
        belief = score.copy()
        np.add.at(belief, target, message)
        return _normal(belief)


def _normal(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


_TRAINING = (
    "order_key bigint, features array<int>, sizes array<int>, labels array<int>, chain array<int>, skip array<int>,"
    " hidden array<int>, hidden_sizes array<int>, hidden_labels array<int>"
)


def _training_rows(part: pa.RecordBatch) -> pa.RecordBatch | None:
    """Of each record with a candidate token: node features and labels, label pairs of chain edges, skip edges, and
    the features that the nodes in base spans have once their marks are hidden."""
    column = part.column(TEXT)
    rows = []
    for i in rows_matching(column, _HAS_CANDIDATE).tolist():
        text = column[i].as_py()
        nodes = Nodes(text, base_spans(text))
        label, skips = nodes.base.copy(), nodes.skips()
        for a, b in skips:  # what repeats a fixed form may well be the same: it has no label
            if (nodes.base[a] > 0) != (nodes.base[b] > 0):
                label[b if nodes.base[a] else a] = -1
        chain = [(int(label[a]), int(label[b])) for a, b in nodes.chain if label[a] >= 0 and label[b] >= 0]
        skip = [(a, b) for a, b in skips if label[a] >= 0 and label[b] >= 0]
        features, masked = nodes.features(), nodes.features(nodes.masked())
        hidden = np.flatnonzero(nodes.base).tolist()
        rows.append((
            xxhash.xxh64_intdigest(text.encode()) >> 1,
            [x for f in features for x in f], [len(f) for f in features], label.tolist(),
            [x for p in chain for x in p], [x for p in skip for x in p],
            [x for n in hidden for x in masked[n]], [len(masked[n]) for n in hidden], nodes.base[hidden].tolist(),
        ))
    if not rows:
        return None
    columns = list(zip(*rows, strict=True))
    kind = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), *(pa.array(c, kind) for c in columns[1:])],
        [f.split()[0] for f in _TRAINING.split(", ")],
    )


def _sums(unary: np.ndarray, features: list[int], sizes: list[int]) -> np.ndarray:
    """Score of each node: the sum of its features' weights."""
    out = np.zeros((len(sizes), unary.shape[1]))
    np.add.at(out, np.repeat(np.arange(len(sizes)), sizes), unary[features])
    return out


def _skip_potentials(score: np.ndarray, beside: np.ndarray, label: np.ndarray, steps: int) -> np.ndarray:
    """Symmetric potentials that make `label` likeliest, given node scores and the counts of labels across skip edges."""
    k = score.shape[1]
    table, step, truth = np.zeros((k, k)), np.zeros((k, k)), np.eye(k)[label]
    if not len(label):
        return table
    # Kinds weigh alike, however rare.
    weight = 1.0 / np.bincount(label, minlength=k)[label]
    weight /= weight.sum()
    for _ in range(steps):
        gap = (truth - _normal(score + beside @ table)) * weight[:, None]
        slope = beside.T @ gap
        slope = (slope + slope.T) / 2 - SKIP_PENALTY * table / k**2
        step += slope**2
        table += 0.5 * slope / (np.sqrt(step) + 1e-8)
    return table


def fit_field(records: DataFrame, max_records: int = TRAINING_RECORDS, steps: int = 300) -> Field:
    """Train the field on records with a digit or `@`, the kinds of fixed forms being the labels.

    Piecewise training. Node weights come from a multinomial logistic regression, chain potentials are
    smoothed log ratios of label pairs over independence. Skip potentials are learned on hidden fixed
    forms: each is met again without what marks it (an e-mail without its host, a phone without its plus
    sign), beside itself as it was, and the potentials must outweigh what its node alone says; tokens
    that repeat other tokens are the counterpart. Tokens outside a fixed form are `other`, but those
    with a skip edge to one are left unlabelled. At most `max_records` distinct texts are used, those
    with the smallest hash of the text. Without any such record all weights are zero.
    """
    df = source_records(records).where(F.col(TEXT).rlike(_HAS_CANDIDATE))
    # Copies hold the same key: one of each is enough. Keys are chosen first, rows once after.
    rows = stored(map_records(df, _training_rows, _TRAINING), "field-training")
    keys = rows.select("order_key").distinct().orderBy("order_key").limit(max_records)
    sample = rows.join(F.broadcast(keys), "order_key").dropDuplicates(["order_key"]).collect()
    sample.sort(key=lambda r: r["order_key"])
    k = len(LABELS)
    unary, chain = np.zeros((FEATURES, k)), np.ones((k, k))
    if not sample:
        return Field(unary, np.zeros((k, k)), np.zeros((k, k)))
    feature, sizes, y = [], [], []
    for row in sample:
        known = np.array(row["labels"]) >= 0
        feature += np.array(row["features"])[np.repeat(known, row["sizes"])].tolist()
        sizes += np.array(row["sizes"])[known].tolist()
        y += np.array(row["labels"])[known].tolist()
        np.add.at(chain, tuple(np.array(row["chain"], np.int64).reshape(-1, 2).T), 1)
    truth, owner, feature = np.eye(k)[y], np.repeat(np.arange(len(y)), sizes), np.array(feature)
    step = np.zeros_like(unary)
    for _ in range(steps):
        gap = (truth - _normal(_sums(unary, feature, sizes))) / len(y)
        slope = np.zeros_like(unary)
        np.add.at(slope, feature, gap[owner])
        slope -= 1e-4 * unary
        step += slope**2
        unary += 0.5 * slope / (np.sqrt(step) + 1e-8)
    p = chain / chain.sum()
    ratio = np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)))

    score, beside, label = [np.zeros((0, k))], [np.zeros((0, k))], []
    for row in sample:
        if row["skip"]:
            a, b = np.array(row["skip"], np.int64).reshape(-1, 2).T
            of, near = np.zeros((len(row["labels"]), k)), np.array(row["labels"])
            np.add.at(of, (a, near[b]), 1)
            np.add.at(of, (b, near[a]), 1)
            used = np.unique(np.concatenate([a, b]))
            score.append(_sums(unary, row["features"], row["sizes"])[used])
            beside.append(of[used])
            label += near[used].tolist()
        if row["hidden"]:
            score.append(_sums(unary, row["hidden"], row["hidden_sizes"]))
            beside.append(np.eye(k)[row["hidden_labels"]])
            label += row["hidden_labels"]
    skip = _skip_potentials(np.concatenate(score), np.concatenate(beside), np.array(label, np.int64), 3 * steps)
    return Field(unary, ratio, skip)


def added_spans(text: str, base: list[Span], field: Field, least: float = MIN_PROBABILITY) -> list[Span]:
    """Tokens outside base spans that the field gives a kind, joined where neighbours agree."""
    nodes = Nodes(text, base)
    if not nodes.word:
        return []
    p = field.marginals(nodes)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    linked = set(nodes.chain)
    previous = -1
    for n in range(len(nodes.word)):
        kind = int(p[n].argmax())
        if kind == 0 or nodes.base[n] or p[n, kind] < least:
            continue
        start, end = nodes.span[n]
        while end > start and text[end - 1] in ".,;:!?)\"'":
            end -= 1
        if previous == n - 1 and (previous, n) in linked and found[kind] and found[kind][-1][1] <= start and p[previous].argmax() == kind and not nodes.base[previous]:
            found[kind][-1] = (found[kind][-1][0], end)
        elif end > start:
            found[kind].append((start, end))
        previous = n
    return [(s, k - 1, e) for k, spans in found.items() for s, e in spans]


def _scan(part: pa.RecordBatch, field: Field, least: float) -> pa.RecordBatch:
    column = part.column(TEXT)
    rows: list[tuple] = [(0, 0, 0, 0, "", "")] * part.num_rows
    for i in rows_matching(column, _HAS_CANDIDATE).tolist():
        text = column[i].as_py()
        base = base_spans(text)
        kinds = [k for _, k, _ in base]
        more = added_spans(text, base, field, least)
        rows[i] = (*(kinds.count(k) for k in range(4)), joined(base, KINDS), joined(base + more, KINDS))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [part.column(ID), *(pa.array(c, pa.int64()) for c in columns[:4]),
         pa.array([digest(x) for x in columns[4]]), pa.array(columns[5], pa.string())],
        ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    )


def find_personal_data(
    records: DataFrame, field: Field | None = None, min_probability: float = MIN_PROBABILITY
) -> DataFrame:
    """Personal data in the `raw_text` of source records: e-mail, IP address, payment card, phone.

    Fixed forms come first. In every text a skip-chain conditional random field labels the tokens
    with a digit or `@`: neighbouring tokens share chain potentials, distant tokens that
    repeat or resemble each other share skip potentials, fixed forms are observed, and loopy message
    passing carries their labels to the repetitions (a phone number without its prefix, a user name
    without its host). Tokens with a kind at `min_probability` or more add a span; base spans stay.
    `field` is fitted on the same records if not given (`fit_field`).

    One row per record, without a shuffle of texts: `source_record_id`, `n_email`, `n_ip`, `n_card`,
    `n_phone`, `base_sha256` (of the fixed forms), `spans` (`kind:start:end`, all). A null or empty text
    has no spans; repeated records each get their row; an empty table gives an empty result.
    """
    df = source_records(records)
    kind = df.schema[ID].dataType.simpleString()
    return map_records(
        df,
        functools.partial(_scan, field=field or fit_field(records), least=min_probability),
        f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    ).withColumnRenamed("id", ID)
