"""Licences of source records by the digest of their canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.licence_texts import KNOWN_LICENCES
from stationflow.llm.records import ID, TEXT, source_records

# Spellings that licence matching treats as equal, as (written, canonical).
EQUIVALENT_WORDS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# A line that begins with a copyright mark, but for the rules that speak of a copyright notice.
_COPYRIGHT_LINE = r"(?md)^[^a-z\n]*(?:copyright\b(?![ \t]+(?:notice|holder|owner))|\(c\)[ \t]|©)[^\n]*$"
_PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical_text(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation as single spaces, spellings unified."""
    lines = F.lower(text)
    has_notice = lines.contains("copyright") | lines.contains("(c)") | lines.contains("©")
    lines = F.when(has_notice, F.regexp_replace(lines, _COPYRIGHT_LINE, "")).otherwise(lines)
    plain = F.trim(F.regexp_replace(lines, _PUNCTUATION, " "))
    words = dict(EQUIVALENT_WORDS)
    pattern = r"\b(?:" + "|".join(words) + r")\b"
    pairs = F.create_map(*[F.lit(x) for pair in EQUIVALENT_WORDS for x in pair])
    unified = F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " ")
    return F.when(plain.rlike(pattern), unified).otherwise(plain)


def canonical_digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null where nothing is left of it."""
    plain = canonical_text(text)
    return F.when(plain != "", F.sha2(plain, 256))


def licence_digests(licences: DataFrame) -> DataFrame:
    """(digest, licence_id) of known licence texts (licence_id, licence_text); the least id wins a tie."""
    return (
        licences.select(canonical_digest(F.col("licence_text")).alias("digest"), "licence_id")
        .where("digest IS NOT NULL AND licence_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("licence_id").alias("licence_id"))
    )


def find_licences(records: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """Which known licence, if any, the whole `raw_text` of each source record is.

    Case, punctuation, white space, copyright lines and equivalent spellings are normalised away, and
    the SHA-256 of what remains is joined to the digests of `licences` (`licence_id`, `licence_text`;
    by default the texts and notices of `licence_texts`). A provider's licence files and notices are
    records like any other.

    One row per record: `source_record_id`, `digest` (null for a text without letters or digits, and
    for a null text), `licence_id` (null if unknown). Only digests meet in the join, never texts; the
    known side is one row per licence. Repeated records each get their row; an empty table gives an
    empty result.
    """
    df = source_records(records)
    if licences is None:
        licences = df.sparkSession.createDataFrame(list(KNOWN_LICENCES), "licence_id string, licence_text string")
    digests = df.select(ID, canonical_digest(F.col(TEXT)).alias("digest"))
    return digests.join(licence_digests(licences), "digest", "left").select(ID, "digest", "licence_id")
