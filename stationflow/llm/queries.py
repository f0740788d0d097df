"""The numbered queries: the test tables mapped to the operators' records, and results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.credential_scan import find_secrets
from stationflow.llm.decontamination import find_contamination
from stationflow.llm.language_model import IN_TRAINING, score_records
from stationflow.llm.ledger_repair import DETAIL, EVENT, NUMBER, TRIP, Kinds, repair_ledgers
from stationflow.llm.licence_scan import EQUIVALENT_WORDS, find_licences
from stationflow.llm.licence_texts import KNOWN_LICENCES
from stationflow.llm.near_duplicates import near_duplicate_groups
from stationflow.llm.packing import pack_records
from stationflow.llm.periodic_runs import READINGS, STATION, find_periodic_runs
from stationflow.llm.personal_data import find_personal_data
from stationflow.llm.quality_classifier import fit_quality_model, score_quality
from stationflow.llm.quality_rules import repetition_report
from stationflow.llm.records import ID, TEXT
from stationflow.llm.source_urls import UrlRule, judge_source_urls
from stationflow.llm.text_pieces import DECODED, PIECE_IDS, encode_and_decode
from stationflow.session import use_utc

# Results that hold hashes of spans, tokens, fingerprints or iterated scores have no SQL form; their
# queries are tested against brute force. SQL holds the others.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

URL_RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)


def query(name: str):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(use_utc(spark), folder)
        return fn

    return wrap


def as_records(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias(ID), F.col("text").alias(TEXT))


def records(spark: SparkSession, folder: str) -> DataFrame:
    return as_records(spark.read.parquet(f"{folder}/documents.parquet"))


def evaluation_items(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return benchmark.select("item_id", F.col("text").alias("item_text"))


def id_crc(column: str) -> Column:
    """CRC-32 of an id as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))


@query("op1_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(records(spark, folder)).withColumnRenamed(ID, "doc_id")


@query("op2_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_records(records(spark, folder)).withColumnsRenamed({ID: "doc_id", "record_tokens": "doc_tokens"})


@query("op3_url_filters")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge_source_urls(spark.read.parquet(f"{folder}/pages.parquet"), URL_RULES)


@query("op4_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_report(records(spark, folder)).withColumnRenamed(ID, "doc_id")


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = records(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias(ID), "quality")
    model = fit_quality_model(documents, labels.where(id_crc(ID) % 3 != 1))
    return score_quality(documents, model).select(
        F.col(ID).alias("doc_id"), (id_crc(ID) % 3 == 1).alias("held_out"), "score", "predicted"
    )


@query("op6_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(records(spark, folder), evaluation_items(spark, folder)).withColumnRenamed(ID, "doc_id")


@query("op7_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = records(spark, folder).withColumn(IN_TRAINING, id_crc(ID) % 7 != 2)
    return score_records(documents).withColumnRenamed(ID, "doc_id")


@query("op8_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(records(spark, folder)).withColumnRenamed(ID, "doc_id")


@query("op9_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(records(spark, folder)).withColumnRenamed(ID, "doc_id")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """DuckDB form of `licence_scan.canonical_text`."""
    mark = "regexp_matches(l, '^[^a-z]*(\\(c\\)[ \\t]|©)')"
    named = "regexp_matches(l, '^[^a-z]*copyright\\b') AND NOT regexp_matches(l, '^[^a-z]*copyright[ \\t]+(notice|holder|owner)')"
    kept = f"list_transform(string_split(lower({text}), chr(10)), lambda l: CASE WHEN {mark} OR ({named}) THEN '' ELSE l END)"
    plain = f"trim(regexp_replace(array_to_string({kept}, chr(10)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    words = " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in EQUIVALENT_WORDS)
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: CASE w {words} ELSE w END), ' ')"


SQL["op10_licences"] = (
    "WITH texts(licence_id, licence_text) AS (VALUES "
    + ", ".join(f"({_text(a)}, {_text(b)})" for a, b in KNOWN_LICENCES)
    + f"), known AS (SELECT sha256({_canonical_sql('licence_text')}) AS digest, min(licence_id) AS licence_id FROM texts GROUP BY 1),"
    f" plain AS (SELECT doc_id, {_canonical_sql('coalesce(text, chr(32))')} AS t FROM documents),"
    " digests AS (SELECT doc_id, CASE WHEN t <> '' THEN sha256(t) END AS digest FROM plain)"
    " SELECT doc_id, digests.digest, licence_id FROM digests LEFT JOIN known ON digests.digest = known.digest"
)


@query("op10_licences")
def licences(spark: SparkSession, folder: str) -> DataFrame:
    return find_licences(records(spark, folder)).withColumnRenamed(ID, "doc_id")


@query("op11_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = str(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_and_decode(records(spark, folder), vocabulary).select(
        F.col(ID).alias("doc_id"),
        F.size(PIECE_IDS).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(PIECE_IDS).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(DECODED, 256).alias("decoded_sha256"),
    )


def _damaged(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as events of ledgers, with the faults of the contract."""

    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(fault != 0).select(
        F.col("conv_id").alias(TRIP),
        F.col("turn").alias(NUMBER),
        F.when(fault == 4, "user").otherwise(known("role")).alias(EVENT),
        text.alias(DETAIL),
        F.explode(copies).alias("copy"),
    )


@query("op12_conversation_repair")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    found = repair_ledgers(_damaged(conversations), Kinds("system", "user", "assistant"))
    every = conversations.select(F.col("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col(TRIP)), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("source_record_hash", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _replayed(documents: DataFrame) -> DataFrame:
    """The words of each text as readings; the contract makes a tenth of the texts periodic."""
    h = id_crc("doc_id")
    words = documents.select(
        F.col("doc_id"),
        h.alias("h"),
        F.floor(h / 10).cast("bigint").alias("g"),
        F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
    )
    n = F.size("words")
    sized = words.withColumn("a", F.when((F.col("h") % 10 == 0) & (n > 0), F.col("g") % n).cast("int"))
    period = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    tail = F.slice("words", F.col("a") + 1, period)
    again = F.flatten(F.array_repeat(tail, F.ceil((n - F.col("a")) / period).cast("int")))
    replayed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), n - F.col("a")))
    return sized.select(F.col("doc_id").alias(STATION), F.when(F.col("a").isNull(), F.col("words")).otherwise(replayed).alias(READINGS))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_periodic_runs(_replayed(spark.read.parquet(f"{folder}/documents.parquet")))
    first = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    ranked = found.withColumn("longest", first)
    return ranked.select(
        F.col(STATION).alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.short")).alias("period"),
        F.expr("1000 * longest.length div -longest.short").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.array_join("collapsed", " "), 256).alias("collapsed_sha256"),
    )
