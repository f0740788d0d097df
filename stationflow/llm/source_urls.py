"""Which source URLs to fetch: stated rules, then trust and distrust over the host graph."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.storage import stored


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block


DAMPING = 0.85
ROUNDS = 12
ROUNDS_PER_TABLE = 4
THRESHOLD = 0.0

_LINK = r"""(?i)\b(?:href|src|cite|action)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _best_rule(rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits `host` and `path`, as struct(rule, verdict); null if none does."""
    host, path = F.col("host"), F.col("path")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        best = F.when(fits, value).otherwise(best)
    return best


def host_links(pages: DataFrame) -> DataFrame:
    """(source_host, target_host, weight): absolute links between different hosts, counted.

    One row per pair of hosts after a map-side sum, whatever the number of pages of a host.
    """
    targets = F.array_distinct(
        F.transform(
            F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1)),
            lambda u: url_host(F.concat(F.lit("x:"), F.regexp_replace(u, r"^(?i:https?:)?//", "//"))),
        )
    )
    return (
        pages.select(url_host(F.col("url")).alias("source_host"), F.explode(targets).alias("target_host"))
        .where("source_host <> '' AND target_host <> '' AND source_host <> target_host")
        .groupBy("source_host", "target_host")
        .agg(F.count("*").alias("weight"))
    )


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): personalised PageRank of `edges` (source_host, target_host, weight) from `seeds` (host, seed).

    Seed weights are divided by their sum. Every round passes `damping` of each host's score along its
    links by weight and adds the rest from the seeds; the score of a host without links ends there.
    Hosts are joined and summed in Spark; a host's many incoming links are summed before the shuffle.
    Every few rounds are written to the shared folder.
    """
    total = seeds.agg(F.sum("seed")).first()[0] or 1.0
    start = stored(
        seeds.groupBy("host").agg((F.sum("seed") / total).alias("seed")), "seeds"
    )
    out_weight = edges.groupBy("source_host").agg(F.sum("weight").alias("out"))
    steps = stored(
        edges.join(out_weight, "source_host").select(
            F.col("source_host").alias("host"), "target_host", (F.col("weight") / F.col("out")).alias("step")
        ),
        "host-steps",
    )
    base = start.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    score = start.withColumnRenamed("seed", "score")
    for done in range(1, rounds + 1):
        passed = score.join(steps, "host").select(
            F.col("target_host").alias("host"), (F.col("score") * F.col("step") * damping).alias("score")
        )
        score = passed.unionByName(base).groupBy("host").agg(F.sum("score").alias("score"))
        if done % ROUNDS_PER_TABLE == 0 or done == rounds:
            score = stored(score, "host-scores")
    return score


def judge_source_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    threshold: float = THRESHOLD,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Allow or block the `url` of each page of a provider's portal (`page_id`, `url`, `html`).

    The project keeps the URLs of its sources but no crawled pages, so the pages are a general record
    here. The longest rule whose host is the URL's host or a parent of it, and whose path begins the
    URL's path, decides. For other URLs the host decides: trust spreads from hosts with allowed URLs
    along links, distrust from hosts with blocked URLs against them, each as a personalised PageRank
    over the host graph, seeds weighted by their pages. A host with trust - distrust below `threshold`
    is blocked; unknown hosts have zero of both.

    One row per page: `page_id`, `host`, `path`, `rule` (host and path, null if none), `verdict`,
    `trust`, `distrust`. A null URL, or one without `://`, has an empty host and path and is allowed
    at the default threshold. Repeated pages each get their row; an empty table gives an empty result. Built from
    DataFrame functions only; pages never shuffle, host scores are joined by their measured size.
    """
    judged = pages.select(
        F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    ).withColumn("best", _best_rule(rules))
    seeds = stored(
        judged.where("best IS NOT NULL AND host <> ''")
        .groupBy("host")
        .agg(
            F.count_if(F.col("best.verdict") == "allow").cast("double").alias("allowed"),
            F.count_if(F.col("best.verdict") == "block").cast("double").alias("blocked"),
        ),
        "rule-hosts",
    )
    edges = stored(host_links(pages), "host-links")
    back = edges.select(F.col("target_host").alias("source_host"), F.col("source_host").alias("target_host"), "weight")
    trusted = seeds.where("allowed > 0").select("host", F.col("allowed").alias("seed"))
    blocked = seeds.where("blocked > 0").select("host", F.col("blocked").alias("seed"))
    trust = propagated(trusted, edges, damping, rounds).withColumnRenamed("score", "trust")
    distrust = propagated(blocked, back, damping, rounds).withColumnRenamed("score", "distrust")
    scores = trust.join(distrust, "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
    none = F.lit(0.0)
    by_host = F.when(F.coalesce("trust", none) - F.coalesce("distrust", none) < threshold, "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), by_host).alias("verdict"),
        F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"),
    )
