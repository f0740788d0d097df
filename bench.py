"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Every query runs into the `noop`
sink, so all rows and columns are produced; a short warm-up query starts the engine first. The
`models` entry times the stored feature table once, then fit and prediction of each family apart.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stationflow.operators import models  # noqa: E402
from stationflow.plans.bindings import Tables  # noqa: E402
from stationflow.plans.catalog import QUERIES  # noqa: E402
from stationflow.plans.model_queries import model_split  # noqa: E402
from stationflow.session import build_session  # noqa: E402

HEADLINE = (
    "station_hour_counts",
    "ingestion_quality",
    "legacy_station_hours",
    "independent_recount",
    "canonical_demand",
    "content_digest",
    "store_comparison",
    "profile_by_hour",
    "coverage_summary",
    "station_ranking",
    "hourly_series",
    "station_coverage",
    "station_delta_statistics",
    "dense_panel",
    "feature_table",
    "observation_dataset",
    "dataset_validation",
    "common_population",
    "monthly_diagnostics",
    "matched_rain_effect",
    "agreed_samples",
    "extreme_summary",
    "station_occupancy",
    "empty_runs",
    "gap_statistics",
    "mapped_csv_trips",
    "snapshot_lines",
    "versioned_publication",
    "ridge_model",
    "tree_model",
)


def model_seconds(spark, folder: str) -> dict:
    """Seconds for the features, and for fit and prediction of each model family, with row counts."""
    start = time.perf_counter()
    split = model_split(Tables(spark, folder)).cache()
    rows = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    found = {"features": round(time.perf_counter() - start, 3), "rows": rows}
    for candidate in models.FITTED_CANDIDATES:
        start = time.perf_counter()
        model = models.fit(candidate, split)
        fitted = time.perf_counter()
        models.predict(model, split).write.format("noop").mode("overwrite").save()
        done = time.perf_counter()
        found[candidate.kind] = {"fit": round(fitted - start, 3), "predict": round(done - fitted, 3)}
        print(f"{found[candidate.kind]} {candidate.kind}", file=sys.stderr, flush=True)
    split.unpersist()
    return found


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in sys.argv[1:] if n != "models"] if sys.argv[1:] else HEADLINE
    QUERIES["profile_by_hour"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    fits = model_seconds(spark, folder) if not sys.argv[1:] or "models" in sys.argv[1:] else {}
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "models": fits,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
