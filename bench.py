"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Every query runs BENCH_RUNS times, after one run of another
query has warmed the session up; its figure is the best, as a warm service would have it. Results are fully computed, and written nowhere.
calibration_seconds is a fixed piece of work on the same cores, before and after all else: machines differ, and so do
hours on one machine, so rounds compare by the ratio to it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "tokenize_v1",
    "stopword_filter",
    "field_postings",
    "extract_sections",
    "postings",
    "postings_positions",
    "lexicon_terms",
    "lexicon_wordid",
    "forward_index",
    "posting_offsets",
    "porter_stem_terms",
    "search_single",
    "search_multi_and",
    "search_multi_actual_tf",
    "search_semantic_or",
    "suggest_with_freq",
    "trie_node_count",
    "barrel_stats",
    "percentile_nearest",
)
#: On an index that is written once, as a search service would have it.
SERVED = ("served_search_multi", "served_search_bounded", "served_suggest", "served_suggest_by_range")


def session(cpus: str) -> SparkSession:
    found = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    return found


def timed(run) -> float:  # noqa: ANN001
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def calibration(spark: SparkSession) -> float:
    """Best of three of hashing and summing a fixed number of rows."""
    run = lambda: spark.range(0, 200_000_000, 1, 64).selectExpr("sum(xxhash64(id, id * 31) % 1000)")
    return min(timed(run) for _ in range(3))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    import tempfile

    from quillstack.operators import index, search, suggest
    from quillstack.plans import catalog

    chosen = {n: (lambda f=catalog.QUERIES[n]: f(spark, sf_dir)) for n in HEADLINE}
    seconds: dict[str, float] = {}
    timed(chosen["search_multi_and"])
    calibrated = [calibration(spark)]
    with tempfile.TemporaryDirectory() as at:
        began = time.perf_counter()
        catalog.whole_index(spark, sf_dir, positions=True).write(f"{at}/index")
        seconds["build_and_write_index"] = time.perf_counter() - began
        loaded = index.Index.load(spark, f"{at}/index")
        chosen["served_search_multi"] = lambda: search.search_multi(loaded, "the of")
        chosen["served_search_bounded"] = lambda: search.bounded(loaded, ["the", "of"])
        chosen["served_suggest"] = lambda: suggest.complete(loaded.completions, loaded.lexicon, "re")
        chosen["served_suggest_by_range"] = lambda: suggest.suggest_with_freq(loaded.lexicon, "re")
        for name, run in chosen.items():
            seconds[name] = min(timed(run) for _ in range(runs))
    calibrated.append(calibration(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "calibration_seconds": [round(x, 3) for x in calibrated],
                "documents_indexed_per_second": round(docs / seconds["build_and_write_index"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
