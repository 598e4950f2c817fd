"""Benchmark: prints one JSON line with seconds per query.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of cores.  The
profiles are derived once and written as Parquet with new ids until there are
at least 100,000, the size of the published run to compare with; reading,
scoring, ranking and explaining them is then timed from file to result.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from profilerank.plans import derived, queries  # noqa: E402
from profilerank.plans.scoring import ranked, score_table  # noqa: E402
from profilerank.session import local_session  # noqa: E402
from profilerank.sources import normalise, read_profiles, write_ranked  # noqa: E402

PROFILES = 100_000
BASELINE_SECONDS = 120.0  # the published run: 100,000 profiles in about two minutes
TABLE_QUERIES = ("term_count_docs", "term_hits_by_lang", "terms_by_role", "profile_text", "skill_gap",
                 "all_outcomes", "explained_top_n", "order_topk", "event_recency_score")


def timed(action) -> float:
    start = time.time()
    action()
    return round(time.time() - start, 3)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="run-bench-")
    seconds = {}

    customers = derived.table(spark, sf_dir, "customer").count()
    copies = max(1, -(-PROFILES // customers))
    profiles, path = customers * copies, f"{work}/profiles.parquet"
    seconds["derive_profiles"] = timed(
        lambda: derived.profiles(spark, sf_dir, copies).repartition(4 * int(cpus)).write.parquet(path))

    source = lambda: normalise(read_profiles(spark, path))
    seconds["read_profiles"] = timed(lambda: noop(source()))
    seconds["score_100k"] = timed(lambda: noop(score_table(source())))
    seconds["rank_explain_write_100k"] = timed(lambda: write_ranked(ranked(source(), 100), f"{work}/ranked"))
    seconds["rank_explain_write_100k_again"] = timed(lambda: write_ranked(ranked(source(), 100), f"{work}/ranked2"))

    registered = queries.queries()
    for name in TABLE_QUERIES:
        seconds[name] = timed(lambda: noop(registered[name](spark, sf_dir)))

    whole_run = seconds["rank_explain_write_100k"]
    print(json.dumps({
        "metric": "rank_explain_write_100k_profiles",
        "value": whole_run,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "profiles": profiles,
        "profiles_per_sec": round(profiles / whole_run),
        "baseline_profiles_per_sec": round(PROFILES / BASELINE_SECONDS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
