"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads. Every query is
executed in full into a sink that discards rows; one warm-up run of the first
query keeps JVM start-up out of the numbers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ballotframe.plans.catalogue import CATALOGUE
from ballotframe.session import local_session

HEADLINE = [
    "vote_totals", "winners", "compare", "seat_summary", "battlegrounds", "saved_views", "extended_seats",
    "choropleth_change", "group_shares", "project_seats", "project_inputs", "redistribute", "moving_average",
    "unchanged_seats", "overrides", "fact_lists", "regional_blend", "model_series", "clean_facts", "challenge_build", "extract_facts", "load_facts", "score_guesses", "game_outcomes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)

    def run(name: str) -> float:
        start = time.perf_counter()
        CATALOGUE[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])
    timings = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
