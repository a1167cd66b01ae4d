"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The stand-in views that several queries start from (self-joins of the base tables) are written once before; their time is
given as `standins`, apart from the queries. Each query runs once to warm up and then three times; its figure is the
median. Results go to the no-op sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from strandlake.plans import catalog
from strandlake.plans.fixtures import Inputs
from strandlake.session import build_session

HEADLINE = ["pathway_enrichment", "gene_list_enrichment", "ppi_merged", "ppi_score_filtered", "reaction_roles", "event_topics_closure", "avg_pair_similarity", "evidence_rank_top3", "chunk_tokens", "evidence_evaluation", "vote_consensus", "job_event_seq"]
STANDINS = ["membership", "pathway_rows", "ppi_intact", "ppi_biogrid", "intact_raw", "biogrid_raw", "fi", "edges"]
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{folder}/shared"})
        spark.sparkContext.setLogLevel("ERROR")
        began, views = time.perf_counter(), Inputs(spark, sf_dir)
        for name in STANDINS:
            getattr(views, name).write.parquet(f"file://{folder}/{name}")
            views = Inputs(spark, sf_dir, {**views._made, name: spark.read.parquet(f"file://{folder}/{name}")})
        standins, written = round(time.perf_counter() - began, 3), {n: getattr(views, n) for n in STANDINS}
        took, spread = {}, {}
        for name in sys.argv[1:] or HEADLINE:
            seconds = []
            for _ in range(1 + RUNS):
                start = time.perf_counter()
                catalog.PLANS[name](Inputs(spark, sf_dir, written)).write.format("noop").mode("overwrite").save()
                seconds.append(time.perf_counter() - start)
            took[name], spread[name] = round(statistics.median(seconds[1:]), 3), round(max(seconds[1:]) - min(seconds[1:]), 3)
            print(name, took[name], file=sys.stderr)
        print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "spread": spread, "standins": standins, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
        spark.stop()


if __name__ == "__main__":
    main()
