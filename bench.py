"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Stage ``enrich`` derives the note table from the raw test tables (summary,
entities, expiry, ... over whole texts) and stores it as Parquet partitioned
by project, as a deployment would; every other query then reads that stored
table. Each query is forced end to end with a ``noop`` write: once to warm up,
then three times, of which the median counts (``first`` has the first runs).
``enrich`` runs once, after a small job that starts the session's machinery.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["c1_search", "c2_search_budgeted", "t1_vector_topk", "c3_recall", "c4_list", "c5_rules",
            "c6_session_digest", "c7_trail", "m1_store", "m2_update", "m5_bump_access", "m8_import_apply",
            "j4_import_diff", "e9_entities", "n4_parse_markdown", "v6_embed"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from cairn.plans import adapters as AD
    from cairn.plans import catalog
    from cairn.session import build_session

    scratch = tempfile.mkdtemp(prefix="cairn-bench-")
    spark = build_session(f"local[{cpus}]", app="cairn-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                 "spark.sql.files.maxPartitionBytes": str(32 << 20)})
    times: dict[str, float] = {}
    first: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    t0 = time.perf_counter()
    path = AD.materialize_memories(spark, sf_dir, os.path.join(scratch, "memories"))
    times["enrich"] = round(time.perf_counter() - t0, 3)
    AD.use_stored_memories(sf_dir, path)

    for n in names:
        q, took = catalog.QUERIES[n], []
        for _ in range(1 + RUNS):
            t0 = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(round(time.perf_counter() - t0, 3))
        first[n], times[n] = took[0], median(took[1:])

    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    extra = {"embed_texts_per_sec": round(n_docs / times["v6_embed"], 1)} if "v6_embed" in times else {}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "first": first, **extra, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
