"""Benchmark of the headline queries.

Reads the driver tables at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), runs on
``local[$BENCH_CPUS]`` (default 8) and prints one JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.

Inputs are built once and written as parquet (the way a production job reads its source
file table); every query is then forced completely with a ``noop`` write (all columns,
no collect). After one warm-up run of the first query, each query runs ``$BENCH_RUNS``
(default 3) times; the median is reported.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from pyspark.sql import functions as F

    from srcgraph.operators import stats as S
    from srcgraph.operators.deps import classify_imports, dependency_report
    from srcgraph.operators.lookup import pattern_lookup
    from srcgraph.operators.tree import file_tree, readme_pick
    from srcgraph.plans.analyze import build_graph
    from srcgraph.plans.discovery import discover
    from srcgraph.plans.report import ReportInputs, report_rows
    from srcgraph.session import get_spark, materialize
    from srcgraph.sources import fixtures as FX

    spark = get_spark(f"local[{cpus}]", int(cpus))
    t0 = time.time()
    f1 = materialize(FX.f1_source_files(spark, sf_dir), "bench_f1")
    f3 = materialize(FX.f3_file_entries(spark, sf_dir), "bench_f3")
    f5 = materialize(FX.f5_edges(spark, sf_dir), "bench_f5")
    prep = time.time() - t0

    def noop(*dfs):
        for df in dfs:
            df.write.format("noop").mode("overwrite").save()

    def q_graph_line():
        g = build_graph(f1, store=True)
        noop(g.nodes, g.edges)

    def q_graph_stats():
        g = build_graph(f1, store=True)
        noop(S.graph_stats(g.nodes, g.edges))

    def q_high_complexity():
        noop(S.high_complexity(build_graph(f1).nodes))

    def q_hotspots_f5():
        noop(S.call_hotspots(f5))

    def q_pattern_lookup_f5():
        pats = FX.table(spark, sf_dir, "nation").select(
            F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("pattern"),
            F.lit("inherits").alias("type"))
        noop(pattern_lookup(f5, pats))

    def q_graph_merged():
        g = build_graph(f1, mode="merged", store=True)
        noop(g.nodes, g.edges)

    def q_dependency_report():
        g = build_graph(f1, store=True)
        noop(dependency_report(classify_imports(g.edges, g.nodes, f3), g.nodes))

    def q_discovery():
        d = discover(f1, f3)
        noop(d.rounds, d.graph.nodes)

    def q_report():
        tree = file_tree(f3)
        g = build_graph(f1, mode="merged", store=True)
        inp = ReportInputs(FX.repos(spark, sf_dir), g, tree, FX.repo_readmes(spark, sf_dir, readme_pick(tree)))
        noop(report_rows(inp))

    qs = {k[2:]: v for k, v in locals().items() if k.startswith("q_") and callable(v)}
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    out = {}
    warmed = False
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if not warmed:  # one warm-up run (JVM, code generation), then the measured runs
            fn()
            warmed = True
        ts = []
        for _ in range(runs):
            t = time.time()
            fn()
            ts.append(time.time() - t)
        out[name] = round(statistics.median(ts), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "prep_sec": round(prep, 3), "runs": runs, "cpus": int(cpus),
                      "sf": float(sf.group(1)) if sf else sf_dir}))


if __name__ == "__main__":
    main()
