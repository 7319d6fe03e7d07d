"""stored_edges, stored_stats: a merge that replaces files sorts and joins no more than it must, and loses no row."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from srcgraph import session
from srcgraph.operators import graph as G
from srcgraph.plans.analyze import build_graph, merge_files
from srcgraph.sources import graph_versions as V
from srcgraph.streaming.incremental import merge_once
from tests.conftest import files_df


def _rows(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


def _source(i, v):
    return f"import m{i}\nclass C{i}(B{v}):\n    def f{v}(self):\n        g{i % 3}(h())\n" if v != 2 else "# nothing left\n"


@pytest.mark.parametrize("values", [3, 2 * session.OPEN_FILES + 5])
def test_folders_are_written_without_a_sort(spark, tmp_path, values):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    df = spark.range(5000, numPartitions=2).select("id", (F.col("id") * 7919 % values).cast("int").alias("k"))
    session.write_by(df, "k", f"{tmp_path}/t")
    assert spark.conf.get(name) == before
    back = spark.read.schema("id bigint, k int").parquet(f"{tmp_path}/t")
    assert _rows(back) == _rows(df) and back.select("k").distinct().count() == values
    files = list((tmp_path / "t").glob("k=0/*.parquet"))
    order = [r.id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert len(order) == len(range(0, 5000, values)) and sorted(order) == list(range(0, 5000, values))


@pytest.mark.parametrize("stored, hashed", [(60, True), (1, False)])
def test_replacing_merge(spark, tmp_path, monkeypatch, stored, hashed):
    """Stored rows are not sorted for the names of a smaller batch, and nodes are not joined with those that replace them."""
    files = lambda v, ids: files_df(spark, {f"p{i}.py": _source(i, v) for i in ids})
    plans, real = {}, V._replace
    root, old, new = str(tmp_path), files(0, range(stored)), files(1, range(0, 8)).unionByName(files(2, range(8, 12)))
    V.seed_graph(build_graph(old, "merged", store=True), root, buckets=4)
    monkeypatch.setattr(V, "_replace", lambda spark, root, ver, table, rows, touched: plans.setdefault(
        table, rows._jdf.queryExecution().executedPlan().toString()) and real(spark, root, ver, table, rows, touched))
    merge_once(new, root, "b", "merged", replace_files=True)
    for table in ("nodes", "edges"):
        assert ("ShuffledHashJoin" in plans[table]) == hashed and ("SortMergeJoin" in plans[table]) == (not hashed)
        assert "FullOuter" not in plans[table]
    ids = range(12, stored)
    want = merge_files(build_graph(files(0, ids), "merged"), new, "merged") if len(ids) else build_graph(new, "merged")
    got = V.read_version(spark, root)
    assert _rows(got.nodes.select(*G.NODE_COLS)) == _rows(want.nodes.select(*G.NODE_COLS))
    assert _rows(got.edges.select(*G.EDGE_COLS)) == _rows(want.edges.select(*G.EDGE_COLS))


def test_nodes_without_a_shared_key_need_no_join(spark):
    a, b = (build_graph(files_df(spark, {f"p{i}.py": _source(i, v) for i in ids}), "merged", default=v == 0).nodes
            for v, ids in ((0, range(5)), (1, range(5, 9))))
    got = G.add_nodes(a, b, True, 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(got) == _rows(G.join_nodes(a, b, True, 3))
