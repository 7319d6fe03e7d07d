"""Work that grows when it is parsed is dealt by its number of rows, and finding scopes sends no side of a join to the driver."""
from pyspark.sql import functions as F

from srcgraph import session
from srcgraph.operators import scoped as SC
from srcgraph.sources import fixtures as FX
from tests.conftest import SF001, files_df


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_rows_and_bytes(spark, monkeypatch):
    d = spark.range(5000).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 100).alias("content"))
    monkeypatch.setattr(session, "PART_ROWS", 100)
    got = session.dealt(d, "path")
    assert got.rdd.getNumPartitions() == 50 and got.count() == 5000
    monkeypatch.setattr(session, "PART_BYTES", 5000)
    assert session.dealt(d, "path", text="content").rdd.getNumPartitions() == 100
    assert session.dealt(d.limit(0), "path", text="content").rdd.getNumPartitions() == 1


def test_wrapped_sources_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 10)
    n = FX.f1_paths(spark, SF001).count()
    assert FX.f8_wrapped_sources(spark, SF001).rdd.getNumPartitions() == -(-n // 10)


def test_scopes_are_found_without_a_join(spark):
    f = files_df(spark, {"a.py": "x()\ndef f():\n    y()\n    def g():\n        z()\n    w()\n", "b.py": "v()\n"})
    feats = SC.scoped_features(f)
    calls = SC.scoped_calls(feats)
    assert "Join" not in _plan(calls) and "Broadcast" not in _plan(calls)
    assert sorted((r.caller, r.callee) for r in calls.collect()) == [("f", "w"), ("f", "y"), ("g", "z")]
    assert SC.with_function(feats).count() == 7
