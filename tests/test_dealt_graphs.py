"""The analysis behind the graph queries has as many partitions as its files ask for, whatever the session's shuffle partitions are."""
import pytest

from srcgraph import session
from srcgraph.plans import catalog
from srcgraph.plans.analyze import build_graph
from srcgraph.sources import fixtures as FX
from tests.conftest import SF001


def _parts(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("rows", [10, 25])
def test_line_graph_follows_its_files(spark, monkeypatch, rows):
    """cap_nodes, discovery_rounds and the queries on its tables: nodes come from the partitions that the files were dealt to."""
    files = catalog._f1(spark, SF001)
    monkeypatch.setattr(session, "PART_ROWS", rows)
    assert _parts(build_graph(files).nodes) == -(-files.count() // rows)


def test_merged_graph_follows_both_batches(spark, monkeypatch):
    """merge_edges: the stored files and the new ones are dealt each by their own number."""
    monkeypatch.setattr(session, "PART_ROWS", 10)
    stored, new = catalog._f6(spark, SF001)
    assert _parts(catalog.q_merge_edges(spark, SF001)) == sum(-(-f.count() // 10) for f in (stored, new))


def test_fixture_is_dealt_before_its_text_is_made(spark, monkeypatch):
    """Every query over F1: its text, many times its row of ``part``, is made in partitions of so many rows."""
    monkeypatch.setattr(session, "PART_ROWS", 10)
    assert _parts(FX.f1_source_files(spark, SF001)) == -(-FX.f1_paths(spark, SF001).count() // 10)
