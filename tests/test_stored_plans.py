"""Plans that read a graph or a tree in several places analyse nothing twice; a checkout of many small directories is few tasks."""
import os

from srcgraph.plans import catalog
from srcgraph.sources import graph_versions
from srcgraph.sources.directory import SourceDirReader
from srcgraph.streaming import incremental
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_diagrams_read_a_stored_graph(spark):
    for key in ("diagram_edges", "diagram_tables"):
        plan = _plan(catalog.REGISTRY[key](spark, SF001))
        assert "Window" in plan and "regexp_extract_all" not in plan and "content" not in plan


def test_replaced_graph_is_analysed_once_per_batch(spark, monkeypatch):
    seen = []
    real = catalog.build_graph
    monkeypatch.setattr(catalog, "build_graph", lambda *a, **k: seen.append(k.get("store")) or real(*a, **k))
    monkeypatch.setattr(catalog, "remembered", lambda spark, key, make: make())
    monkeypatch.setattr(graph_versions, "seed_graph", lambda g, root: None)
    monkeypatch.setattr(incremental, "merge_once", lambda *a, **k: None)
    catalog._replaced(spark, SF001)
    assert seen == [True]


def test_tree_of_the_report_is_written_once(spark):
    assert "transform" not in _plan(catalog._report_inputs(spark, SF001, False).tree)


def test_urls_are_checked_once_per_repository(spark):
    plan = _plan(catalog._repo_names(spark, SF001))
    assert "Aggregate" not in plan and "p_brand" not in plan
    assert catalog._repos(spark, SF001).count() == catalog._repos(spark, SF001).select("repo_id").distinct().count() > 0


def test_small_directories_share_tasks(tmp_path):
    for r in range(3):
        for i in range(40):
            os.makedirs(tmp_path / f"r{r}" / f"pkg_{i}" / "venv")
            (tmp_path / f"r{r}" / f"pkg_{i}" / "__init__.py").write_text(f"x = {i}\n")
            (tmp_path / f"r{r}" / f"pkg_{i}" / "venv" / "no.py").write_text("")
        (tmp_path / f"r{r}" / "top.py").write_text("")
    reader = SourceDirReader({"path": str(tmp_path), "max_parts": "8"})
    parts = reader.partitions()
    assert len(parts) == 8 and max(len(p.tops) for p in parts) == 16
    got = [(repo, path) for p in parts for repo, path, _ in reader.read(p)]
    assert len(got) == len(set(got)) == 3 * 41 and ("r2", "top.py") in got
    assert len(SourceDirReader({"path": str(tmp_path)}).partitions()) == 3 * 41
