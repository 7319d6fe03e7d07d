"""Files read by chunks of lines: the same rows and graph as the window form, whatever the size of the chunks."""
import random

import pytest
from conftest import files_df
from pyspark.sql import functions as F

from srcgraph.operators import chunks as K
from srcgraph.operators import lines as L
from srcgraph.plans.analyze import build_graph

PIECES = ["def f{}(x):", "def g{}(): return 1", "class C{}:", "class D{}(Base, object):", "    if a and b:",
          "    y = 1", "", "import os.path", "from .m{} import z", "    x or y", "import ", "def (x):"]
BREAKS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", " ", "\n\n"]


def _file(rng):
    kinds = rng.sample(PIECES, rng.randint(1, len(PIECES)))  # few kinds: long stretches without def, class or body
    lines = [rng.choice(kinds).format(rng.randint(0, 3)) + rng.choice(BREAKS) for _ in range(rng.randint(0, 40))]
    return "".join(lines) + rng.choice(["", "x = 1", "class E(F)"])


def _files(spark):
    rng = random.Random(11)
    files = {f"p{i}/m{i}.py": _file(rng) for i in range(250)}
    files.update({"none.py": None, "empty.py": "", "breaks.py": "\n\n\n", "one.py": "def a(): pass"})
    return files_df(spark, files).cache()


def _lines(win):
    cols = ["repo_id", "path", "n", "kind", "class_name", "bases", "def_name", "module", "branch", "seg", "closer", "body"]
    return sorted(map(str, win.select(*cols).collect()))


def _graph(g):
    return (sorted(map(str, g.nodes.select("repo_id", "file", "name", "kind", "complexity", "pos").collect())),
            sorted(map(str, g.edges.collect())))


@pytest.mark.parametrize("chunk_lines", [1, 3, 1000])
def test_lines_of_chunks_are_those_of_the_window_form(spark, chunk_lines):
    files = _files(spark)
    want = _lines(L.line_windows(L.line_features(L.source_lines(files))))
    assert _lines(K.chunk_windows(files, chunk_lines)) == want


def test_graph_by_chunks_is_the_same(spark):
    files = _files(spark)
    want = _graph(build_graph(files))
    assert _graph(build_graph(files, chunk_lines=2, chunk_bytes=0)) == want
    assert _graph(build_graph(files, chunk_lines=4, chunk_bytes=200)) == want  # long files by chunks, the others whole


def test_other_modes_take_chunks(spark):
    files = _files(spark).where("path < 'p2'")
    for mode in ("merged", "auto"):
        assert _graph(build_graph(files, mode, chunk_lines=3, chunk_bytes=100)) == _graph(build_graph(files, mode))


def test_pieces_joined_are_the_file(spark):
    files = _files(spark)
    each = F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    got = K.text_pieces(files, 2).groupBy("repo_id", "path").agg(F.array_join(each, "").alias("t"))
    assert got.join(files, ["repo_id", "path"]).where("t <> content").count() == 0
    assert got.count() == files.where("content <> ''").count()


def test_state_at_the_start_of_chunks(spark):
    text = "\n".join(["x", "def f(): pass", "y", "class A:", "z", "class B:", "def g():", "class C:", "w", "class D:", "v"])
    s = K.chunk_states(K._local(files_df(spark, {"a.py": text}), 2)).orderBy("chunk")
    assert [(r.n0, r.seg0, r.had, r.shut) for r in s.collect()][1:] == [
        (2, 1, True, False), (4, 1, True, True), (6, 1, True, True), (8, 2, False, False), (10, 2, True, True)]


def test_empty_table_and_bad_size(spark):
    none = files_df(spark, {"a.py": ""}).where("false")
    assert K.chunk_windows(none, 2).count() == 0
    assert build_graph(none, chunk_lines=2, chunk_bytes=0).nodes.count() == 0
    with pytest.raises(ValueError):
        K.chunk_windows(none, 0)


def test_no_group_spans_a_file(spark):
    """Windows over lines are keyed by chunk; those keyed by the file stand over one row per chunk."""
    plan = K._local(_files(spark), 2)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition" in line:
            assert "chunk" in line
