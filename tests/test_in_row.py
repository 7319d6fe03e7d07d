"""stored_hotspots, stored_stats, stored_edges: both parsers follow a file inside its row, and an edge is written as one row."""
import random

from srcgraph.operators import lines as L
from srcgraph.operators import scoped as SC
from srcgraph.plans import analyze as A
from srcgraph.plans import catalog
from tests.conftest import SF001, files_df

LINES = ["def f(a):", "    def g(): return x()", "class A(B):", "  class C:", "import a.b, c", "import ", "from .x import y", "from  import z",
         "def h(", "):", "    if a and b: run(x)", "def k(a): if a or b", "def m(a): pass", "", "   ", "\tdef t(a):", "def (x):", "y = [1,", "]",
         "\u00a0def nb(a):", "\x1fx = 1", "s = 'a", "\u2003while é:", "s = '''", "async def q():", "        z(k())"]


def _files(spark):
    rnd = random.Random(5)
    texts = {f"d/m{i}.py": rnd.choice(["\n", "\n", "\n", "\r\n", "\u2028"]).join(rnd.choices(LINES, k=rnd.choice([1, 3, 9, 40])))
             for i in range(150)}
    texts["plain.py"] = "import os\nclass A(B):\n    def f(self):\n        if g(): h()\ndef k(a): pass\nclass Z:\n    x = 1\n"
    return files_df(spark, texts)


def test_merged_analysis_sorts_and_exchanges_no_line(spark):
    plan = A.tagged_rows(catalog._f1(spark, SF001), "merged")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_functions_and_modules_are_those_of_the_windows(spark):
    files = _files(spark)
    want = L.line_graph_rows(L.line_windows(L.line_features(L.source_lines(files)))).where("tag = 'sym' AND kind IN ('function', 'module')")
    want = want.where("NOT (kind = 'function' AND complexity IS NULL)")
    got = L.function_module_rows(files)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_scopes_of_many_turns(spark):
    rnd = random.Random(3)
    depth = [rnd.randrange(6) for _ in range(1500)]
    defs = [rnd.random() < 0.4 for _ in depth]
    text = "\n".join("  " * d + (f"def f{i}():" if is_def else f"g{i}()") for i, (d, is_def) in enumerate(zip(depth, defs)))
    want, open_ = [], []
    for i, (d, is_def) in enumerate(zip(depth, defs)):
        open_ = [o for o in open_ if o[0] < d] + ([(d, f"f{i}")] if is_def else [])
        if open_:
            want.append((i + 1, open_[-1][1]))
    got = SC.enclosing_function(SC.scoped_features(files_df(spark, {"a.py": text})))
    assert sorted((r.n, r.func) for r in got.collect()) == want


def test_an_edge_is_one_row(spark):
    files = _files(spark)
    rows, items = SC.scoped_graph_rows(files), SC.scoped_item_rows(files)
    edges = items.where("tag = 'edge'")
    links = edges.where("type <> 'imports'").count()
    assert links > 0 and items.count() == rows.count() - 2 * links
    assert sorted(map(str, rows.collect())) == sorted(map(str, items.unionByName(SC.edge_end_rows(edges)).collect()))


def test_stored_rows_hold_no_ends(spark, monkeypatch):
    from srcgraph import session
    seen = {}
    real = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name, **k: seen.setdefault(name, real(df, name, **k)))
    files = _files(spark)
    for mode in ("scoped", "merged"):
        g, whole = A.build_graph(files, mode, store=True), A.build_graph(files, mode)
        assert seen[f"graph_rows_{mode}"].where("tag = 'sym' AND pos.n = 2147483647").count() == 0
        assert sorted(map(str, g.nodes.collect())) == sorted(map(str, whole.nodes.collect()))
        assert sorted(map(str, g.edges.collect())) == sorted(map(str, whole.edges.select(*g.edges.columns).collect()))
