"""Line parser (LIN*) and graph build (GRF*): literal cases, and random files against the DuckDB oracle,
which states the rules in a form of its own."""
import random

from conftest import files_df

from srcgraph.plans.analyze import build_graph


def graph_nodes(spark, files):
    g = build_graph(files_df(spark, files))
    return {(r.file, r.name): (r.kind, r.complexity) for r in g.nodes.collect()}, g


def test_empty_function_dropped(spark):
    n, _ = graph_nodes(spark, {"a.py": "def a():\ndef b():\nx=1\n"})
    assert n == {("a.py", "b"): ("function", 1)}


def test_class_does_not_close_bodiless_function(spark):
    n, _ = graph_nodes(spark, {"a.py": "def a():\nclass K:\nif x:\n"})
    assert n == {("a.py", "K"): ("class", 1), ("a.py", "a"): ("function", 2)}


def test_comma_stays_on_multi_import(spark):
    _, g = graph_nodes(spark, {"a.py": "import os, sys\n"})
    assert [r.target for r in g.edges.collect()] == ["os,"]


def test_relative_import_gives_empty_module_name(spark):
    n, g = graph_nodes(spark, {"a.py": "from .u import v\n"})
    assert [r.target for r in g.edges.collect()] == [".u"]
    assert n == {("a.py", ""): ("module", 1)}


def test_except_at_line_start_not_counted(spark):
    n, _ = graph_nodes(spark, {"a.py": "def a():\nexcept E:\n"})
    assert n[("a.py", "a")] == ("function", 1)


def test_two_keywords_count_once(spark):
    n, _ = graph_nodes(spark, {"a.py": "def a():\nif x and y:\n"})
    assert n[("a.py", "a")] == ("function", 2)


def test_first_kind_wins(spark):
    n, _ = graph_nodes(spark, {"a.py": "class A:\ndef A(): pass\n"})
    assert n == {("a.py", "A"): ("class", 1)}


def test_async_def_is_no_symbol(spark):
    n, _ = graph_nodes(spark, {"a.py": "async def a():\n"})
    assert n == {}


def test_keyword_base_kept(spark):
    _, g = graph_nodes(spark, {"a.py": "class A(B, metaclass=M):\n"})
    assert sorted(r.target for r in g.edges.collect()) == ["a.py:B", "a.py:metaclass=M"]


def test_edges_are_a_multiset(spark):
    _, g = graph_nodes(spark, {"a.py": "import os\nimport os\n"})
    assert g.edges.count() == 2


def test_crlf_and_rare_breaks(spark):
    text = "def a():\r\n    if x:\r\n    y\x0bif z:\n"
    n, _ = graph_nodes(spark, {"a.py": text})
    assert n == {("a.py", "a"): ("function", 3)}


CASES = [  # text, nodes (name, kind, complexity), edges (target, type)
    ("import os.path\nfrom a.b import c\n", [("os", "module", 1), ("a", "module", 1)], [("os.path", "imports"), ("a.b", "imports")]),
    ("class A(B, object, C):\n  def f(self): return 1\n  def g(self):\n    if x and y:\n      z\n",
     [("A", "class", 1), ("f", "function", 1), ("g", "function", 2), ("B", "class", 1), ("C", "class", 1)],
     [("a.py:B", "inherits"), ("a.py:C", "inherits")]),
    ("def f(x):\n  for i in x:\n  while y:\nclass K:\n  if z:\n", [("f", "function", 3), ("K", "class", 1)], []),
    ("def f(x): return x or y\n", [("f", "function", 2)], []),
    ("def f():\n  pass\ndef f():\n  if a:\n  elif b:\n", [("f", "function", 3)], []),
    ("x = 1\nif y:\n", [], []),
]


def test_literal_cases(spark):
    files = {f"d{i}/a.py": text for i, (text, _, _) in enumerate(CASES)}
    got, g = graph_nodes(spark, files)
    edges = sorted((r.file, r.target, r.type) for r in g.edges.collect())
    want = {(f"d{i}/a.py", n): (k, c) for i, (_, nodes, _) in enumerate(CASES) for n, k, c in nodes}
    assert got == want
    assert edges == sorted((f"d{i}/a.py", f"d{i}/{t}" if y == "inherits" else t, y) for i, (_, _, es) in enumerate(CASES) for t, y in es)


def _random_file(rng):
    pieces = ["def f{}(x):", "def g{}(): return 1", "class C{}:", "class D{}(Base, object):",
              "    if a and b:", "    for i in x:", "    y = 1", "", "import os.path", "from .m{} import z",
              "    except E:", "  while q:", "async def h{}():", "    return x or y", "def k{}(x): pass"]
    lines = [rng.choice(pieces).format(rng.randint(0, 3)) for _ in range(rng.randint(0, 25))]
    return "\n".join(lines) + rng.choice(["", "\n"])


def test_random_files_match_the_oracle(spark):
    import duckdb
    import oracle_sql as O
    import pandas as pd
    rng = random.Random(7)
    files = {f"p{i}/m{i}.py": _random_file(rng) for i in range(300)}
    got, g = graph_nodes(spark, files)
    con = duckdb.connect()
    con.register("f1", pd.DataFrame([("r", p, t) for p, t in files.items() if t], columns=["repo_id", "path", "content"]))
    rules = "WITH " + ",\n".join([O.LINES, O.FEATS, O.FUNCS, O.SYMS])
    want = con.execute(rules + " SELECT file, name, kind, complexity FROM nodes").fetchall()
    assert got == {(f, n): (k, c) for f, n, k, c in want}
    edges = con.execute(rules + " SELECT file, source, target, type FROM edges").fetchall()
    assert sorted((r.file, r.source, r.target, r.type) for r in g.edges.collect()) == sorted(edges)
