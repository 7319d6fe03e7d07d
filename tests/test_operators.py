"""URL checks, file tree order, import classification, discovery, merge, scoped mode."""
from conftest import SF001, files_df
from pyspark.sql import functions as F

from srcgraph.functions.urls import validate_repo_url
from srcgraph.operators import graph as G
from srcgraph.operators.deps import classify_imports
from srcgraph.operators.tree import file_tree, tree_lines
from srcgraph.plans.analyze import build_graph, merge_files
from srcgraph.plans.discovery import discover


def check_url(spark, url):
    df = spark.createDataFrame([(url,)], "u string")
    r = df.select(validate_repo_url("u").alias("v")).first().v
    return r.valid, r.error, r.normalized_url


def test_url_rules(spark):
    assert check_url(spark, "https://github.com/o/r.git") == (True, None, "https://github.com/o/r")
    assert check_url(spark, "  https://github.com/o/r/tree/x//  ") == (True, None, "https://github.com/o/r")
    assert check_url(spark, "https://github.com/me/my.github") == (True, None, "https://github.com/me/myhub")
    assert check_url(spark, "https://gitlab.com/a/b/") == (True, None, "https://gitlab.com/a/b")
    assert check_url(spark, "")[1] == "URL must be a non-empty string"
    assert check_url(spark, None)[1] == "URL must be a non-empty string"
    assert check_url(spark, "github.com/o/r")[1].startswith("Unsupported host: . Supported:")
    assert check_url(spark, "https://github.com/only")[1].startswith("GitHub URL must be in format")
    assert check_url(spark, "https://github.com/o!/r")[1] == "Invalid owner/repo name: o!/r"
    assert check_url(spark, "https://git[hub.com/o/r")[1] == "Invalid URL format: Invalid IPv6 URL"
    assert check_url(spark, "https://github.com/ü/r")[0] is True  # Unicode word characters


def test_tree_order_dirs_first_then_lowercase(spark):
    paths = ["b.py", "A/x.py", "a2/y.py", "C.txt", "venv/lib/z.py", "node_modules/q.js", "A/B/c.py"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    lines = [r.text for r in tree_lines(file_tree(df)).orderBy("sort_key").collect()]
    assert lines == ["./", "  A/", "    A/B/", "      A/B/c.py", "    A/x.py", "  a2/", "    a2/y.py",
                     "  b.py", "  C.txt"]


def test_import_classes(spark):
    files = {"x/y/utils.py": "import utils\nimport os.path\nimport requests\nfrom .helpers import h\nimport pkg\n",
             "pkg/__init__.py": "import x\n", "helpers.py": "", "r_tools.py": "import r_tools_extra\n"}
    f = files_df(spark, files, repo="r_tools")
    g = build_graph(f)
    paths = f.select("repo_id", "path").unionByName(
        spark.createDataFrame([("r_tools", "x/__init__.py")], "repo_id string, path string"))
    cls = {r.module: (r["class"], r.potential_file) for r in classify_imports(g.edges, g.nodes, paths).collect()}
    assert cls["utils"] == ("analyzed", None)             # suffix of x.y.utils
    assert cls["os.path"] == ("stdlib", None)
    assert cls["requests"] == ("external", None)
    assert cls[".helpers"] == ("internal", "helpers.py")  # looked up at the repository root
    assert cls["pkg"] == ("internal", "pkg/__init__.py")  # pkg/__init__.py is analysed as pkg.__init__
    assert cls["x"] == ("internal", "x/__init__.py")
    assert cls["r_tools_extra"] == ("internal", None)     # repository-name prefix


def test_discovery_rounds_and_reach(spark):
    files = {"main.py": "import a\n", "a.py": "import b\nx = 1\n", "b.py": "import c\ny = 1\n",
             "c.py": "import d\n", "d.py": "z = 1\n", "lonely.py": "import os\n"}
    d = discover(files_df(spark, files))
    reached = {(r.path, r.round) for r in d.reached.collect()}
    assert reached == {("main.py", 0), ("a.py", 1), ("b.py", 2), ("c.py", 3)}
    r = d.rounds.first()
    assert (r.discovery_rounds, r.files_reached, r.seeded_with_entry_points) == (3, 4, True)


def test_split_and_merge_equals_one_shot(spark):
    from srcgraph.sources.fixtures import f1_source_files
    f = f1_source_files(spark, SF001, with_key=True)
    one = build_graph(f.drop("p_partkey"))
    a = f.where(F.col("p_partkey") % 2 == 0).drop("p_partkey")
    b = f.where(F.col("p_partkey") % 2 == 1).drop("p_partkey")
    merged = merge_files(build_graph(a), b)
    key = lambda df: sorted(tuple(r) for r in df.select(*G.NODE_COLS).collect())
    assert key(merged.nodes) == key(one.nodes)
    assert sorted(tuple(r) for r in merged.edges.collect()) == sorted(tuple(r) for r in one.edges.collect())


def test_graph_invariants(spark):
    from srcgraph.sources.fixtures import f1_source_files
    g = build_graph(f1_source_files(spark, SF001), mode="merged")
    keys = g.nodes.select("repo_id", G.node_key("file", "name").alias("k"))
    assert keys.count() == keys.distinct().count()
    ends = (g.edges.where(F.col("type") != "imports").select("repo_id", F.col("source").alias("k"))
            .union(g.edges.where(F.col("type") != "imports").select("repo_id", F.col("target").alias("k"))))
    assert ends.join(keys, ["repo_id", "k"], "left_anti").count() == 0


def test_scoped_calls_and_nesting(spark):
    from srcgraph.operators.scoped import scoped_calls, scoped_features
    text = ("class A(Base):\n"
            "    def m(self):\n"
            "        self.x()\n"
            "        def inner():\n"
            "            a.b.c(1)\n"
            "        helper(\"s(\")  # cmt(\n"
            "    top()\n"
            "def f(x=g()):\n"
            "    '''doc\n"
            "    fake()\n"
            "    '''\n"
            "    return h()\n")
    calls = {(r.caller, r.callee) for r in scoped_calls(scoped_features(files_df(spark, {"a.py": text}))).collect()}
    assert calls == {("m", "self"), ("inner", "c"), ("m", "helper"), ("f", "g"), ("f", "h")}


def _stack_calls(text):
    """Calls per enclosing function by an explicit stack of open defs."""
    import re
    out, stack = [], []
    for line in text.split("\n"):
        if not line.strip():
            continue
        ind = len(line) - len(line.lstrip(" "))
        while stack and stack[-1][0] >= ind:
            stack.pop()
        m = re.match(r"\s*def (\w+)\(", line)
        if m:
            stack.append((ind, m.group(1)))
            continue
        for callee in re.findall(r"(\w+)\(", line):
            if stack and not line.lstrip().startswith("class "):
                out.append((stack[-1][1], callee))
    return sorted(out)


def test_random_scopes_match_stack(spark):
    import random

    from srcgraph.operators.scoped import scoped_calls, scoped_features
    rng = random.Random(11)
    files = {}
    for f in range(150):
        lines, ind = [], 0
        for _ in range(rng.randint(1, 30)):
            ind = max(0, min(12, ind + rng.choice([-4, -4, 0, 0, 4])))
            kind = rng.choice(["def", "class", "call", "call", "plain"])
            k = rng.randint(0, 4)
            lines.append(" " * ind + {"def": f"def f{k}(a):", "class": f"class K{k}:", "call": f"g{k}(a)",
                                      "plain": "x = 1"}[kind])
        files[f"m{f}.py"] = "\n".join(lines) + "\n"
    got = scoped_calls(scoped_features(files_df(spark, files)))
    by_file = {}
    for r in got.collect():
        by_file.setdefault(r.path, []).append((r.caller, r.callee))
    for path, text in files.items():
        assert sorted(by_file.get(path, [])) == _stack_calls(text), path


def _scoped(spark, text):
    from srcgraph.operators.scoped import scoped_bases, scoped_calls, scoped_features, scoped_imports, scoped_symbols
    f = scoped_features(files_df(spark, {"a.py": text}))
    return (sorted((r.name, r.kind) for r in scoped_symbols(f).collect()), sorted((r.caller, r.callee) for r in scoped_calls(f).collect()),
            sorted((r.class_name, r.base) for r in scoped_bases(f).collect()), sorted(r.module for r in scoped_imports(f).collect()))


def test_quotes_in_strings_and_comments_hide_nothing(spark):
    for head in ("RX = '\"\"\"'\n", "# it's ''' here\n", "x = \"#\"  # \"\n", "y = \"a\\\\\"  # \\\n"):
        assert _scoped(spark, head + "def a():\n    b()\ndef c():\n    d()\n")[:2] == (
            [("a", "function"), ("c", "function")], [("a", "b"), ("c", "d")])


def test_nested_calls_are_no_bases(spark):
    assert _scoped(spark, "class A(f(g(h(X)))):\n    pass\n")[2] == []
    assert _scoped(spark, "class A(\n    f(g(h(X)), k=Y),\n    B.c,\n    (D),\n):\n    pass\n")[2] == [("A", "B.c"), ("A", "D")]


def test_lines_inside_brackets_open_and_close_nothing(spark):
    text = "def f(\n    a,\n    b=g(\n1),\n):\n    h(\ndef_,\n    )\n    i()\nfrom x import (\n  y,\n)\nimport a.b, c as d\nfrom __future__ import z\nj()\n"
    sym, calls, _, imports = _scoped(spark, text)
    assert sym == [("f", "function")] and calls == [("f", "g"), ("f", "h"), ("f", "i")] and imports == ["a.b", "c", "x"]


def test_unclosed_and_odd_sources(spark):
    assert _scoped(spark, "def f():\n    g(\n") == ([("f", "function")], [("f", "g")], [], [])
    assert _scoped(spark, "def f():\n    '''never closed\ndef g():\n")[0] == [("f", "function")]
    assert _scoped(spark, "\n\n") == ([], [], [], [])
    big = "x = [\n" + "".join(f"    'a{i}',  # c\n" for i in range(5000)) + "]\n\"\"\"" + "q\\n" * 20000 + "\"\"\"\ndef f():\n    g()\n"
    assert _scoped(spark, big)[1] == [("f", "g")]


NODES = "repo_id string, file string, name string, kind string, complexity int, gen int, pos long"


def _nodes(g):
    from srcgraph.operators.graph import GRAPH_ORDER
    return [(r.file, r.name, r.kind, r.complexity) for r in g.nodes.orderBy("repo_id", *GRAPH_ORDER).collect()]


def test_merge_keeps_stored_order_and_kind(spark):
    base = build_graph(files_df(spark, {"z.py": "class Z:\n  pass\nclass A:\n  pass\n"}))
    base = G.Graph(base.nodes.unionByName(spark.createDataFrame([("r", "z.py", "odd", "method", 3, 0, 99)], NODES)), base.edges)
    merged = merge_files(base, files_df(spark, {"z.py": "class B(Z):\n  pass\ndef odd(x):\n  if x: y\n", "a.py": "import os\n"}))
    assert _nodes(merged) == [("a.py", "os", "module", 1), ("z.py", "Z", "class", 1), ("z.py", "A", "class", 1), ("z.py", "odd", "method", 2),
                              ("z.py", "B", "class", 1)]


def test_union_and_reload_keep_the_first_row(spark, tmp_path):
    from srcgraph.sources.graph_store import load_graph
    none = spark.createDataFrame([], "repo_id string, file string, source string, target string, type string")
    a = G.Graph(spark.createDataFrame([("r", "f", "x", "function", 2, 0, 1)], NODES), none)
    b = G.Graph(spark.createDataFrame([("r", "f", "x", "class", 1, 0, 1), ("r", "f", "y", "trait", 5, 0, 0)], NODES), none)
    assert _nodes(G.graph_union(a, b)) == [("f", "x", "function", 2), ("f", "y", "trait", 5)]
    rows = [("r", "f", "k", "method", 4, 0, 1), ("r", "f", "k", "class", 9, 0, 2), ("r", "f", None, None, None, 0, 3)]
    spark.createDataFrame(rows, NODES).write.parquet(str(tmp_path / "nodes"))
    none.write.parquet(str(tmp_path / "edges"))
    assert _nodes(load_graph(spark, str(tmp_path))) == [("f", "k", "method", 4), ("f", "", "", 1)]


def test_many_items_on_one_line_keep_their_order(spark):
    calls = "def f():\n    return [" + ", ".join(f"g{i}(1)" for i in range(70_000)) + "]\n    h()\n"
    g = build_graph(files_df(spark, {"a.py": calls}), mode="scoped")
    names = [r.name for r in g.nodes.orderBy(*G.GRAPH_ORDER).select("name").collect()]
    assert names == ["f", *[f"g{i}" for i in range(70_000)], "h"]


def test_imports_resolve_by_package(spark):
    from srcgraph.operators.deps import classify_importers
    files = {"a/__init__.py": "from . import b\n", "a/b.py": "from .c import x\nfrom ..d import y\nfrom ...e import z\nimport a.c.K\nimport json\nimport far\n",
             "a/c/__init__.py": "from .. import b\nfrom ..c import q\n", "a/c.py": "", "d.py": "from . import a\nfrom .a.b import f\n", "a/none.txt": ""}
    df = files_df(spark, files)
    g = build_graph(df.where("path not in ('a/c.py', 'd.py')"))
    top = build_graph(df.where("path = 'd.py'"))
    got = {(r.file, r.module): (r.resolved, r["class"], r.potential_file)
           for r in classify_importers(G.append_edges(g.edges, top.edges), g.nodes, df.select("repo_id", "path")).collect()}
    assert got == {
        ("a/__init__.py", "."): ("a", "analyzed", None), ("a/b.py", ".c"): ("a.c", "internal", "a/c.py"), ("a/b.py", "..d"): ("d", "internal", "d.py"),
        ("a/b.py", "...e"): (None, "internal", None), ("a/b.py", "a.c.K"): ("a.c.K", "internal", "a/c.py"), ("a/b.py", "json"): ("json", "stdlib", None),
        ("a/b.py", "far"): ("far", "external", None), ("a/c/__init__.py", ".."): ("a", "analyzed", None),
        ("a/c/__init__.py", "..c"): ("a.c", "internal", "a/c.py"), ("d.py", "."): ("", "skipped", None), ("d.py", ".a.b"): ("a.b", "analyzed", None)}


def test_discovery_by_package(spark):
    from srcgraph.plans.discovery import discover
    files = {"pkg/main.py": "from .core import x\nimport os\n", "pkg/core.py": "from . import y\nfrom .sub.leaf import z\n", "core.py": "import nothing\n",
             "pkg/__init__.py": "# nothing\n", "pkg/sub/leaf.py": "from ..other import q\n", "pkg/other.py": "from ..far import r\n", "far.py": "x = 1\n", "lone.py": "x = 1\n"}
    reached = lambda **how: {(r.path, r.round) for r in discover(files_df(spark, files), **how).reached.collect()}
    assert reached(by_package=True) == {("pkg/main.py", 0), ("pkg/core.py", 1), ("pkg/__init__.py", 0), ("pkg/sub/leaf.py", 2), ("pkg/other.py", 3)}
    assert reached() == {("pkg/main.py", 0), ("pkg/__init__.py", 0), ("core.py", 1)}


def test_stream_batches_are_merged_once(spark, tmp_path):
    from srcgraph.sources.graph_versions import latest_version, read_version, seed_graph
    from srcgraph.streaming.incremental import merge_once
    root = str(tmp_path / "g")
    seed_graph(build_graph(files_df(spark, {"a.py": "import os\n"})), root)
    one, two = files_df(spark, {"b.py": "import sys\n"}), files_df(spark, {"c.py": "class C(B):\n  pass\n"})
    assert merge_once(one, root, "s#0") == 1
    assert merge_once(one, root, "s#0") == 1  # a retry after its version was complete
    left = tmp_path / "g" / "segments" / "v00000002" / "nodes" / "bucket=1"  # what a failed attempt left
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"half a file")
    (tmp_path / "g" / "manifests" / "v00000002").mkdir(parents=True)
    assert latest_version(spark, root) == 1
    assert merge_once(two, root, "s#1") == 2 and latest_version(spark, root) == 2
    g = read_version(spark, root)
    assert {n[1] for n in _nodes(g)} == {"os", "sys", "C", "B"} and g.edges.count() == 3


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def _same_as_merge_graph(spark, root, want):
    from srcgraph.sources.graph_versions import read_version, stored_hotspots, stored_stats
    from srcgraph.operators import stats as S
    got = read_version(spark, root)
    assert _nodes(got) == _nodes(want)
    assert _sorted(got.edges) == _sorted(want.edges)
    assert _sorted(stored_stats(spark, root)) == _sorted(S.graph_stats(want.nodes, want.edges))
    assert _sorted(stored_hotspots(spark, root)) == _sorted(S.call_hotspots(want.edges))


def _source(i, v):
    return f"import m{v}\n\ndef f{i}(a):\n    if a:\n        g{v}(a)\n    return h(a)\n\nclass C{v}(B{i}):\n    pass\n"


def test_versions_equal_a_recount_after_five_merges(spark, tmp_path):
    """Replaced files, a file that loses all its symbols, new files, full buckets written as one, expired versions."""
    from srcgraph.sources.graph_versions import complete_versions, expire_versions, merge_version, read_version, seed_graph
    root, content = str(tmp_path / "g"), {f"p{i}.py": _source(i, 0) for i in range(12)}
    whole = lambda: build_graph(files_df(spark, content), mode="scoped")
    seed_graph(whole(), root, buckets=4)
    for v in range(1, 6):
        batch = {f"p{i}.py": _source(i, v) for i in range(v, 14, 4)}
        if v == 3:
            batch["p3.py"] = "\n"
        content.update(batch)
        df = files_df(spark, batch)
        new = build_graph(df, mode="scoped", store=True, default=False)
        assert merge_version(new, root, f"b{v}", df.selectExpr("repo_id", "path AS file"), max_segments=2) == v
        got, want = read_version(spark, root), whole()
        assert _sorted(got.nodes.select(*G.NODE_COLS)) == _sorted(want.nodes.select(*G.NODE_COLS))
    _same_as_merge_graph(spark, root, G.Graph(got.nodes, want.edges))
    assert expire_versions(spark, root, keep=1) > 0 and complete_versions(spark, root) == [5]
    _same_as_merge_graph(spark, root, G.Graph(read_version(spark, root).nodes, want.edges))
    assert expire_versions(spark, root, keep=1) == 0


def test_appending_versions_equal_merge_graph(spark, tmp_path):
    from srcgraph.sources.graph_versions import seed_graph
    from srcgraph.streaming.incremental import merge_once
    root = str(tmp_path / "g")
    files = lambda v, ids: files_df(spark, {f"p{i}.py": _source(i, v) for i in ids})
    want = build_graph(files(0, range(5)), mode="scoped")
    seed_graph(want, root, buckets=3)
    for v, ids in ((1, (0, 1, 7)), (2, (1,)), (3, ())):
        want = merge_files(want, files(v, ids), mode="scoped")
        merge_once(files(v, ids), root, f"b{v}", "scoped")
    _same_as_merge_graph(spark, root, want)


def test_a_merge_writes_in_proportion_to_its_batch(spark, tmp_path):
    from srcgraph.sources.graph_versions import read_version, seed_graph
    from srcgraph.streaming.incremental import merge_once
    root = tmp_path / "g"
    seed_graph(build_graph(files_df(spark, {f"p{i}.py": _source(i, 0) for i in range(200)}), mode="scoped"), str(root), buckets=32)
    merge_once(files_df(spark, {"p7.py": _source(7, 1)}), str(root), "one", "scoped", replace_files=True)
    size = lambda v, t: sum(f.stat().st_size for f in (root / "segments" / f"v{v:08d}" / t).rglob("part-*"))
    for t in ("nodes", "edges"):
        assert len(list((root / "segments" / "v00000001" / t).glob("bucket=*"))) == 1
        assert size(1, t) < size(0, t) / 16
    assert len(_nodes(read_version(spark, str(root)))) == len(_nodes(read_version(spark, str(root), 0)))


def test_empty_graph_takes_a_merge(spark, tmp_path):
    from srcgraph.sources.graph_versions import read_version, seed_graph, stored_stats
    from srcgraph.streaming.incremental import merge_once
    root = str(tmp_path / "g")
    seed_graph(build_graph(files_df(spark, {"a.txt": "x"})), root)
    assert stored_stats(spark, root).count() == 0 and read_version(spark, root).nodes.count() == 0
    merge_once(files_df(spark, {"a.py": "import os\n"}), root, "b")
    assert _nodes(read_version(spark, root)) == [("a.py", "os", "module", 1)]
    assert [r.asDict() for r in stored_stats(spark, root).collect()] == [
        dict(repo_id="r", total_symbols=1, classes=0, functions=0, modules=1, total_edges=1, inheritance_edges=0, call_edges=0, import_edges=1)]


def test_cleared_tables_are_made_again(spark):
    from srcgraph.session import clear_tables, materialize, remembered
    make = lambda: materialize(spark.range(3), "three")
    assert remembered(spark, "three", make) is remembered(spark, "three", make)
    clear_tables(spark)
    assert remembered(spark, "three", make).count() == 3


def test_no_machine_local_checkpoint_on_a_cluster():
    import pytest

    from srcgraph.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_both_plans_of_pattern_lookup_agree(spark):
    import random

    from srcgraph.operators.lookup import pattern_lookup
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab:") for _ in range(n))
    e = spark.createDataFrame([("r", f"s{i}", text(rng.randint(0, 20)), rng.choice(["calls", "inherits"])) for i in range(200)],
                              "repo_id string, source string, target string, type string")
    p = spark.createDataFrame([(text(rng.randint(0, 12)), rng.choice(["calls", "inherits"])) for _ in range(60)], "pattern string, type string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(pattern_lookup(e, p)) == rows(pattern_lookup(e, p, max_broadcast=0)) != []


def test_file_rows_are_the_files_of_the_tree(spark):
    from srcgraph.operators.tree import file_rows
    paths = ["b.py", "A/x.py", "venv/z.py", "A/.git/q.py", "C/D/e.txt", "venv"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(file_rows(df)) == rows(file_tree(df).where("type = 'file'"))


def test_repository_without_a_seed_has_a_row(spark):
    d = discover(files_df(spark, {"main.py": "x = 1\n"}), spark.createDataFrame([("r", "main.py"), ("q", "README.md")], "repo_id string, path string"))
    assert {(r.repo_id, r.discovery_rounds, r.files_reached) for r in d.rounds.collect()} == {("r", 1, 1), ("q", 1, 0)}


def test_directory_source_reads_each_file_once(spark, tmp_path):
    from srcgraph.sources.directory import register
    for p in ("r/a.py", "r/x/__init__.py", "r/x/y/b.py", "r/x/venv/c.py", "r/node_modules/d.py", "q/e.txt", "q/z/.f.py", "r/.py"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(p)
    register(spark)
    got = sorted((r.repo_id, r.path, r.content) for r in spark.read.format("srcdir").option("path", str(tmp_path)).load().collect())
    assert [g[:2] for g in got] == [("q", "z/.f.py"), ("r", "a.py"), ("r", "x/__init__.py"), ("r", "x/y/b.py")]


def test_written_tables_can_be_cleared(spark):
    import os

    from srcgraph.session import clear_tables, materialize, scratch_path
    materialize(spark.range(3), "t", key="clear-test")
    folder = scratch_path(spark, "tables").removeprefix("file:")
    assert os.listdir(folder)
    clear_tables(spark)
    assert not os.path.exists(folder)
    assert materialize(spark.range(3), "t", key="clear-test").count() == 3


def test_files_that_parse(spark):
    from srcgraph.functions.pysource import parses
    good = ["", "x = 1\n", "def f(\n    a,\n        b):\n    return {a: [b]}\n", "s = 'it\\\\'\nt = \"# (\"\n", "s = '''a ( \\''' b '''\n",
            "# ( [\nif x:  # then\n\n    y\nz\n", "x = 1 + \\\n      2\n", '"""doc"""\n', '""\n', '""""""\n', "class A: pass\nfor i in x:\n\ty\n",
            "s = 'a\\\n  b'\n"]
    bad = ["x = [1, (2, 3)\n", "x = (1]\n", "x = 1)\n", "s = 'open\n", 's = """open\ndef f(): pass\n', 's = """open"\n', '"""', 's = "a\\"\n',
           "  x = 1\n", "x = 1\n    y = 2\n", "def f(): pass\n    y = 2\n", "'''a\\'''\n", "f((a)\n"]
    df = spark.createDataFrame(list(enumerate(good + bad)), "i int, content string")
    got = {r.i: r.ok for r in df.select("i", parses(F.col("content")).alias("ok")).collect()}
    assert [got[i] for i in range(len(got))] == [True] * len(good) + [False] * len(bad)


def test_parser_chosen_per_file(spark):
    whole = "def a():\n    def b():\n        c()\n"
    broken = "x = [1\ndef a():\n    if y:\n        c()\nclass D(E):\n    pass\n"
    files = files_df(spark, {"whole.py": whole, "broken.py": broken, "empty.py": "", "other.txt": "x = ["})
    g = build_graph(files, mode="auto")
    nodes = {(r.file, r.name, r.kind, r.complexity) for r in g.nodes.collect()}
    assert nodes == {("whole.py", "a", "function", 1), ("whole.py", "b", "function", 1), ("whole.py", "c", "function", 1),
                     ("broken.py", "a", "function", 2), ("broken.py", "D", "class", 1), ("broken.py", "E", "class", 1)}
    assert {(r.source, r.target, r.type) for r in g.edges.collect()} == {
        ("whole.py:b", "whole.py:c", "calls"), ("broken.py:D", "broken.py:E", "inherits")}
    for only, mode in ((whole, "scoped"), (broken, "line")):
        f = files_df(spark, {"f.py": only})
        assert sorted(map(str, build_graph(f, mode="auto").nodes.collect())) == sorted(map(str, build_graph(f, mode=mode).nodes.collect()))
