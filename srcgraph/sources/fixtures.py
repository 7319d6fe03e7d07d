"""F1-F6, F8-F11 of FIXTURES.md, derived with the DataFrame API from the driver tables.

The driver tables hold no source code, so code-shaped input is generated from ``part``
(one file per part, ``repo_id`` from the brand). Every fixture scales with its table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lead_in_group(df: DataFrame, keys: list[str], order_col: str, value_col: str, out_col: str,
                  bucket_width: int = 1 << 16) -> DataFrame:
    """``lead(value) OVER (PARTITION BY keys ORDER BY order_col)`` without one task per group.

    A plain window puts a whole group into one task, so a hot group (a third of all rows)
    would become one straggler. Rows are cut into buckets of ``order_col``; the lead is taken
    inside ``(keys, bucket)`` and the last row of a bucket takes the first value of the next
    non-empty bucket, found over the per-bucket summary (``bucket_width`` times fewer rows).
    """
    b = F.floor(F.col(order_col) / F.lit(bucket_width)).cast("long")
    d = df.withColumn("_bkt", b)
    w = Window.partitionBy(*keys, "_bkt").orderBy(order_col)
    d = d.withColumn(out_col, F.lead(value_col).over(w))
    heads = d.groupBy(*keys, "_bkt").agg(F.min_by(value_col, order_col).alias("_head"))
    wb = Window.partitionBy(*keys).orderBy("_bkt")
    heads = heads.select(*keys, "_bkt", F.lead("_head").over(wb).alias("_next_head"))
    d = d.join(heads, [*keys, "_bkt"], "left")
    return d.withColumn(out_col, F.coalesce(F.col(out_col), F.col("_next_head"))).drop("_bkt", "_next_head")


def f1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of F1: ``(p_partkey, p_size, repo_id, path)``."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    path = (F.when(k % 40 == 0, F.concat(F.lit("pkg_"), k.cast("string"), F.lit("/__init__.py")))
            .when(k % 40 == 1, F.concat(F.lit("pkg_"), k.cast("string"), F.lit("/main.py")))
            .otherwise(F.concat(F.lower("p_type"), F.lit("/mod_"), k.cast("string"), F.lit(".py"))))
    return p.select("p_partkey", "p_size", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("repo_id"),
                    path.alias("path"))


def f1_source_files(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    """F1 ``source_files(repo_id, path, content)``: one Python-like file per ``part`` row.

    Each file imports ``os``, ``lib<k>`` and the next file of its repository (a chain for
    the discovery loop), defines a class with two bases (one is ``object``), two methods
    and a helper whose complexity is ``1 + p_size``.
    """
    paths = f1_paths(spark, sf_dir)
    # dealt before the text is made, which is many times larger than its row of the table
    q = dealt(lead_in_group(paths, ["repo_id"], "p_partkey", "path", "nxt"), "repo_id", "path", like=paths)
    nl = F.lit("\n")
    size = F.col("p_size")
    s = lambda c: c.cast("string")
    nxt_mod = F.replace(F.replace(F.col("nxt"), F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))
    content = F.concat(
        F.lit("import os"), nl,
        F.lit("import lib"), s(size % 7), nl,
        F.when(F.col("nxt").isNull(), F.lit("import json")).otherwise(F.concat(F.lit("import "), nxt_mod)), nl,
        F.lit("class C"), s(F.col("p_partkey") % 9), F.lit("(Base"), s(size % 5), F.lit(", object):"), nl,
        F.lit("    def run(self): pass"), nl,
        F.lit("    def load_"), s(size), F.lit("(self, x):"), nl,
        F.repeat(F.concat(F.lit("        if x and helper_"), s(size % 4), F.lit("(x):"), nl), size),
        F.lit("def helper_"), s(size % 4), F.lit("(x):"), nl,
        F.lit("    return run(x)"), nl)
    cols = ["repo_id", "path", content.alias("content")]
    if with_key:
        cols = ["p_partkey"] + cols
    return q.select(*cols)


def f11_long_sources(spark: SparkSession, sf_dir: str, parts: int = 1000) -> DataFrame:
    """F11 ``source_files``: the files of F1 whose part numbers stand together, ``parts`` numbers at most, as one file
    per repository; its functions, classes and imports follow each other as in files a person never wrote."""
    f = f1_source_files(spark, sf_dir, with_key=True).withColumn("g", F.floor(F.col("p_partkey") / parts))
    f = f.groupBy("repo_id", "g").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "content"))).alias("f"))
    return f.select("repo_id", F.concat(F.lit("long/m"), F.col("g").cast("string"), F.lit(".py")).alias("path"),
                    F.array_join("f.content", "").alias("content"))


def f8_wrapped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 ``(p_partkey, repo_id, path, content)``: one file per ``part`` row whose signatures, bases, calls, imports
    and strings span lines, with quotes and brackets in comments and strings. What it holds follows from
    ``p_partkey`` alone (see ``scoped_wrapped`` in the oracle), so checking it parses no text again."""
    k = F.col("p_partkey")
    m = lambda n: (k % n).cast("string")
    lines = [
        "\"\"\"doc with ''' and # and def fake(): (", "def not_me():", "\"\"\"",
        "RX = '\"\"\"'  # comment with ''' and (",
        ["class C", m(9), "("], ["    Base", m(5), ","], ["    f(g(h(X", m(3), "))),"], ["    Gen", m(4), "[T],"], "    metaclass=Meta,", "):",
        "    def run(", "        self,", ["        a=mk", m(4), "(1),"], "    ):",
        "        s = \"text with ( and # and \\\" def x():\"",
        ["        helper_", m(6), "("], "            a,", ["            inner_", m(7), "(s),"], "        )",
        "        t = '''", "def nope():", "    lost()", "'''.strip()",
        "        return obj.method(t) + \\", ["            last_", m(8), "()"],
        "x = top()", ["from ..pkg", m(3), ".mod import ("], "    a,", "    b,", ")",
    ]
    text = F.concat(*[x for l in lines for x in [*[y if not isinstance(y, str) else F.lit(y) for y in ([l] if isinstance(l, str) else l)], F.lit("\n")]])
    return dealt(f1_paths(spark, sf_dir), "repo_id", "path").select("p_partkey", "repo_id", "path", text.alias("content"))


def f9_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 ``(p_partkey, repo_id, path, content)``: one file per ``part`` row that parses (``p_partkey % 4`` = 0), has an open bracket (1), an open
    string (2) or a line without an owner (3), each followed by a function that the scoped parser would lose or misplace."""
    k = F.col("p_partkey")
    m = lambda n: (k % n).cast("string")
    head = F.concat(F.lit("class C"), m(9), F.lit("(Base"), m(5), F.lit("):\n    def run(self):\n        helper_"), m(6), F.lit("()\n"))
    middle = (F.when(k % 4 == 0, F.lit("x = {'a': [1, (2, 3)], 'b': \"])\"}  # ((\n")).when(k % 4 == 1, F.lit("x = [1, (2, 3)\n"))
              .when(k % 4 == 2, F.lit("x = \"\"\"never closed\n")).otherwise(F.lit("x = 1\n        y = 2\n")))
    text = F.concat(head, middle, F.lit("def tail_"), m(7), F.lit("(a):\n    if a:\n        run(a)\n"))
    return dealt(f1_paths(spark, sf_dir), "repo_id", "path").select("p_partkey", "repo_id", "path", text.alias("content"))


def f10_package_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 ``(p_partkey, repo_id, path, content)``: nested packages of eight files per eight ``part`` rows (every other
    package lacks ``sub/leaf.py``), each file with the same imports: of its package, of a module beside it, one and
    two levels up, of a name in a module from the root, and of others."""
    k = F.col("p_partkey")
    g, s = F.floor(k / 8).cast("long"), lambda c: c.cast("string")
    p = F.concat(F.lit("p"), s(g), F.lit("/"))
    names = [F.concat(p, F.lit(x)) for x in ("__init__.py", "core.py", "sub/__init__.py", "sub/leaf.py", "sub/deep/inner.py", "main.py")]
    names += [F.concat(p, F.lit("sub/util_"), s(k), F.lit(".py")), F.concat(F.lit("top_"), s(k), F.lit(".py"))]
    text = F.concat(F.lit("import os\nfrom . import core\nfrom .core import x\nfrom ..sub.leaf import y\nfrom ...top import z\nimport p"), s(g),
                    F.lit(".sub.leaf.name\nimport App"), s(k % 3), F.lit(".y\ndef f(a):\n    return a\n"))
    rows = dealt(table(spark, sf_dir, "part").where(k % 16 != 11).select("p_partkey"), "p_partkey")
    return rows.select("p_partkey", F.concat(F.lit("repo"), s(g % 25)).alias("repo_id"), F.element_at(F.array(*names), (k % 8 + 1).cast("int")).alias("path"),
                       text.alias("content"))


def f2_repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 ``repo_urls(req_id, repo_url)``: one URL per ``pages`` row, twelve shapes."""
    pg = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    s = lambda c: c.cast("string")
    m = i % 12
    url = (F.when(m == 0, F.concat(F.lit("https://github.com/org"), s(i % 7), F.lit("/repo"), s(i), F.lit(".git")))
           .when(m == 1, F.concat(F.lit("  https://github.com/org1/repo"), s(i), F.lit("/tree/main//  ")))
           .when(m == 2, F.lit("https://github.com/onlyowner"))
           .when(m == 3, F.concat(F.lit("https://gitlab.com/g/sub/p"), s(i), F.lit("/")))
           .when(m == 4, F.lit("https://bitbucket.org"))
           .when(m == 5, F.lit("https://www.github.com/o/r"))
           .when(m == 6, F.lit("https://github.com/o!/r"))
           .when(m == 7, F.lit(""))
           .when(m == 8, F.lit(None).cast("string"))
           .when(m == 9, F.lit("github.com/o/r"))
           .when(m == 10, F.concat(F.lit("https://github.com/me/my.github"), s(i)))
           .otherwise(F.col("url")))
    return pg.select(i.alias("req_id"), url.alias("repo_url"))


def f3_file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 ``(repo_id, path)`` of all files: F1 paths plus README, package and decoy files."""
    p = table(spark, sf_dir, "part")
    r = p.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("repo_id"),
                 F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("k")).distinct()
    k = F.col("k")
    extra = [("README.md", k % 2 == 0), ("README.rst", k % 3 == 0), ("README.txt", k % 5 == 0),
             ("requirements.txt", k % 4 == 0), ("setup.py", k % 3 == 0), ("pyproject.toml", k % 2 == 1),
             ("docs/setup.py", F.lit(True)), ("venv/lib/app.py", F.lit(True)), ("tools/cli.py", k % 6 == 0)]
    out = f1_paths(spark, sf_dir).select("repo_id", "path")
    for name, cond in extra:
        out = out.unionByName(r.where(cond).select("repo_id", F.lit(name).alias("path")))
    return out


def f4_readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 ``readmes(doc_id, repo_id, text)`` from ``documents``."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), "text")


def f5_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 ``edges(repo_id, file, source, target, type)`` at volume.

    ``calls``: lineitem supplier -> part; ``inherits``: customer -> nation;
    ``imports``: nation -> region. One repository ``tpch``; node keys keep ``file:name``.
    """
    s = lambda c: F.col(c).cast("string")
    li = table(spark, sf_dir, "lineitem").select(
        F.lit("tpch").alias("repo_id"), F.lit("supplier").alias("file"),
        F.concat(F.lit("supplier:"), s("l_suppkey")).alias("source"),
        F.concat(F.lit("part:"), s("l_partkey")).alias("target"), F.lit("calls").alias("type"))
    cu = table(spark, sf_dir, "customer").select(
        F.lit("tpch").alias("repo_id"), F.lit("customer").alias("file"),
        F.concat(F.lit("customer:"), s("c_custkey")).alias("source"),
        F.concat(F.lit("nation:"), s("c_nationkey")).alias("target"), F.lit("inherits").alias("type"))
    na = table(spark, sf_dir, "nation").select(
        F.lit("tpch").alias("repo_id"), F.lit("nation").alias("file"),
        F.concat(F.lit("nation:"), s("n_nationkey")).alias("source"),
        F.concat(F.lit("region:"), s("n_regionkey")).alias("target"), F.lit("imports").alias("type"))
    return li.unionByName(cu).unionByName(na)


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo_id, repo_url)`` of the F1 repositories; every seventh brand has a URL on an
    unsupported host (refused), two of three others one that has to be normalised."""
    p = table(spark, sf_dir, "part")
    r = p.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("repo_id"),
                 F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("k")).distinct()
    url = F.when(F.col("k") % 7 == 0, F.concat(F.lit("https://example.org/"), F.col("repo_id"))) \
        .otherwise(F.concat(F.lit("https://github.com/srcgraph-fixtures/"), F.col("repo_id"),
                            F.when(F.col("k") % 3 == 1, ".git").when(F.col("k") % 3 == 2, "/tree/main/").otherwise("")))
    return r.select("repo_id", url.alias("repo_url"))


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo_id, analyze_deep)``: one request per F1 repository, deep for odd brands."""
    p = table(spark, sf_dir, "part")
    k = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    return p.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("repo_id"), (k % 2 == 1).alias("analyze_deep")).distinct()


def repo_readmes(spark: SparkSession, sf_dir: str, picked: DataFrame) -> DataFrame:
    """``(repo_id, text)``: for each repository with a README (``picked``), the first
    document (lowest ``doc_id``) of source ``src<k mod 20>``."""
    docs = (table(spark, sf_dir, "documents").groupBy("source")
            .agg(F.min_by("text", "doc_id").alias("text")))
    k = F.replace("repo_id", F.lit("brand"), F.lit("")).cast("int")
    r = picked.select("repo_id", F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"))
    return r.join(docs, "source", "left").select("repo_id", F.coalesce("text", F.lit("")).alias("text"))
