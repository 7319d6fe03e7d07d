"""LIN1-LIN8: the line parser (``mode="line"``) as generators and running windows.

The parser is a state machine over the stripped lines of one file. It is rebuilt as:

* LIN1 ``source_lines``: ``posexplode`` of the split text; one row per line.
* ``line_features``: per-line classification and the texts the symbols need. This runs
  before the exchange, so the wide ``raw``/``line`` text is pruned away and only short
  columns are shuffled; plans without per-file state (LIN1-LIN3, LIN6-LIN8) have no exchange.
* LIN4/LIN5/WIN5 ``function_segments``: four running windows that share one partitioning
  ``(repo_id, path)`` and one ordering ``n`` (one exchange, one sort):
  ``seg`` = running count of ``def`` lines; ``cum`` = running count of body-candidate lines;
  ``base`` = ``cum`` just before the current segment's ``def`` line; a ``class`` line closes
  the open function only if the segment already has a body line (``cum - base > 0``);
  a body line counts only while its segment has not been closed.
  A group-by on ``(repo_id, path, seg)`` then yields one function per segment; it reuses
  the same hash partitioning, so it adds no shuffle.

A file is one input row, so a window group here never exceeds one file's lines; hot
repositories do not concentrate on one key because the key includes the path. Files too long
for one task go by chunks of lines instead (``operators.chunks``), with the same rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BRANCH_KEYWORDS
from ..functions.pysource import bind
from ..functions.text import line_pieces, py_strip, stripped_pieces

FILE_KEYS = ["repo_id", "path"]
_MAXINT = 2147483647
_WS = "[\\s\\x1c-\\x1f]"


def has_branch(c):
    """LIN5 test: the line contains one of the branch keywords (plain substring tests)."""
    out = None
    for kw in BRANCH_KEYWORDS:
        t = c.contains(kw)
        out = t if out is None else (out | t)
    return out


def source_lines(files: DataFrame) -> DataFrame:
    """LIN1: ``(repo_id, path, n, raw, line)``; ``n`` counts from 1, ``line`` is stripped.

    A file is one row, so its lines are made where it is read: no exchange moves a text. Plans that
    need a file's lines together (``line_windows``) shuffle the short feature columns instead.
    """
    d = files.where(F.col("content") != "")
    d = d.select("repo_id", "path", F.posexplode(line_pieces("content")).alias("i", "raw"))
    return d.select("repo_id", "path", (F.col("i") + 1).cast("int").alias("n"), "raw", py_strip("raw").alias("line"))


def line_kind(s):
    """``class`` / ``def`` / ``import`` / ``from`` / ``body``: the first prefix that the stripped line has."""
    return (F.when(s.startswith("class "), "class")
            .when(s.startswith("def "), "def")
            .when(s.startswith("import "), "import")
            .when(s.startswith("from "), "from")
            .otherwise("body"))


def def_text(s):
    return F.split_part(F.split_part(s, F.lit("def "), F.lit(2)), F.lit("("), F.lit(1))


def rest_text(s):
    """What stands behind ``):`` on a ``def`` line."""
    at = F.instr(s, "):")
    return F.when(at > 0, py_strip(F.substring(s, at + 2, F.lit(_MAXINT)))).otherwise(F.lit(""))


def import_text(s):
    return F.regexp_extract(F.split_part(s, F.lit("import "), F.lit(2)), f"(?U)^{_WS}*([^\\s\\x1c-\\x1f]+)", 1)


def from_text(s):
    return py_strip(F.split_part(F.split_part(s, F.lit("from "), F.lit(2)), F.lit(" import"), F.lit(1)))


def line_features(lines: DataFrame, keys: list[str] = FILE_KEYS) -> DataFrame:
    """Classify each stripped line and extract names (LIN2, LIN3, LIN6, LIN7 texts).

    ``kind``: ``class`` / ``def`` / ``import`` / ``from`` / ``body`` (first matching prefix).
    ``keys`` are the columns that name what the lines are counted in.
    """
    s = F.col("line")
    kind = line_kind(s)
    cls_part = F.split_part(s, F.lit("class "), F.lit(2))
    has_paren = cls_part.contains("(")
    cls_name = F.when(has_paren, F.split_part(cls_part, F.lit("("), F.lit(1))) \
        .otherwise(F.split_part(cls_part, F.lit(":"), F.lit(1)))
    bases_txt = F.split_part(F.split_part(cls_part, F.lit("("), F.lit(2)), F.lit(")"), F.lit(1))
    bases = F.when(has_paren, F.filter(F.transform(F.split(bases_txt, ","), lambda b: py_strip(b)),
                                       lambda b: (b != "") & (b != "object"))) \
        .otherwise(F.array().cast("array<string>"))
    def_name, def_rest, imp_tok, from_mod = def_text(s), rest_text(s), import_text(s), from_text(s)
    k = F.col("kind")
    return (lines.withColumn("kind", kind).select(
        *keys, "n", "kind",
        F.when(k == "class", cls_name).alias("class_name"),
        F.when(k == "class", bases).alias("bases"),
        F.when(k == "def", def_name).alias("def_name"),
        F.when(k == "import", imp_tok).when(k == "from", from_mod).alias("module"),
        # body candidate: any other line, or the text after "):" on a def line
        F.when(k == "def", def_rest != "").otherwise(k == "body").alias("cand"),
        F.when(k == "def", has_branch(def_rest)).otherwise((k == "body") & has_branch(s)).alias("branch"),
    ))


def line_windows(feats: DataFrame) -> DataFrame:
    """WIN5 + LIN4 running state per line (one exchange on ``(repo_id, path)``, one sort).

    Adds ``seg`` (running count of ``def`` lines), ``closer`` (this class line closes the
    open function) and ``body`` (the line is a counted body line of its segment's function).
    Every symbol kind is derived from this one frame, so the scan, the explode and the
    exchange run once and later branches read the same shuffle output.
    """
    w = Window.partitionBy(*FILE_KEYS).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.col("kind")
    # level 1: running count of def lines and of body candidates (one window operator)
    d = feats.select("*", F.sum((k == "def").cast("int")).over(w).alias("seg"),
                     F.sum(F.col("cand").cast("int")).over(w).alias("cum"))
    # level 2: candidates counted before the current segment's def line
    d = d.withColumn("base", F.max(F.when(k == "def", F.col("cum") - F.col("cand").cast("int"))).over(w))
    d = d.withColumn("closer", (k == "class") & (F.col("seg") > 0) & (F.col("cum") - F.col("base") > 0))
    # level 3: the latest segment closed by a class line so far
    d = d.withColumn("closed_seg", F.max(F.when(F.col("closer"), F.col("seg"))).over(w))
    d = d.withColumn("body", F.col("cand") & (F.col("seg") > 0)
                     & ~F.coalesce(F.col("closed_seg") == F.col("seg"), F.lit(False)))
    return d.drop("cum", "base", "closed_seg", "cand")


def function_segments(win: DataFrame) -> DataFrame:
    """LIN4 + LIN5: one row per emitted function, from ``line_windows`` output.

    Columns: ``repo_id, path, seg, name, complexity, body_lines, pos`` where ``pos`` is
    ``(n, sub)``: ``(closing class line, 0)`` or ``(last line of the segment, 2)``.
    The group-by reuses the ``(repo_id, path)`` partitioning: no new exchange.
    """
    g = (win.where(F.col("seg") > 0)
         .groupBy("repo_id", "path", "seg")
         .agg(F.max("def_name").alias("name"),
              F.count_if(F.col("body")).alias("body_lines"),
              F.count_if(F.col("body") & F.col("branch")).alias("n_branch"),
              F.min(F.when(F.col("closer"), F.col("n"))).alias("close_n"),
              F.max("n").alias("last_n")))
    return (g.where((F.col("body_lines") > 0) & (F.col("name") != ""))
            .select("repo_id", "path", "seg", "name",
                    (F.col("n_branch") + 1).cast("int").alias("complexity"),
                    "body_lines",
                    F.when(F.col("close_n").isNotNull(), F.struct(F.col("close_n").alias("n"), F.lit(0).alias("sub")))
                    .otherwise(F.struct(F.col("last_n").alias("n"), F.lit(2).alias("sub"))).alias("pos")))


def _pos(n, sub: int):
    """Position inside a file: (line, sub, edge, item). Endpoint rows use line = MAXINT."""
    return F.struct(F.col(n).cast("int").alias("n") if isinstance(n, str) else n.cast("int").alias("n"),
                    F.lit(sub).alias("sub"), F.lit(0).alias("e"), F.lit(0).alias("i"))


def line_symbols(win: DataFrame) -> DataFrame:
    """LIN2 + LIN4 + LIN7 + LIN8: symbols ``(repo_id, path, pos, name, kind, complexity)``.

    Functions are emitted when they close (before the closing class line's own symbol);
    classes and import roots (``module``) at their line. Class and module symbols carry
    complexity 1, which replaces an earlier value of the same key (last given wins).
    """
    funcs = function_segments(win).select(
        "repo_id", "path",
        F.struct(F.col("pos.n").alias("n"), F.col("pos.sub").alias("sub"), F.lit(0).alias("e"), F.lit(0).alias("i")).alias("pos"),
        "name", F.lit("function").alias("kind"), "complexity")
    classes = win.where(F.col("kind") == "class").select(
        "repo_id", "path", _pos("n", 1).alias("pos"), F.col("class_name").alias("name"),
        F.lit("class").alias("kind"), F.lit(1).alias("complexity"))
    modules = import_lines(win).select(
        "repo_id", "path", _pos("n", 1).alias("pos"),
        F.split_part(F.col("module"), F.lit("."), F.lit(1)).alias("name"),
        F.lit("module").alias("kind"), F.lit(1).alias("complexity"))
    return funcs.unionByName(classes).unionByName(modules)


def import_lines(feats: DataFrame) -> DataFrame:
    """LIN6: ``(repo_id, path, n, module)`` for ``import``/``from`` lines.

    ``import a.b, c`` keeps only the first whitespace token (``a.b,``); ``from x import y``
    gives ``x`` (possibly empty). An ``import`` line with no token after ``import `` names
    nothing and is skipped (the line parser this mirrors fails on it).
    """
    k = F.col("kind")
    return (feats.where((k == "from") | ((k == "import") & (F.col("module") != "")))
            .select("repo_id", "path", "n", "module"))


def class_bases(feats: DataFrame) -> DataFrame:
    """LIN3: ``(repo_id, path, n, i, class_name, base)``; ``object`` and empty pieces dropped."""
    return (feats.where(F.col("kind") == "class")
            .select("repo_id", "path", "n", "class_name", F.posexplode("bases").alias("i", "base")))


def class_symbols(feats: DataFrame) -> DataFrame:
    """LIN2: ``(repo_id, path, n, name)`` of class lines."""
    return feats.where(F.col("kind") == "class").select("repo_id", "path", "n", F.col("class_name").alias("name"))


def NONE_S():
    return F.lit(None).cast("string")


def NONE_I():
    return F.lit(None).cast("int")


def gpos(pn, sub, e=0, i=0):
    """Graph-order position ``(n, sub, e, i)`` (see ``operators.graph``)."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.struct(lit(pn).cast("int").alias("n"), lit(sub).cast("int").alias("sub"),
                    lit(e).cast("int").alias("e"), lit(i).cast("int").alias("i"))


def grow(tag, name, kind, cx, p, src=None, tgt=None, typ=None):
    """One tagged row: a symbol row (``sym``) or an edge row (``edge``)."""
    src, tgt, typ = [NONE_S() if x is None else x for x in (src, tgt, typ)]
    lit = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    return F.struct(F.lit(tag).alias("tag"), lit(name).cast("string").alias("name"),
                    lit(kind).cast("string").alias("kind"), lit(cx).cast("int").alias("complexity"),
                    p.alias("pos"), src.alias("source"), tgt.alias("target"), typ.alias("type"))


_ROW_ARRAY = ("array<struct<tag:string,name:string,kind:string,complexity:int,"
              "pos:struct<n:int,sub:int,e:int,i:int>,source:string,target:string,type:string>>")


def line_graph_rows(win: DataFrame) -> DataFrame:
    """LIN2-LIN8 + GRF5-GRF7 in one pass over ``line_windows`` output.

    A window over ``(repo_id, path, seg)`` (same partitioning, one extra sort) puts each
    function's totals on its ``def`` line; then every line emits, through one ``explode``,
    its symbol rows (``tag = 'sym'``: the function that starts here, the class or import
    root of the line, the endpoint rows of its bases) and its edge rows (``tag = 'edge'``:
    ``inherits`` per base, ``imports``). Nothing is computed twice, and the node group-by
    on ``(repo_id, path, name)`` needs no new exchange.
    """
    ws = Window.partitionBy("repo_id", "path", "seg")
    body = F.col("body").cast("int")
    d = win.select("*",
                   F.sum(body).over(ws).alias("seg_body"),
                   F.sum((F.col("body") & F.col("branch")).cast("int")).over(ws).alias("seg_branch"),
                   F.min(F.when(F.col("closer"), F.col("n"))).over(ws).alias("close_n"),
                   F.max("n").over(ws).alias("last_n"))
    return emitted_rows(d.where(F.col("kind") != "body"))  # only these lines emit rows


def function_module_rows(files: DataFrame) -> DataFrame:
    """LIN1, LIN4-LIN8: the ``sym`` rows of functions and modules among ``line_graph_rows``, found in the file's row:
    no line leaves it, no window and no sort is needed.

    A line is a letter: ``c`` a class line, ``i`` an import line, ``d`` a ``def`` line without text behind it, ``D`` one
    with such text and ``E`` with a branch in it, ``b`` and ``B`` other lines without and with a branch. The letters of a
    function are those from its ``def`` line to the next. It is closed by the first ``c`` behind a body line.
    """
    def letter(s):
        rest = rest_text(s)
        return (F.when(s.startswith("class "), "c").when(s.startswith("def "), F.when(rest == "", "d").when(has_branch(rest), "E").otherwise("D"))
                .when(s.startswith("import ") | s.startswith("from "), "i").when(has_branch(s), "B").otherwise("b"))

    item = lambda n, seg, s: F.struct(n.cast("int").alias("n"), seg.alias("seg"), s.alias("s"))

    # each def line begins a record of its own: its number, a blank and the letters; the lines before the first are no function
    def functions(ls):
        coded = F.array_join(F.transform(ls, lambda s, i: F.when(s.startswith("def "), F.concat(
            F.lit("\n"), (i + 1).cast("string"), F.lit(" "), letter(s))).otherwise(letter(s))), "")
        records = F.filter(F.split(coded, "\n", -1), lambda r: r.contains(" "))
        return F.transform(records, lambda r: bind(F.substring_index(r, " ", 1).cast("int"), lambda n: item(
            n, F.substring_index(r, " ", -1), F.get(ls, n - 1))))

    def imports(ls):
        found = F.transform(ls, lambda s, i: F.when(s.startswith("import ") | s.startswith("from "), item(i + 1, NONE_S(), s)))
        return F.filter(found, lambda r: r.isNotNull())

    records = bind(stripped_pieces("content"), lambda ls: F.concat(functions(ls), imports(ls)))
    d = files.where(F.col("content") != "").select("repo_id", "path", F.explode(records).alias("r"))
    d = d.select("repo_id", "path", "r.n", "r.seg", "r.s", F.col("r.seg").isNull().alias("is_imp"))
    s, seg, n, imp = F.col("s"), F.col("seg"), F.col("n"), F.col("is_imp")
    body = F.regexp_extract(seg, "^(?:d[ic]*+)?[^c]*+", 0)  # up to the line that closes the function
    module = F.when(s.startswith("import "), import_text(s)).otherwise(from_text(s))
    d = d.select("repo_id", "path", imp.alias("imp"), n.alias("n"), F.length(seg).alias("all"), F.when(~imp, body).alias("body"),
                 F.when(imp, module).otherwise(def_text(s)).alias("text"), (imp & s.startswith("from ")).alias("from"))
    open_ = F.length("body")
    closed = open_ < F.col("all")
    d = d.where(F.when(imp_ := F.col("imp"), F.col("from") | (F.col("text") != "")).otherwise(
        (F.col("text") != "") & (F.length(F.regexp_replace("body", "[dic]+", "")) > 0)))
    return d.select(
        "repo_id", "path", F.lit("sym").alias("tag"), F.when(imp_, F.split_part("text", F.lit("."), F.lit(1))).otherwise(F.col("text")).alias("name"),
        F.when(imp_, "module").otherwise("function").alias("kind"),
        F.when(imp_, 1).otherwise(F.length(F.regexp_replace("body", "[^BE]+", "")) + 1).alias("complexity"),
        gpos(F.when(imp_, F.col("n")).when(closed, F.col("n") + open_).otherwise(F.col("n") + F.col("all") - 1),
             F.when(imp_, 1).when(closed, 0).otherwise(2)).alias("pos"),
        NONE_S().alias("source"), NONE_S().alias("target"), NONE_S().alias("type"))


def emitted_rows(d: DataFrame) -> DataFrame:
    """The tagged rows of class, def and import lines; a def line carries its function's ``seg_body``, ``seg_branch``,
    ``close_n`` and ``last_n``."""
    k, n, path = F.col("kind"), F.col("n"), F.col("path")
    none_s, none_i, pos, row = NONE_S(), NONE_I(), gpos, grow
    empty = F.array().cast(_ROW_ARRAY)
    closed = F.col("close_n").isNotNull()
    func = F.when((k == "def") & (F.col("seg_body") > 0) & (F.col("def_name") != ""), F.array(row(
        "sym", F.col("def_name"), "function", F.col("seg_branch") + 1,
        pos(F.coalesce("close_n", "last_n"), F.when(closed, 0).otherwise(2)))))
    cname = F.col("class_name")
    cls = F.when(k == "class", F.concat(
        F.array(row("sym", cname, "class", 1, pos(n, 1))),
        F.transform("bases", lambda b, i: row("sym", cname, "class", none_i, pos(_MAXINT, 1, n, i * 2))),
        F.transform("bases", lambda b, i: row("sym", b, "class", none_i, pos(_MAXINT, 1, n, i * 2 + 1))),
        F.transform("bases", lambda b, i: row("edge", none_s, none_s, none_i, pos(n, 1, 0, i),
                                               F.concat_ws(":", path, cname), F.concat_ws(":", path, b),
                                               F.lit("inherits")))))
    imp = (k == "from") | ((k == "import") & (F.col("module") != ""))
    mod = F.when(imp, F.array(
        row("sym", F.split_part(F.col("module"), F.lit("."), F.lit(1)), "module", 1, pos(n, 1)),
        row("edge", none_s, none_s, none_i, pos(n, 1), path, F.col("module"), F.lit("imports"))))
    arr = F.concat(F.coalesce(func, empty), F.coalesce(cls, empty), F.coalesce(mod, empty))
    return d.select("repo_id", "path", F.explode(arr).alias("r")).select("repo_id", "path", "r.*")
