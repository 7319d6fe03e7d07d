"""LIN4/LIN5/WIN5 for files too long for one task: the line parser over chunks of lines.

Inside a file the parser is in one of four states: before any ``def``, or in a function that has no body line yet, has
one, or was closed by a class line. What a chunk of lines does to that state follows from the chunk alone:

* with a ``def`` line it ends in the state its last function is in, whatever came before;
* without one it gives an open function a body line if it has a candidate line, and closes it if a class line follows
  a candidate of its own, or if it has a class line and the function had a body line when the chunk began.

So each chunk is read once, by itself (running windows keyed by file *and* chunk), and summed up in one short row. A
scan over the summaries of a file, in chunk order, gives every chunk the state, line number and function number it
begins with; a join hands them to the chunk's lines. ``chunk_windows`` gives the rows of ``lines.line_windows``.

What is shuffled: the text, once, a row per line, since a single row has to be spread before it is analysed (text
between two ``\n`` is one row, whatever other breaks it holds); the totals of functions are hash
aggregates with a map-side step, so a function as long as its file is no single window group either. The summaries of
one file are one group: one row per ``chunk_lines`` lines.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_pieces, py_strip
from ..session import materialize
from .lines import FILE_KEYS, emitted_rows, line_features

KEYS = [*FILE_KEYS, "chunk"]


def text_pieces(files: DataFrame, chunk_lines: int) -> DataFrame:
    """``(repo_id, path, chunk, i, text)``: every file cut after each ``\n``, which always ends a line (a ``\r\n`` stays
    whole); ``i`` counts the pieces and ``chunk_lines`` of them are a chunk. The texts joined are the file; null and empty
    files have none. One pass over the text: nothing is sliced out of an array as long as the file."""
    breaks = F.octet_length("content") - F.octet_length(F.replace("content", F.lit("\n"), F.lit("")))
    # counted below the generator: beside it, the count would be made again for every line
    d = files.where(F.col("content") != "").select(*FILE_KEYS, "content", breaks.alias("breaks"))
    d = d.select(*FILE_KEYS, "breaks", F.posexplode(F.split("content", "\n", -1)).alias("i", "piece"))
    text = F.when(F.col("i") < F.col("breaks"), F.concat("piece", F.lit("\n"))).otherwise(F.col("piece"))
    d = d.select(*FILE_KEYS, F.floor(F.col("i") / chunk_lines).cast("int").alias("chunk"), "i", text.alias("text"))
    return d.where(F.col("text") != "")


def _local(files: DataFrame, chunk_lines: int) -> DataFrame:
    """Per line what its chunk alone tells: ``n``, ``seg`` and ``cum`` count from the start of the chunk."""
    # a fixed number of partitions: sized by bytes, chunks of text that compresses well would share a few tasks
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_pieces(files, chunk_lines).repartition(parts, *KEYS)
    lines = text.select(*KEYS, F.col("i").alias("n"), F.posexplode(line_pieces("text")).alias("j", "raw"))
    feats = line_features(lines.withColumn("line", py_strip("raw")), [*KEYS, "j"])
    w = Window.partitionBy(*KEYS).orderBy("n", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_def, is_class = F.col("kind") == "def", F.col("kind") == "class"
    d = feats.select("*", F.count(F.lit(1)).over(w).alias("at"), F.count_if(is_def).over(w).alias("seg"),
                     F.count_if(F.col("cand")).over(w).alias("cum"), F.count_if(is_class).over(w).alias("classes"))
    d = d.select("*", F.max(F.when(is_def, F.col("cum") - F.col("cand").cast("int"))).over(w).alias("base"),
                 F.coalesce(F.max(is_class & (F.col("cum") > 0)).over(w), F.lit(False)).alias("after"))
    d = d.withColumn("closer", is_class & (F.col("seg") > 0) & (F.col("cum") > F.col("base")))
    d = d.withColumn("closed_seg", F.max(F.when(F.col("closer"), F.col("seg"))).over(w))
    return d.drop("n", "j").withColumnRenamed("at", "n")


def chunk_states(local: DataFrame) -> DataFrame:
    """Per chunk the state it begins with: ``n0`` lines and ``seg0`` functions before it; whether the open function
    already ``had`` a body line and whether it is ``shut`` (both without meaning where ``seg0`` = 0)."""
    ends = local.groupBy(*KEYS).agg(
        F.max("n").alias("n"), F.max("seg").alias("seg"), F.max("cum").alias("cum"), F.max("classes").alias("classes"),
        F.max("base").alias("base"), F.max("closed_seg").alias("closed_seg"), F.max("after").alias("after"))
    fixed = F.col("seg") > 0  # the state at the end does not depend on the one at the start
    none = F.lit(False)
    w = Window.partitionBy(*FILE_KEYS).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    s = ends.select(
        *KEYS, "after", (F.col("cum") > 0).alias("any"), (F.col("classes") > 0).alias("class"),
        F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("seg").over(w), F.lit(0)).alias("seg0"),
        F.coalesce(F.count_if(fixed).over(w), F.lit(0)).alias("run"),
        F.last(F.when(fixed, F.col("cum") > F.col("base")), True).over(w).alias("had0"),
        F.last(F.when(fixed, F.coalesce(F.col("closed_seg") == F.col("seg"), none)), True).over(w).alias("shut0"))
    # a run: the chunks after one with a def line, up to the next such one; all but its last leave the function open
    r = Window.partitionBy(*FILE_KEYS, "run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("had", F.coalesce("had0", none) | F.coalesce(F.max("any").over(r), none))
    s = s.withColumn("shuts", (F.col("had") & F.col("class")) | F.col("after"))
    s = s.withColumn("shut", F.coalesce("shut0", none) | F.coalesce(F.max("shuts").over(r), none))
    return s.select(*KEYS, "n0", "seg0", "had", "shut")


def chunk_windows(files: DataFrame, chunk_lines: int = 1 << 14) -> DataFrame:
    """The rows of ``lines.line_windows(line_features(source_lines(files)))``, with no group longer than a chunk."""
    if chunk_lines < 1:
        raise ValueError("chunk_lines must be at least 1")
    local = materialize(_local(files, chunk_lines), "line-chunks")
    d = local.join(chunk_states(local), KEYS)
    head = F.col("seg") == 0  # lines before the chunk's first def belong to the function that was open
    seg = F.col("seg0") + F.col("seg")
    ends_it = (F.col("kind") == "class") & (F.col("seg0") > 0) & (F.col("had") | (F.col("cum") > 0))
    shut = F.when(head, F.col("shut") | (F.col("had") & (F.col("classes") > 0)) | F.col("after")) \
        .otherwise(F.coalesce(F.col("closed_seg") == F.col("seg"), F.lit(False)))
    return d.select(*FILE_KEYS, (F.col("n0") + F.col("n")).cast("int").alias("n"), "kind", "class_name", "bases", "def_name",
                    "module", "branch", seg.alias("seg"), F.when(head, ends_it).otherwise(F.col("closer")).alias("closer"),
                    (F.col("cand") & (seg > 0) & ~shut).alias("body"))


def chunk_graph_rows(win: DataFrame) -> DataFrame:
    """The rows of ``lines.line_graph_rows``: a function's totals come from a hash aggregate and are joined to its one
    def line, so neither a long function nor a long run of class or import lines meets in one task."""
    keys = [*FILE_KEYS, "seg"]
    body = F.col("body")
    totals = win.where("seg > 0").groupBy(*keys).agg(
        F.count_if(body).alias("seg_body"), F.count_if(body & F.col("branch")).alias("seg_branch"),
        F.min(F.when(F.col("closer"), F.col("n"))).alias("close_n"), F.max("n").alias("last_n"))
    defs = win.where(F.col("kind") == "def").join(totals, keys)
    rest = win.where(F.col("kind").isin("class", "import", "from"))
    return emitted_rows(defs.unionByName(rest, allowMissingColumns=True))
