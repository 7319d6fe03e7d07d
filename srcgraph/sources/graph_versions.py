"""GRF9, AGG1, AGG3: a stored graph in hash buckets, whose merges read and write what their batch touches.

Under a root folder every version ``v`` adds ``segments/v/<table>/bucket=<b>`` (Parquet) and a manifest
``manifests/v``: the segments that make up each bucket of each table. Four tables:

* ``nodes``, bucketed by ``(repo_id, file)``: a merge joins and rewrites the buckets of the batch's files only;
* ``edges``, bucketed alike: a merge appends a segment, or rewrites the touched buckets where it replaces files;
* ``stats`` ``(repo_id, entity, label, n)`` and ``calls`` ``(repo_id, target, n)``: signed counts. A merge appends
  what it added less what it took away; the sum over a key's rows is its count, so AGG1 and AGG3 never recount.

A bucket of an appended table that has ``max_segments`` segments is written as one by the next merge. The driver
holds bucket and segment numbers only (tables x ``buckets`` x ``max_segments`` at most). A version exists from the
moment its marker is written, last; the marker names the batch, so a retried batch finds its own or writes the same
version again. One writer per graph; any number of readers. No key is hotter than one source file or one counted
key, and counts are aggregated before they are shuffled.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import TOP_K
from ..functions.text import display_name
from ..operators import graph as G
from ..session import write_by

SCHEMAS = {
    "nodes": "repo_id string, file string, name string, kind string, complexity int, gen int, pos bigint",
    "edges": "repo_id string, file string, source string, target string, type string",
    "stats": "repo_id string, entity string, label string, n bigint",
    "calls": "repo_id string, target string, n bigint",
}
KEYS = {"nodes": ["repo_id", "file"], "edges": ["repo_id", "file"], "stats": ["repo_id"], "calls": ["repo_id", "target"]}
BUCKETS = 64
MAX_SEGMENTS = 8


@dataclass
class Version:
    number: int
    made_by: str
    gen: int            # highest generation of a node
    buckets: int
    segments: dict[str, dict[int, list[int]]] = field(default_factory=lambda: {t: {} for t in SCHEMAS})


def _name(v: int) -> str:
    return f"v{v:08d}"


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _marker(root: str, v: int) -> str:
    return f"{root}/manifests/{_name(v)}/_COMPLETE"


def complete_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions under ``root``, ascending."""
    found = [int(n[1:]) for n in _listed(spark, f"{root}/manifests") if n[1:].isdigit()]
    return sorted(v for v in found if (lambda fs, p: fs.exists(p))(*_path(spark, _marker(root, v))))


def latest_version(spark: SparkSession, root: str) -> int:
    """Highest complete version under ``root`` (-1 when none)."""
    return max(complete_versions(spark, root), default=-1)


def version(spark: SparkSession, root: str, v: int | None = None) -> Version:
    """Version ``v`` (the latest by default) by its marker and manifest."""
    v = latest_version(spark, root) if v is None else v
    if v < 0:
        raise ValueError(f"no graph under {root}")
    fs, p = _path(spark, _marker(root, v))
    f = fs.open(p)
    try:
        out = Version(number=v, **json.loads(f.readUTF()))
    finally:
        f.close()
    rows = spark.read.schema("name string, bucket int, segment int").parquet(f"{root}/manifests/{_name(v)}")
    for r in sorted(rows.collect()):  # at most tables x buckets x max_segments rows
        out.segments[r.name].setdefault(r.bucket, []).append(r.segment)
    return out


def read_table(spark: SparkSession, root: str, ver: Version, table: str, only: set[int] | None = None) -> DataFrame:
    """A table of a version, or of its buckets ``only``."""
    paths = [f"{root}/segments/{_name(s)}/{table}/bucket={b}" for b, segs in sorted(ver.segments[table].items())
             if only is None or b in only for s in segs]
    return spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])


def read_version(spark: SparkSession, root: str, v: int | None = None) -> G.Graph:
    ver = version(spark, root, v)
    return G.Graph(read_table(spark, root, ver, "nodes"), read_table(spark, root, ver, "edges"))


def _bucket(table: str, buckets: int):
    return F.pmod(F.xxhash64(*KEYS[table]), F.lit(buckets)).cast("int")


def _write_segment(df: DataFrame, root: str, v: int, table: str, buckets: int) -> list[int]:
    """Write the rows as segment ``v`` of their buckets; the buckets that got any. Small buckets share a task, and a
    bucket above AQE's partition size is dealt over several, each with a file of its own."""
    path = f"{root}/segments/{_name(v)}/{table}"
    write_by(df.select(*_columns(table), _bucket(table, buckets).alias("bucket")).hint("rebalance", "bucket"), "bucket", path)
    return sorted(int(n.split("=")[1]) for n in _listed(df.sparkSession, path) if n.startswith("bucket="))


def _commit(spark: SparkSession, root: str, ver: Version) -> None:
    rows = [(t, b, s) for t, by in ver.segments.items() for b, segs in by.items() for s in segs]
    path = f"{root}/manifests/{_name(ver.number)}"
    spark.createDataFrame(rows, "name string, bucket int, segment int").coalesce(1).write.mode("overwrite").parquet(path)
    fs, p = _path(spark, _marker(root, ver.number))
    f = fs.create(p, True)
    f.writeUTF(json.dumps({"made_by": ver.made_by, "gen": ver.gen, "buckets": ver.buckets}))
    f.close()


def _sums(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n")).where(F.col("n") != 0)


def _stat_rows(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """A row of weight ``n`` per node and edge, to be summed."""
    return (nodes.select("repo_id", F.lit("node").alias("entity"), F.col("kind").alias("label"), F.lit(n).cast("bigint").alias("n"))
            .unionByName(edges.select("repo_id", F.lit("edge").alias("entity"), F.col("type").alias("label"),
                                      F.lit(n).cast("bigint").alias("n"))))


def _call_rows(edges: DataFrame, n: int) -> DataFrame:
    return edges.where(F.col("type") == "calls").select("repo_id", "target", F.lit(n).cast("bigint").alias("n"))


def _append(spark: SparkSession, root: str, ver: Version, table: str, rows: DataFrame, max_segments: int) -> None:
    """Add a segment to a table of ``ver``; buckets that are full are written whole with it."""
    have = ver.segments[table]
    full = {b for b, segs in have.items() if len(segs) >= max_segments}
    if full:
        rows = rows.unionByName(read_table(spark, root, ver, table, full))
    if table in ("stats", "calls"):
        rows = _sums(rows, [c for c in _columns(table) if c != "n"])
    written = _write_segment(rows, root, ver.number, table, ver.buckets)
    for b in full:
        del have[b]
    for b in written:
        have[b] = [*have.get(b, []), ver.number]


def _replace(spark: SparkSession, root: str, ver: Version, table: str, rows: DataFrame, touched: set[int]) -> DataFrame:
    """Put ``rows`` in the place of the touched buckets; they are returned as written."""
    written = _write_segment(rows, root, ver.number, table, ver.buckets)
    for b in touched:
        ver.segments[table].pop(b, None)
    for b in written:
        ver.segments[table][b] = [ver.number]
    return read_table(spark, root, ver, table, set(written))


def seed_graph(g: G.Graph, root: str, buckets: int = BUCKETS) -> None:
    """Store ``g`` as version 0 with its counts (the graph that merges start from)."""
    spark = g.nodes.sparkSession
    _path(spark, root)[0].delete(_path(spark, _marker(root, 0))[1], False)
    ver = Version(0, "seed", 0, buckets)
    nodes = _replace(spark, root, ver, "nodes", g.nodes, set())
    edges = _replace(spark, root, ver, "edges", g.edges, set())
    ver.gen = int(nodes.agg(F.max("gen")).first()[0] or 0)
    _append(spark, root, ver, "stats", _stat_rows(nodes, edges, 1), MAX_SEGMENTS)
    _append(spark, root, ver, "calls", _call_rows(edges, 1), MAX_SEGMENTS)
    _commit(spark, root, ver)


def _without(stored: DataFrame, replaced: DataFrame) -> DataFrame:
    """Stored rows of files other than the ``replaced`` ones. Where the rows are far more, only the file names are hashed
    (a task's names are then a small part of its input); else both are sorted, which can spill."""
    names = replaced.hint("shuffle_hash") if 4 * replaced.count() <= stored.count() else replaced.hint("merge")
    return stored.join(names, ["repo_id", "file"], "left_anti")


def merge_version(new: G.Graph, root: str, made_by: str, replaced: DataFrame | None = None,
                  max_segments: int = MAX_SEGMENTS, all_replaced: bool = False) -> int:
    """GRF9: merge ``new`` (stored, as it is read several times; complexity null where only an edge names a node)
    into the latest version; the number of the version that holds it.

    Node and edge rules are those of ``graph.merge_graph``. With ``replaced(repo_id, file)`` the stored nodes and
    edges of these files go first, also of files that have no symbol any more; where they are all files of ``new``
    (``all_replaced``) no stored node meets a new one. A batch that is the latest version already (``made_by``) does nothing.
    """
    spark = new.nodes.sparkSession
    old = version(spark, root)
    if old.made_by == made_by:
        return old.number
    ver = Version(old.number + 1, made_by, old.gen + 1, old.buckets,
                  {t: {b: list(s) for b, s in by.items()} for t, by in old.segments.items()})
    _path(spark, root)[0].delete(_path(spark, _marker(root, ver.number))[1], False)
    files = new.nodes.select("repo_id", "file").unionByName(new.edges.select("repo_id", "file"))
    if replaced is not None:
        replaced = replaced.select("repo_id", "file").distinct()
        files = files.unionByName(replaced)
    touched = {r[0] for r in files.select(_bucket("nodes", ver.buckets)).distinct().collect()}  # at most ``buckets``
    was_nodes, was_edges = read_table(spark, root, old, "nodes", touched), read_table(spark, root, old, "edges", touched)
    stay = (lambda d: d) if replaced is None else (lambda d: _without(d, replaced))
    put = G.add_nodes if all_replaced else G.join_nodes
    nodes = _replace(spark, root, ver, "nodes", put(stay(was_nodes), new.nodes, True, ver.gen), touched)
    if replaced is None:
        edges, gone = new.edges, spark.createDataFrame([], SCHEMAS["edges"])
        _append(spark, root, ver, "edges", edges.select(*G.EDGE_COLS), max_segments)
    else:
        edges, gone = _replace(spark, root, ver, "edges", G.append_edges(stay(was_edges), new.edges), touched), was_edges
    _append(spark, root, ver, "stats", _stat_rows(nodes, edges, 1).unionByName(_stat_rows(was_nodes, gone, -1)), max_segments)
    _append(spark, root, ver, "calls", _call_rows(edges, 1).unionByName(_call_rows(gone, -1)), max_segments)
    _commit(spark, root, ver)
    return ver.number


def stored_stats(spark: SparkSession, root: str, v: int | None = None) -> DataFrame:
    """AGG1 of a version from its counts; equal to ``stats.graph_stats`` of its graph."""
    s = _sums(read_table(spark, root, version(spark, root, v), "stats"), ["repo_id", "entity", "label"])
    node, edge, lab = F.col("entity") == "node", F.col("entity") == "edge", F.col("label")
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
    return s.groupBy("repo_id").agg(
        total(node, "total_symbols"), total(node & (lab == "class"), "classes"), total(node & (lab == "function"), "functions"),
        total(node & (lab == "module"), "modules"), total(edge, "total_edges"), total(edge & (lab == "inherits"), "inheritance_edges"),
        total(edge & (lab == "calls"), "call_edges"), total(edge & (lab == "imports"), "import_edges"))


def stored_hotspots(spark: SparkSession, root: str, k: int = TOP_K, v: int | None = None) -> DataFrame:
    """AGG3 of a version from its counts; equal to ``stats.call_hotspots`` of its edges."""
    c = _sums(read_table(spark, root, version(spark, root, v), "calls"), ["repo_id", "target"])
    w = Window.partitionBy("repo_id").orderBy(F.col("n").desc(), F.col("target"))
    return (c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("repo_id", "rank", "target", display_name("target").alias("func_name"), F.col("n").alias("calls")))


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Keep the newest ``keep`` versions and delete every bucket segment that none of them names; segments deleted.
    Segments of a version that is still being written (newer than the latest) stay."""
    if keep < 1:
        raise ValueError("keep at least one version")
    done = complete_versions(spark, root)
    live = {(t, b, s) for v in done[-keep:] for t, by in version(spark, root, v).segments.items() for b, segs in by.items() for s in segs}
    for v in done[:-keep]:
        # the marker goes first: a version whose files are being deleted is not complete
        for what in (_marker(root, v), f"{root}/manifests/{_name(v)}"):
            fs, p = _path(spark, what)
            fs.delete(p, True)
    deleted = 0
    for s in (int(n[1:]) for n in _listed(spark, f"{root}/segments") if n[1:].isdigit()):
        if s > max(done, default=-1):
            continue
        for t in SCHEMAS:
            for n in _listed(spark, f"{root}/segments/{_name(s)}/{t}"):
                if n.startswith("bucket=") and (t, int(n.split("=")[1]), s) not in live:
                    fs, p = _path(spark, f"{root}/segments/{_name(s)}/{t}/{n}")
                    fs.delete(p, True)
                    deleted += 1
    return deleted
