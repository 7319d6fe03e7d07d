"""SRC1 (raw form): a Python data source reading checkout folders ``<root>/<repo_id>/...``.

``spark.read.format("srcdir").option("path", root).load()`` gives ``(repo_id, path, content)``.
Unlike the ``text``/``binaryFile`` readers it keeps files whose names start with ``_`` or
``.`` (``__init__.py``, ``__main__.py``). The driver lists the repository folders and their
top-level directories only; each top-level directory is walked and read once, on an executor, and so
are the files beside them. They are dealt over at most ``max_parts`` (1,024) input partitions, so a
checkout of very many small directories does not cost a task for each. Options: ``prune`` (skip ignored
directories, default true), ``suffixes`` (comma list, default ``.py``; empty = every file).
Unreadable files are skipped; text is decoded as UTF-8 with invalid bytes dropped. The root must
be on storage that every executor sees.
"""
from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.constants import IGNORE_DIRS, SUPPORTED_EXT


def local_path(p: str) -> str:
    """``file:`` URIs as plain paths for Python's ``os`` functions (other schemes unchanged)."""
    if p.startswith("file://"):
        return p[len("file://"):]
    if p.startswith("file:"):
        return p[len("file:"):]
    return p


class _Part(InputPartition):
    """Directories ``(repo, top)`` at the top of repositories with all below them, or (``top`` None) the files at the top."""

    def __init__(self, tops: list[tuple[str, str | None]]):
        super().__init__(tuple(tops))
        self.tops = tops


class SourceDirReader(DataSourceReader):
    def __init__(self, options):
        self.root = local_path(options["path"])
        self.prune = options.get("prune", "true").lower() == "true"
        sx = options.get("suffixes", ",".join(SUPPORTED_EXT))
        self.suffixes = tuple(x for x in sx.split(",") if x)
        self.max_parts = int(options.get("max_parts", "1024"))

    def partitions(self):
        out = []
        for repo in sorted(e.name for e in os.scandir(self.root) if e.is_dir()):
            tops = sorted(e.name for e in os.scandir(os.path.join(self.root, repo)) if e.is_dir())
            out += [(repo, None), *[(repo, t) for t in tops if not (self.prune and t in IGNORE_DIRS)]]
        return [_Part(out[i::self.max_parts]) for i in range(min(self.max_parts, len(out)))]

    def read(self, partition):
        for repo, top in partition.tops:
            yield from self._read_top(repo, top)

    def _read_top(self, repo: str, top: str | None):
        base = os.path.join(self.root, repo)
        for dirpath, dirnames, filenames in os.walk(os.path.join(base, top or "")):
            if top is None:
                dirnames.clear()
            elif self.prune:
                dirnames[:] = [d for d in dirnames if d not in IGNORE_DIRS]
            for fname in filenames:
                stem, ext = os.path.splitext(fname)
                if self.suffixes and (ext not in self.suffixes or not stem):
                    continue
                rel = os.path.relpath(os.path.join(dirpath, fname), base).replace(os.sep, "/")
                try:
                    with open(os.path.join(dirpath, fname), "rb") as fh:
                        text = fh.read().decode("utf-8", errors="ignore")
                except OSError:
                    continue
                yield (repo, rel, text)


class SourceDirDataSource(DataSource):
    @classmethod
    def name(cls):
        return "srcdir"

    def schema(self):
        return "repo_id string, path string, content string"

    def reader(self, schema):
        return SourceDirReader(self.options)


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Send this package to the Python workers (``addPyFile`` of a zip written into the
    shared checkpoint folder), once per application. Skip it where the package is installed
    on the executors already."""
    import uuid
    import zipfile

    from ..session import scratch_path
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = scratch_path(spark, f"pyfiles/srcgraph-{uuid.uuid4().hex}.zip")
    if "://" in target and not target.startswith("file:"):
        # shared storage that Python cannot write directly: the package must be installed
        # on the executors (or passed with --py-files)
        _SHIPPED.add(app)
        return
    zpath = local_path(target)
    os.makedirs(os.path.dirname(zpath), exist_ok=True)
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(dirpath, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(app)


def register(spark, ship: bool = True) -> None:
    if ship:
        ship_package(spark)
    spark.dataSource.register(SourceDirDataSource)


def write_checkout(files, root: str) -> None:
    """Write ``files(repo_id, path, content)`` as a checkout folder tree under ``root``
    (executors write their own rows; used to build test folders from tables). ``root`` must
    be a local or mounted shared folder."""
    root = local_path(root)

    def write_part(rows):
        for r in rows:
            full = os.path.join(root, r.repo_id, *r.path.split("/"))
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as fh:
                fh.write(r.content or "")
    files.foreachPartition(write_part)
