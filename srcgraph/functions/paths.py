"""Column -> Column helpers on paths, module names and URLs of repositories."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ENTRY_POINT_NAMES, IGNORE_DIRS, SUPPORTED_EXT
from .text import col_


def basename(c) -> Column:
    return F.substring_index(col_(c), "/", -1)


def suffix(c) -> Column:
    """``Path(p).suffix``: last ``.xyz`` of the base name; a name that is only ``.py`` has none."""
    return F.regexp_extract(basename(c), "^.+(\\.[^.]*)$", 1)


def has_supported_ext(c) -> Column:
    """SRC5: suffix in the supported set (case-sensitive)."""
    return suffix(c).isin(*SUPPORTED_EXT)


def in_ignored_dir(c) -> Column:
    """SRC2: some directory segment (not the file name) is an ignored directory name."""
    segs = F.split(col_(c), "/")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in IGNORE_DIRS]))


def is_entry_point_name(c) -> Column:
    """COL5: base name is one of the entry-point file names."""
    return basename(c).isin(*ENTRY_POINT_NAMES)


def module_name_of_file(c) -> Column:
    """COL7: repository-relative path, ``.py`` cut, ``/`` -> ``.`` (``pkg/__init__.py`` -> ``pkg.__init__``)."""
    return F.replace(F.regexp_replace(col_(c), "\\.py$", ""), F.lit("/"), F.lit("."))


def folded_module_name(c) -> Column:
    """COL7 with packages folded: ``pkg/__init__.py`` -> ``pkg`` (the root's ``__init__.py`` -> ``''``)."""
    return F.regexp_replace(module_name_of_file(c), "(^|\\.)__init__$", "")


def import_level(module) -> Column:
    """Number of leading dots."""
    return F.char_length(col_(module)) - F.char_length(relative_import_base(module))


def absolute_module(module, path) -> Column:
    """COL9 against the importing file's package: one dot is its folder, every further dot one folder up.
    ``''`` is the repository root itself; null where the dots lead above it. Without dots the module as it is."""
    level, base = import_level(module), relative_import_base(module)
    segs = F.split(col_(path), "/")
    depth = F.size(segs) - level  # folders left of the path after level - 1 steps up
    parts = F.concat(F.slice(segs, F.lit(1), F.greatest(depth, F.lit(0))),
                     F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>")))
    return F.when(level == 0, col_(module)).when(depth >= 0, F.array_join(parts, "."))


def import_target_module(c) -> Column:
    """COL8: part of an import target before the first ``:``."""
    return F.split_part(col_(c), F.lit(":"), F.lit(1))


def relative_import_base(c) -> Column:
    """COL9: module text without its leading dots."""
    return F.regexp_replace(col_(c), "^\\.+", "")


def candidate_py(base) -> Column:
    """COL10: ``a.b`` -> ``a/b.py`` (relative to the repository root)."""
    return F.concat(F.replace(col_(base), F.lit("."), F.lit("/")), F.lit(".py"))


def candidate_init(base) -> Column:
    """COL10: ``a.b`` -> ``a/b/__init__.py``."""
    return F.concat(F.replace(col_(base), F.lit("."), F.lit("/")), F.lit("/__init__.py"))


def repo_name_from_url(c) -> Column:
    """COL4: last path piece of a URL, every ``.git`` removed."""
    return F.replace(F.substring_index(F.regexp_replace(col_(c), "/+$", ""), "/", -1), F.lit(".git"), F.lit(""))
