"""COL1-COL4: repository URL checks as one struct column.

The URL is split with one regular expression into scheme, authority and path (the
generic ``scheme://authority/path?query#fragment`` layout), so a URL with spaces or other
unusual characters is still taken apart instead of becoming null as with ``parse_url``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import MSG_EMPTY_URL, MSG_GITHUB_FORM, SUPPORTED_HOSTS
from .text import col_, py_strip

_RX_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
_RX_NAME = "(?U)^[\\w.-]+$"


def validate_repo_url(c) -> Column:
    """COL1: ``struct(valid boolean, error string, normalized_url string)``.

    Rules, in order: null/empty -> error; trim, strip trailing ``/``; an authority with one
    unbalanced bracket is a format error; the host must be one of the supported hosts exactly;
    for GitHub the path needs two non-empty pieces whose names match ``^[\\w.-]+$`` (after ``.git``
    is removed from the repository piece) and the result is ``https://github.com/owner/repo``
    with every ``.git`` removed (COL2); other hosts keep the trimmed URL.
    """
    raw = col_(c)
    url = F.regexp_replace(py_strip(raw), "/+$", "")
    clean = F.regexp_replace(url, "[\\t\\r\\n]", "")
    rest = F.regexp_replace(clean, _RX_SCHEME, "")
    authority = F.regexp_extract(rest, "^//([^/?#]*)", 1)
    after = F.when(rest.startswith("//"), F.substring(rest, F.length(authority) + 3, F.lit(1 << 30))).otherwise(rest)
    path = F.regexp_extract(after, "^([^?#]*)", 1)
    pieces = F.filter(F.split(path, "/"), lambda x: x != "")
    owner = F.try_element_at(pieces, F.lit(1))
    repo = F.try_element_at(pieces, F.lit(2))
    repo_clean = F.replace(repo, F.lit(".git"), F.lit(""))
    unbalanced = authority.contains("[") != authority.contains("]")
    hosts = ", ".join(SUPPORTED_HOSTS)

    def rec(valid, error, norm):
        return F.struct(F.lit(valid).alias("valid"), error.cast("string").alias("error"),
                        norm.cast("string").alias("normalized_url"))

    none = F.lit(None).cast("string")
    return (
        F.when(raw.isNull() | (raw == ""), rec(False, F.lit(MSG_EMPTY_URL), none))
        .when(unbalanced, rec(False, F.lit("Invalid URL format: Invalid IPv6 URL"), none))
        .when(~authority.isin(*SUPPORTED_HOSTS),
              rec(False, F.concat(F.lit("Unsupported host: "), authority, F.lit(". Supported: " + hosts)), none))
        .when(authority != "github.com", rec(True, none, url))
        .when(F.size(pieces) < 2, rec(False, F.lit(MSG_GITHUB_FORM), none))
        .when(~owner.rlike(_RX_NAME) | ~repo_clean.rlike(_RX_NAME),
              rec(False, F.concat(F.lit("Invalid owner/repo name: "), owner, F.lit("/"), repo), none))
        .otherwise(rec(True, none, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo_clean)))
    )


def url_checks(urls, url_col: str = "repo_url", id_col: str = "req_id"):
    """COL1-COL3 over a table of URLs: ``(req_id, valid, error, normalized_url)``."""
    return urls.select(F.col(id_col), validate_repo_url(url_col).alias("v")).select(id_col, "v.*")
