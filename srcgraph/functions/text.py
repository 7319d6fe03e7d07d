"""Column -> Column text helpers (all JVM-side built-ins, no UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import RX_EOL, SUMMARY_EMPTY, SUMMARY_MAX_LEN

# Unicode whitespace at either end; \x1c-\x1f count as space for Python's str.strip.
_RX_STRIP = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
_RX_SPACE_RUN = "(?U)[\\s\\x1c-\\x1f]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character Python's str.isspace() accepts (derived from the interpreter's own table).
# Space and tab come first: a trim stops scanning the set at the first match.
WHITESPACE = " \t" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \t")
# Line breaks other than "\n" (rare in source files): they select the slower regex split.
_RX_RARE_EOL = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def py_strip(c) -> Column:
    """Strip whitespace at both ends the way ``str.strip()`` does (``trim`` drops spaces only).

    A character-set trim (``btrim``), no regular expression.
    """
    return F.btrim(col_(c), F.lit(WHITESPACE))


def is_plain(c) -> Column:
    """Whether a text holds printable ASCII and ``\n`` only."""
    return col_(c).rlike("\\A[\\n -~]*+\\z")


def has_rare_break(c) -> Column:
    """Whether a text holds a line break other than ``\n``; most texts are plain, which is found out faster."""
    return ~is_plain(c) & col_(c).rlike(_RX_RARE_EOL)


def line_pieces(c) -> Column:
    """Lines of a non-empty text like ``str.splitlines()``: one trailing break is removed
    first, then the text is split (``\n`` only: single-character split; other break
    characters present: the full break pattern). An empty text must be filtered out by the
    caller (it has no lines)."""
    c = col_(c)
    rare = F.split(F.regexp_replace(c, "(?:" + RX_EOL + ")\\z", ""), RX_EOL, -1)
    return F.when(has_rare_break(c), rare).otherwise(_cut(c))


def _cut(c) -> Column:
    """The lines of a text whose only breaks are ``\n``."""
    return F.split(F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c), "\n", -1)


def stripped_pieces(c) -> Column:
    """``line_pieces`` with each line stripped (``py_strip``). Where only printable ASCII stands, a trim of blanks does it."""
    c = col_(c)
    exact = lambda l: F.when(is_plain(l), F.trim(l)).otherwise(py_strip(l))
    return F.when(is_plain(c), F.transform(_cut(c), lambda l: F.trim(l))).otherwise(F.transform(line_pieces(c), exact))


def decode_tolerant(c) -> Column:
    """Binary -> string as UTF-8 with invalid bytes dropped; a U+FFFD that stands in the bytes (EF BF BD) stays.

    Replaced bytes come out as U+FFFD too, so where one is found the bytes are read a second time, as single-byte
    characters: genuine ones become an escape (``\\x1a1``, and ``\\x1a`` itself ``\\x1a0``) that decoding leaves alone.
    """
    valid = lambda x: F.make_valid_utf8(x.cast("string"))
    text = valid(col_(c))
    raw = F.replace(F.decode(col_(c), "ISO-8859-1"), F.lit("\x1a"), F.lit("\x1a0"))
    raw = F.replace(raw, F.lit("\xef\xbf\xbd"), F.lit("\x1a1"))
    kept = F.replace(valid(F.encode(raw, "ISO-8859-1")), F.lit("\ufffd"), F.lit(""))
    kept = F.replace(F.replace(kept, F.lit("\x1a1"), F.lit("\ufffd")), F.lit("\x1a0"), F.lit("\x1a"))
    return F.when(text.contains("\ufffd"), kept).otherwise(text)


def collapse_whitespace(c) -> Column:
    """``" ".join(text.split())``: runs of whitespace become one space, ends trimmed."""
    return F.regexp_replace(py_strip(c), _RX_SPACE_RUN, " ")


def summarize_text(c, max_len: int = SUMMARY_MAX_LEN) -> Column:
    """STR1: collapse whitespace, keep ``max_len`` characters, append ``...`` when cut.

    A null or empty text gives the fixed sentence. (The model-written summary is not built.)
    """
    cleaned = collapse_whitespace(c)
    cut = F.concat(F.substring(cleaned, 1, max_len),
                   F.when(F.length(cleaned) > max_len, F.lit("...")).otherwise(F.lit("")))
    return F.when(col_(c).isNull() | (col_(c) == ""), F.lit(SUMMARY_EMPTY)).otherwise(cut)


def escape_key(c) -> Column:
    """STR3: ``:`` -> ``_COLON_`` (diagram node ids)."""
    return F.replace(col_(c), F.lit(":"), F.lit("_COLON_"))


def display_name(c) -> Column:
    """COL14: text after the last ``:`` of a node key (the key itself when it has none)."""
    return F.substring_index(col_(c), ":", -1)


def file_label(c) -> Column:
    """COL15: base name of a path."""
    return F.substring_index(col_(c), "/", -1)
