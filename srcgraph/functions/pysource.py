"""Python source text -> logical lines and names, as columns over one file row.

Everything happens inside the row: no window, no exchange, no UDF. Patterns use lazy or possessive
character classes only (never a repeated group), so long strings cannot exhaust the regex stack.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import RX_EOL
from .text import has_rare_break

JOIN = "\x01"     # a line break that does not end a logical line
MARK = "\x02"     # between a logical line's number and its text
_BLOCK = 128
_EVEN = "(?<=(?<!\\\\)(?:\\\\\\\\){0,40})"   # an even run of backslashes (up to 80) stands before
_TOKEN = ("(?s)\"\"\".*?(?:" + _EVEN + "\"\"\"|\\z)|'''.*?(?:" + _EVEN + "'''|\\z)"
          "|\"[^\n]*?" + _EVEN + "\"|'[^\n]*?" + _EVEN + "'|[\"'][^\n]*+"
          "|#[^\n\x01]*+\x01?|[^\"'#]++")
_NAME = "[A-Za-z_][\\w.]*"


def masked(content: Column) -> Column:
    """The text with strings as ``""`` and without comments; breaks inside a string and behind a
    backslash become ``JOIN``. One left-to-right scan, so quotes in comments and comment signs in
    strings do not count."""
    c = F.when(has_rare_break(content), F.regexp_replace(content, RX_EOL, "\n")).otherwise(content)

    def one(t):
        breaks = F.length(t) - F.length(F.translate(t, "\n" + JOIN, ""))
        return (F.when(t.startswith("\"") | t.startswith("'"), F.concat(F.lit("\"\""), F.repeat(F.lit(JOIN), breaks)))
                .when(t.startswith("#"), F.when(t.endswith(JOIN), F.lit("\n")).otherwise(F.lit("")))
                .otherwise(t))

    plain = lambda c: ~(c.contains("\"") | c.contains("'") | c.contains("#"))
    return bind(F.replace(c, F.lit("\\\n"), F.lit(JOIN)), lambda c: F.when(plain(c), c).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), one), "")))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(xs: Column) -> Column:
    """The array cut into arrays of ``_BLOCK`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")),
                       lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))


def _running(xs: Column) -> Column:
    """Running sums *before* each element, in blocks: O(n * _BLOCK + (n / _BLOCK) ** 2) additions."""
    zero = F.lit(0)
    add = lambda a, b: a + b

    def flat(bs):
        sums = F.transform(bs, lambda b: F.aggregate(b, zero, add))
        return bind(sums, lambda s: F.flatten(F.transform(bs, lambda b, i: bind(
            F.aggregate(F.slice(s, F.lit(1), i), zero, add),
            lambda off: F.transform(b, lambda _, k: off + F.aggregate(F.slice(b, F.lit(1), k), zero, add))))))

    return bind(_blocks(xs), flat)


def logical_lines(content: Column) -> Column:
    """``array<struct<n:int,text:string>>``: number of the first physical line and the masked text.

    A physical line that begins inside a string, behind a backslash or inside brackets belongs to
    the logical line before it. A text none of whose lines leaves anything open is cut and numbered only.
    """
    def net(c):  # a text's brackets by line, less those that close beside their own opening
        b = F.regexp_replace(c, "[^()\\[\\]{}\n" + JOIN + "]++", "")
        for _ in range(4):
            b = F.regexp_replace(b, "[(\\[{][)\\]}]", "")
        return b

    def numbered(c):
        return F.transform(F.split(c, "\n", -1), lambda l, i: F.struct((i + 1).cast("int").alias("n"), l.alias("text")))

    def join(c, b):
        opens = lambda l: F.length(l) - F.length(F.translate(l, "([{", ""))
        closes = lambda l: F.length(l) - F.length(F.translate(l, ")]}", ""))
        broken = lambda t: F.split(F.replace(t, F.lit(JOIN), F.lit("\n" + JOIN)), "\n", -1)
        nets = F.transform(broken(b), lambda l: F.when(F.length(l) == 0, F.lit(0)).otherwise(opens(l) - closes(l)))
        depth = bind(nets, lambda d: F.when(F.exists(d, lambda x: x != 0), _running(d)).otherwise(d))
        parts = bind(depth, lambda d: F.transform(broken(c), lambda l, i: F.when(
            l.startswith(JOIN) | (F.get(d, i) > 0), F.concat(F.lit(JOIN), l)).otherwise(
                F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(MARK), l))))
        rows = bind(F.array_join(parts, ""), lambda t: F.split(
            F.when(t.startswith("\n"), F.substring(t, F.lit(2), F.length(t))).otherwise(t), "\n", -1))
        return F.transform(rows, lambda r: F.struct(
            F.substring_index(r, MARK, 1).cast("int").alias("n"),
            F.replace(F.substring(r, F.instr(r, MARK) + 1, F.length(r)), F.lit(JOIN), F.lit(" ")).alias("text")))

    return bind(masked(content), lambda c: bind(net(c), lambda b: F.when(
        b.rlike("[^\n]"), join(c, b)).otherwise(numbered(c))))


_RX_DEF = "^\\s*(?:async\\s+)?def\\s+([A-Za-z_]\\w*)"
def indent(line: Column) -> Column:
    """The number of blanks and tabs that ``line`` begins with."""
    rest = F.ltrim(line)
    return F.when(rest.startswith("\t"), F.length(F.regexp_extract(line, "^[ \\t]*+", 0))).otherwise(F.octet_length(line) - F.octet_length(rest))


_OPEN = "array<array<struct<indent:int,name:string>>>"


def scoped_lines(content: Column) -> Column:
    """``array<struct<n,indent,text,def_name,func>>``: the logical lines that are not blank, with the innermost function
    that is open at each (SCP2), null outside every function; ``def_name`` is empty where no ``def`` begins.

    One pass over the lines at which functions open or may close, with the open ones, innermost first: a line closes those
    indented as deep as itself or deeper, and a ``def`` opens its own. The lines behind it share its functions. The pass goes
    by blocks, so that no list grows by one element as long as the file is.
    """
    lines = F.transform(logical_lines(content), lambda l: F.struct(
        l["n"].alias("n"), indent(l["text"]).alias("indent"), l["text"].alias("text"),
        F.when(l["text"].contains("def"), F.regexp_extract(l["text"], _RX_DEF, 1)).otherwise("").alias("def_name")))
    lines = F.filter(lines, lambda l: l["indent"] < F.octet_length(l["text"]))
    is_def = lambda l: l["def_name"] != ""

    def turns(ls):  # places of the lines that do not just go on with what is open at the line before
        before = lambda i: F.get(ls, F.greatest(i - 1, F.lit(0)))
        at = F.transform(ls, lambda l, i: F.when((i == 0) | is_def(l) | (l["indent"] < before(i)["indent"])
                                                 | ((l["indent"] == before(i)["indent"]) & is_def(before(i))), i))
        return F.filter(at, lambda i: i.isNotNull())

    def opened(stack, l):
        kept = F.when(F.get(stack, F.lit(0))["indent"] >= l["indent"], F.filter(stack, lambda s: s["indent"] < l["indent"])).otherwise(stack)
        own = F.array(F.struct(l["indent"].alias("indent"), l["def_name"].alias("name")))
        return F.when(is_def(l), F.concat(own, kept)).otherwise(kept)

    def stacks(ls, ts):
        last = lambda acc: F.element_at(acc, -1)
        line = lambda acc, t: F.concat(acc, F.array(opened(last(acc), F.get(ls, t))))
        # a block begins with the last functions of the one before
        block = lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.array(last(last(acc))), line)))
        done = F.aggregate(_blocks(ts), F.array(F.array(F.array())).cast(f"array<{_OPEN}>"), block)
        return F.flatten(F.transform(F.slice(done, F.lit(2), F.size(done)), lambda x: F.slice(x, F.lit(2), F.size(x))))

    def rows(ls, ts, sts):
        upto = lambda k: F.coalesce(F.get(ts, k + 1), F.size(ls))
        part = lambda t, k: bind(F.get(F.get(sts, k), F.lit(0))["name"], lambda f: F.transform(
            F.slice(ls, t + 1, upto(k) - t), lambda l: _scoped(l, f)))
        return F.flatten(F.transform(ts, part))

    none = F.lit(None).cast("string")
    return bind(lines, lambda ls: F.when(F.exists(ls, is_def), bind(turns(ls), lambda ts: bind(
        stacks(ls, ts), lambda sts: rows(ls, ts, sts)))).otherwise(F.transform(ls, lambda l: _scoped(l, none))))


def _scoped(l: Column, func: Column) -> Column:
    return F.struct(*[l[c].alias(c) for c in ("n", "indent", "text", "def_name")], func.alias("func"))


_WHOLE_STRING = ("(?s)\\A(?:\"\"\"(?:.*" + _EVEN + ")?\"\"\"|\'\'\'(?:.*" + _EVEN + ")?\'\'\'"
                 "|\"(?!\"\")[^\n]*" + _EVEN + "\"|\'(?!\'\')[^\n]*" + _EVEN + "\')\\z")


def parses(content: Column) -> Column:
    """SCP7: whether a syntax tree can be made of the text, as far as tokens tell: every string is closed, every bracket is closed by its
    own kind, and no logical line stands deeper than the one before it unless that ends with a colon. A null or empty text parses."""
    c = F.when(has_rare_break(content), F.regexp_replace(content, RX_EOL, "\n")).otherwise(content)
    strings = F.filter(F.regexp_extract_all(F.replace(c, F.lit("\\\n"), F.lit(JOIN)), F.lit(_TOKEN), F.lit(0)),
                       lambda t: t.startswith("\"") | t.startswith("'"))
    closed = F.forall(strings, lambda t: t.rlike(_WHOLE_STRING))
    bare = F.regexp_replace(masked(content), "[^()\\[\\]{}]", "")
    # the open brackets, innermost first; an x for one that closes nothing
    step = lambda st, b: (F.when(b.isin("(", "[", "{"), F.concat(b, st))
                          .when(F.substring(st, 1, 1) == F.translate(b, ")]}", "([{"), F.substring(st, F.lit(2), F.length(st)))
                          .otherwise(F.concat(F.lit("x"), st)))
    paired = F.aggregate(F.filter(F.split(bare, ""), lambda b: b != ""), F.lit(""), step) == ""

    def owned(ls):
        before = lambda i: F.get(ls, F.greatest(i - 1, F.lit(0)))
        return F.forall(F.transform(ls, lambda l, i: F.when(i == 0, l["indent"] == 0).otherwise(
            (l["indent"] <= before(i)["indent"]) | before(i)["opens"])), lambda ok: ok)

    rows = F.transform(F.filter(logical_lines(content), lambda l: ~l["text"].rlike("^\\s*+$")), lambda l: F.struct(
        F.length(F.regexp_extract(l["text"], "^[ \\t]*+", 0)).alias("indent"), F.rtrim(l["text"]).endswith(":").alias("opens")))
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit(True)).otherwise(closed & paired & bind(rows, owned))


def base_names(header: Column) -> Column:
    """SCP6: names in a class's argument list; ``header`` is the logical line's text behind the
    class name. Calls are left out with everything inside them, at any depth; subscripts and
    keyword arguments give all their names."""
    toks = F.regexp_extract_all(header, F.lit(_NAME + "\\s*\\(|" + _NAME + "|[()\\[\\]{}]"), F.lit(0))
    is_open = lambda t: t.endswith("(") | t.isin("[", "{")
    is_close = lambda t: t.isin(")", "]", "}")

    def pick(ts):
        delta = F.transform(ts, lambda t: F.when(is_open(t), 1).when(is_close(t), -1).otherwise(0))
        after = bind(delta, lambda d: F.transform(d, lambda _, i: F.aggregate(F.slice(d, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b)))
        call = F.transform(ts, lambda t, i: t.endswith("(") & (i > 0)
                           & ((F.length(t) > 1) | is_close(F.get(ts, F.greatest(i - 1, F.lit(0))))))

        def names(a, c):
            end = F.array_position(a, 0)
            inside = lambda i: F.exists(F.sequence(F.lit(0), i), lambda j: F.get(c, j) & (j < i) & (
                F.array_min(F.slice(a, j + 1, i - j + 1)) >= F.get(a, j)))
            kept = F.transform(ts, lambda t, i: F.when(
                ((end == 0) | (i + 1 < end)) & ~is_open(t) & ~is_close(t) & ~inside(i), t))
            return F.filter(kept, lambda t: t.isNotNull())

        return bind(after, lambda a: bind(call, lambda c: names(a, c)))

    none = F.array().cast("array<string>")
    return F.when(F.ltrim(header).startswith("("), bind(toks, pick)).otherwise(none)
