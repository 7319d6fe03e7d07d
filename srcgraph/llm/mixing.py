"""Mixing sources to target weights (1): hierarchical budgets and token prefixes of seeded epochs.

The tree is domain -> language -> source. A token budget is handed down from the root in proportion to the
children's weights, but never beyond what a child's subtree can give (its tokens times the epochs allowed).
What a child cannot take goes to its siblings first, in proportion to their weights, since the subtree's
capacity already counts all it could place itself (nothing below a weight of 0); only what all siblings together
cannot take stays above.
Each leaf's budget buys whole epochs of its documents and a prefix of one more, in an order that the seed and
the epoch fix.

Leaves are summed with partial aggregation. The prefix of a leaf, which may hold a third of all rows, is found
in two steps over buckets of the order key: running sums of bucket totals, then a running sum inside the one
bucket in which the budget ends. What results is a small table of (leaf, whole epochs, last key), so documents
are chosen by one join with that table and no text is shuffled: the table is broadcast up to ``MAX_BROADCAST``
leaves, by its counted rows, and joined by its keys beyond.
"""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.session import materialize

from .common import SPACE_CLASS, of, rows, text_of, unrow

MAX_BROADCAST = 100_000
ROWS_PER_BUCKET = 10_000
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words: maximal runs of characters outside white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS[1:]}+")).cast("long")


def hash_domain(source: str = "source", n: int = 4) -> Column:
    """A domain where the table has none: sources dealt to ``n`` domains by their MD5."""
    first = F.conv(F.substring(F.md5(F.coalesce(F.col(source), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.concat(F.lit("d"), (first % n).cast("string"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), epoch.cast("string"),
                             F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(level: str, weights: Mapping[str, float] | None) -> Column:
    """A child's weight: the one given for its value, else 1."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(table[F.col(level)], F.lit(1.0))


def _share(children: DataFrame, parent: list[str], level: str, weights: Mapping[str, float] | None) -> DataFrame:
    """children: parent columns, level, cap, given (the parent's budget); adds ``budget`` by filling in order of
    cap / weight: children that cannot take their share of what is left take all they can."""
    key = parent or [F.lit(0)]
    c = children.withColumn("w", F.greatest(_weight(level, weights), F.lit(0.0)))
    c = c.withColumn("r", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    w = Window.partitionBy(*key).orderBy(F.col("r"), F.col(level).asc_nulls_first())
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = c.withColumn("left", F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")))
    c = c.withColumn("all_w", F.sum("w").over(behind))
    c = c.withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("all_w") <= F.col("left") * F.col("w")))
    rate = F.when(F.col("full") | (F.col("w") == 0), None).otherwise(F.col("left") / F.col("all_w"))
    c = c.withColumn("rate", F.first(rate, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return c.withColumn("budget", F.when(F.col("full"), F.col("cap")).when(F.col("w") == 0, F.lit(0).cast("long")).otherwise(
        F.least("cap", F.floor(F.col("rate") * F.col("w")).cast("long")))).drop("w", "r", "left", "all_w", "full", "rate")


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """leaves: (domain, lang, source, docs, tokens); adds ``budget`` in tokens (rounded down) per leaf.

    ``weights``: per level a mapping of values to weights; a value not named has weight 1, weight 0 gives nothing.
    """
    weights = weights or {}
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    given = None
    for i, level in enumerate(LEVELS):
        parent = list(LEVELS[:i])
        # a subtree can place what its leaves hold that are reached by weights above 0
        some = reduce(Column.__and__, [_weight(x, weights.get(x)) > 0 for x in LEVELS[i + 1:]], F.lit(True))
        node = leaves if i == 2 else leaves.groupBy(*LEVELS[:i + 1]).agg(F.sum(F.when(some, F.col("cap")).otherwise(0)).alias("cap"))
        if given is None:
            node = node.withColumn("given", F.lit(budget).cast("long"))
        else:
            up = given.select(*[F.col(p).alias(f"up_{p}") for p in parent], F.col("budget").alias("given"))
            on = [F.col(p).eqNullSafe(F.col(f"up_{p}")) for p in parent]
            node = node.join(up, on).drop(*[f"up_{p}" for p in parent])
        given = materialize(_share(node, parent, level, weights.get(level)).drop("given"), f"mix-{level}")
    return given


def _same_leaf() -> list[Column]:
    return [F.col(x).eqNullSafe(F.col(f"p_{x}")) for x in LEVELS]


def plan_mix(docs: DataFrame, budget_share: float = 0.5, budget: int | None = None, max_epochs: int = 4, seed: int = 1,
             weights: Mapping[str, Mapping[str, float]] | None = None, domain: Column | None = None,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The plan, one row per leaf: p_domain, p_lang, p_source, docs, tokens, budget, epochs (whole ones) and last
    (the greatest order key taken in the epoch after them; null: none)."""
    d = materialize(docs.select((hash_domain() if domain is None else domain).alias("domain"), F.col("lang"), F.col("source"),
                                F.col(doc_id).alias("id"), token_count(text_of(text)).alias("tokens")), "mix-docs")
    leaves = materialize(d.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, int(total * budget_share) if budget is None else budget, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    plan = plan.select(*[F.col(x).alias(f"p_{x}") for x in LEVELS], "docs", "tokens", "budget", whole.alias("epochs"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = materialize(plan.withColumn("n_buckets", (F.col("docs") / ROWS_PER_BUCKET).cast("long") + 1), "mix-plan")
    part = _small(plan.where("rest > 0").select(*[f"p_{x}" for x in LEVELS], "epochs", "rest", "n_buckets"))
    k = d.join(part, _same_leaf()).withColumn("key", order_key(seed, F.col("epochs") + 1, F.col("id")))
    # the first 32 bits of the key as a fraction, so that buckets follow the order of keys
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    leaf = [f"p_{x}" for x in LEVELS]
    k = k.withColumn("bucket", F.shiftright(at * F.least(F.col("n_buckets"), F.lit(1 << 30)), 32))
    sums = k.groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0).cast("long")))
    # the last bucket that begins before the budget ends
    edge = sums.where("before < rest").groupBy(*leaf).agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("e"))
    edge = _small(materialize(edge.select(*[F.col(x).alias(f"e{x}") for x in leaf], F.col("e.bucket").alias("eb"),
                                          F.col("e.before").alias("before")), "mix-edges"))
    inside = k.join(edge, [F.col(x).eqNullSafe(F.col(f"e{x}")) for x in leaf] + [F.col("bucket") == F.col("eb")])
    # rows of equal key go together: they begin at the same count
    upto = Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = inside.groupBy(*leaf, "rest", "before", "key").agg(F.sum("tokens").alias("t"))
    same = same.withColumn("begin", F.col("before") + F.sum("t").over(upto) - F.col("t"))
    last = same.where("begin < rest").groupBy(*leaf).agg(F.max("key").alias("last")).withColumnsRenamed({x: f"e{x}" for x in leaf})
    out = plan.join(last, [F.col(x).eqNullSafe(F.col(f"e{x}")) for x in leaf], "left")
    return materialize(out.select(*leaf, "docs", "tokens", "budget", "epochs", "last"), "mix-last")


def _small(table: DataFrame) -> DataFrame:
    """A hint to broadcast a written table of up to MAX_BROADCAST rows (some MB); a larger one is joined by its keys."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table


def mix(docs: DataFrame, seed: int = 1, domain: Column | None = None, doc_id: str = "doc_id", text: str = "text",
        **how) -> DataFrame:
    """The documents chosen, in ``docs``' columns with mix_domain, mix_tokens and mix_times (how often to read it).

    Rows with mix_times = 0 are left out. Null values of lang and source are leaves of their own; a null or empty
    text has no tokens and goes with the prefix that it stands in. Rows that repeat an id have the same key and go
    together; a prefix is the shortest that reaches the leaf's budget, so it passes it by less than its last
    documents. A leaf without tokens, an empty table or a budget of 0 gives no rows. New columns replace input
    columns of the same name.
    """
    plan = _small(plan_mix(docs, seed=seed, domain=domain, doc_id=doc_id, text=text, **how))
    dom = hash_domain() if domain is None else domain
    c = docs.columns
    d = rows(docs.select(*[F.col(f"`{x}`") for x in c], dom.alias("mix_domain_of_row"))).withColumnRenamed(f"_c{len(c)}", "domain")
    d = d.withColumns({"lang": of(c, "lang"), "source": of(c, "source"), "id": of(c, doc_id),
                       "n": token_count(F.coalesce(of(c, text), F.lit("")))})
    j = d.join(plan, _same_leaf())
    more = F.col("last").isNotNull() & (order_key(seed, F.col("epochs") + 1, F.col("id")) <= F.col("last"))
    j = j.withColumn("times", F.col("epochs") + F.coalesce(more, F.lit(False)).cast("int")).where("times > 0")
    return unrow(j, c, mix_domain=F.col("domain"), mix_tokens=F.col("n"), mix_times=F.col("times"))


def repeat_by_times(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of a mix, each row as often as mix_times says."""
    return mixed.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(
        *[F.col(f"`{c}`") for c in columns])
