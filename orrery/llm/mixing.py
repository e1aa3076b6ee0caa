"""Operator 6: mix sources to target weights by hierarchical budgeting.

A token budget is propagated through a tree of domain, language and source.  At each node it is dealt
to the children in proportion to their weights, no child getting more than its subtree can supply; a
shortage goes to the siblings first, and only what they cannot supply either goes up to the ancestor's
other children.  (Dealing top-down by subtree capacities gives just that.)  Each leaf then gets whole
epochs and, of the next seeded epoch, the prefix of documents that the rest of its tokens pays for.

Defined results: null domain, lang or source is the child "other"; a null or empty text has no tokens,
and is taken with whatever prefix it falls into; a weight that is not named is 1; children of weight 0
get nothing; rows that repeat a ``doc_id`` stand next to each other in the order, by their tokens; of rows that
are equal in both, as many are taken as the budget pays for, by a hash of the text; a null ``doc_id`` is ordered as -1;
an empty table gives an empty result; other columns are left as they are, whatever their names, but for
``_domain``, ``_tokens`` and ``_copies``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.text import unused, words
from orrery.session import intermediate, written

#: Up to so many leaves (about 100 bytes each) the leaf table is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST_LEAVES = 20_000
#: Parts of an octave in which the water level is looked for.
STEPS = 64
LEVELS = ("domain", "lang", "source")


def default_domain() -> Column:
    """The tables have no domain: sources are dealt to four by their number."""
    number = F.expr("try_cast(substr(source, 4) AS int)")
    return F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("other"))


def _weights(level: str, weights: dict) -> Column:
    w = F.lit(1.0)
    for value, weight in sorted(weights.get(level, {}).items()):
        w = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(w)
    return w


def fill(nodes: DataFrame, parents: list[str], child: str, weights: dict) -> DataFrame:
    """Deal ``budget`` of each parent to its children: adds ``quota``.

    ``nodes``: parents, child, capacity, budget.  Water filling in closed form: in the order of capacity
    for a unit of weight, a child is full while the level of what is left exceeds its own.

    Scale: children of equal ratio are full or open together, so they are summed first.  The level is then
    looked for in octaves of the ratio, ``STEPS`` to each, and only the ratios of the one step in which it
    lies are ordered: a parent with any number of children never meets in one task.
    """
    if not parents:
        return fill(nodes.withColumn("_root", F.lit(0)), ["_root"], child, weights).drop("_root")
    # written, since the plan reads it three times, and the next level down reads that
    weighted = written(nodes, "mix-level").withColumn("_w", _weights(child, weights))
    ratio = F.col("capacity") / F.col("_w")
    each = weighted.where(F.col("_w") > 0).groupBy(*parents, ratio.alias("_ratio")).agg(F.sum("capacity").alias("_cap"), F.sum("_w").alias("_w"), F.first("budget").alias("budget"))
    step = F.coalesce(F.floor(F.log2(F.col("_ratio")) * STEPS), F.lit(-(1 << 20)))
    each = each.withColumn("_step", step)
    by = Window.partitionBy(*parents)

    def below(c: str, order: str) -> Column:
        return F.coalesce(F.sum(c).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    steps = each.groupBy(*parents, "_step").agg(F.sum("_cap").alias("_cap"), F.sum("_w").alias("_w"), F.max("_ratio").alias("_top"), F.first("budget").alias("budget"))
    # what the steps before take, and the weight from here on
    steps = steps.withColumn("_before", below("_cap", "_step")).withColumn("_after", F.sum("_w").over(by) - below("_w", "_step"))
    # its last children are not full, and those of all steps before are
    not_full = F.col("budget") < F.col("_before") + F.col("_cap") + F.col("_top") * (F.col("_after") - F.col("_w"))
    found = F.min(F.when(not_full, F.struct("_step", "_top", "_before", "_after")))
    edge = steps.groupBy(*parents).agg(found.alias("e")).where("e IS NOT NULL").select(*parents, "e.*")
    edge = edge.toDF(*parents, "_step", "_top", "_base", "_weight")
    inside = each.join(edge, [*parents, "_step"])
    level = F.greatest(F.col("budget") - F.col("_base") - below("_cap", "_ratio"), F.lit(0)) / (F.col("_weight") - below("_w", "_ratio"))
    inside = inside.withColumn("_level", level).where((F.col("_level") < F.col("_ratio")) | (F.col("_ratio") >= F.col("_top")))
    levels = inside.groupBy(*parents).agg(F.min_by("_level", "_ratio").alias("_level"))
    capacity = F.col("capacity").cast("double")
    quota = F.when(F.col("_w") <= 0, F.lit(0.0)).when(F.col("_level").isNull(), capacity).otherwise(F.least(capacity, F.col("_level") * F.col("_w")))
    return weighted.join(levels, parents, "left").withColumn("quota", quota).drop("_w", "_level")


def leaf_budgets(leaves: DataFrame, share: float, weights: dict, max_epochs: int) -> DataFrame:
    """``leaves``: the three levels and ``supply``.  Adds ``quota``, whole tokens."""
    cap = written(leaves.withColumn("capacity", F.col("supply") * max_epochs), "mix-leaves")
    total = F.sum("supply").over(Window.partitionBy(F.lit(0)))
    top = cap.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply")).withColumn("budget", total * F.lit(float(share)))
    top = fill(top, [], "domain", weights).select("domain", F.col("quota").alias("budget"))
    mid = cap.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(top, "domain")
    mid = fill(mid, ["domain"], "lang", weights).select("domain", "lang", F.col("quota").alias("budget"))
    low = cap.join(mid, ["domain", "lang"])
    # a millionth absorbs the last bits of the divisions
    return fill(low, ["domain", "lang"], "source", weights).select(*LEVELS, "supply", F.floor(F.col("quota") + 1e-6).cast("long").alias("quota"))


def mix(
    docs: DataFrame,
    share: float = 0.6,
    weights: dict | None = None,
    max_epochs: int = 3,
    seed: int = 17,
    domain: Column | None = None,
    tokens: Column | None = None,
    depth: int = 6,
) -> DataFrame:
    """``docs`` with ``_domain``, ``_tokens`` and ``_copies``: how often each document is taken.

    ``share``: the budget as a part of all tokens; ``weights``: for each level, weights by value.
    Scale: texts are not shuffled.  A leaf's prefix ends in one bucket of its seeded order, which is
    found by histograms of 256 buckets, summed before the shuffle, each inside the one before (``depth``
    hexadecimal digits of the key in all: 16 million buckets).  Only that last bucket is ordered row by
    row, so a leaf with a third of all documents never meets in one task.  Documents then compare their own
    order key with their leaf's cut.
    """
    weights = weights or {}
    docs = docs.drop("_domain", "_tokens", "_copies")
    leaf_domain, leaf_lang, leaf_source, whole_, rest_, out_, tie_ = unused(docs, "leaf_domain", "leaf_lang", "leaf_source", "whole", "rest", "out", "tie")
    other = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("other"))
    n = (F.size(words(F.col("text"))) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long")
    own = docs.select("*", F.coalesce(default_domain() if domain is None else domain, F.lit("other")).alias("_domain"), n.alias("_tokens"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("-1"))
    with intermediate() as keep:
        slim = own.select(F.col("_domain").alias("domain"), other("lang").alias("lang"), other("source").alias("source"), id_text.alias("id"), F.col("_tokens").alias("tokens"))
        slim = written(slim, "mix-tokens")
        leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
        plan = leaf_budgets(leaves, share, weights, max_epochs)
        whole = F.when(F.col("supply") > 0, F.floor(F.col("quota") / F.col("supply"))).otherwise(F.lit(0)).cast("long")
        plan = plan.withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("supply"))
        plan = written(plan, "mix-plan")
        few = plan.count() <= MAX_BROADCAST_LEAVES
        near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
        keyed = slim.join(near(plan), list(LEVELS)).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.col("id"))))
        cut = written(plan.join(first_outside(keyed.select(*LEVELS, "key", "id", "tokens"), plan, near, depth), list(LEVELS), "left"), "mix-cut")
        keep(cut)
    cut = cut.select(*[F.col(c).alias(a) for c, a in zip(LEVELS, (leaf_domain, leaf_lang, leaf_source), strict=True)], F.col("whole").alias(whole_), F.col("rest").alias(rest_), F.col("out").alias(out_))
    on = (F.col("_domain") == F.col(leaf_domain)) & (other("lang") == F.col(leaf_lang)) & (other("source") == F.col(leaf_source))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(whole_).cast("string"), F.lit(":"), id_text))
    mine = F.struct(key.alias("key"), id_text.alias("id"), F.col("_tokens").alias("tokens"))
    last = F.struct(F.col(f"{out_}.key").alias("key"), F.col(f"{out_}.id").alias("id"), F.col(f"{out_}.tokens").alias("tokens"))
    partly = (F.col(rest_) > 0) & (F.col(out_).isNull() | (mine < last))
    taken = lambda more: (F.col(whole_) + more.cast("long")).alias("_copies")
    columns = [*docs.columns, "_domain", "_tokens"]
    if cut.where(F.col(out_).isNotNull() & (F.col(f"{out_}.fit") > 0)).isEmpty():
        return own.join(near(cut), on).select(*columns, taken(partly))
    # some leaf's prefix ends among equal rows: these alone are numbered
    tied = (F.col(rest_) > 0) & F.coalesce((F.col(f"{out_}.fit") > 0) & (mine == last), F.lit(False))
    joined = own.join(near(cut), on).withColumn(tie_, tied)
    number = F.row_number().over(Window.partitionBy(leaf_domain, leaf_lang, leaf_source).orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    rest = joined.where(~F.col(tie_)).select(*columns, taken(partly))
    ties = joined.where(F.col(tie_)).withColumn(tie_, number <= F.col(f"{out_}.fit")).select(*columns, taken(F.col(tie_)))
    return rest.unionByName(ties)


def first_outside(keyed: DataFrame, plan: DataFrame, near, depth: int) -> DataFrame:
    """For each leaf whose prefix ends before its last row: ``out`` (key, id, tokens, fit), the first row outside.

    ``fit``: how many rows equal to it the prefix still takes.
    """
    # the bucket of keys in which the prefix ends, two more digits at a time, and what is left when it begins
    edge = plan.select(*LEVELS, F.lit("").alias("bucket"), F.col("rest").alias("left"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for digits in range(2, depth + 1, 2):
        inside = keyed.join(near(edge), list(LEVELS)).where(F.substring("key", 1, digits - 2) == F.col("bucket"))
        sums = inside.groupBy(*LEVELS, F.substring("key", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("n"), F.first("left").alias("left"))
        sums = sums.withColumn("end", F.sum("n").over(upto)).where((F.col("end") > F.col("left")) & (F.col("end") - F.col("n") <= F.col("left")))
        first = F.min(F.struct("bucket", (F.col("left") - F.col("end") + F.col("n")).alias("left")))
        edge = written(sums.groupBy(*LEVELS).agg(first.alias("e")).select(*LEVELS, "e.bucket", "e.left"), "mix-edge")
    # rows equal in key, id and tokens are one row with a number here, so that a repeated row is no longer a run
    inside = keyed.join(near(edge), list(LEVELS)).where(F.substring("key", 1, depth) == F.col("bucket"))
    same = inside.groupBy(*LEVELS, "key", "id", "tokens").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    running = Window.partitionBy(*LEVELS).orderBy("key", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("sum", F.sum(F.col("tokens") * F.col("n")).over(running)).where(F.col("sum") > F.col("left"))
    fit = F.floor((F.col("left") - F.col("sum") + F.col("tokens") * F.col("n")) / F.col("tokens")).alias("fit")
    return same.groupBy(*LEVELS).agg(F.min(F.struct("key", "id", "tokens", fit)).alias("out"))
