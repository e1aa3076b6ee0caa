"""Operator 10: line dedup across documents, in DataFrame functions only.

Normalised lines are exploded and hashed, distinct documents are counted for each hash, lines over
the threshold are dropped, and what stays is reassembled by position.

Defined results: a null or empty text is one empty line, which stays; a blank line has an empty key
and is never dropped; of repeated rows with one ``doc_id`` each loses its own lines, counted as one
document; rows with a null ``doc_id`` are never counted nor changed; an empty table gives an empty
result; other columns are left as they are, whatever their names, but for ``n_lines`` and ``n_dropped``,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import BLANKS, ascii_lower, let, unused
from orrery.session import written

MIN_CHARS = 40
MIN_DOCS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    """The key of each line."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` cleaned, ``n_lines`` and ``n_dropped`` (before, dropped).

    A key of ``min_chars`` code points or more, found in ``min_docs`` documents or more, loses all its
    lines but those of the largest ``doc_id`` that holds it.  96 bits of hash stand for a key.

    Scale: only (document, key hash) pairs of long lines are shuffled, with counts combined before the
    shuffle.  A line that a third of all documents holds is one row for each map task in the count; in
    the join back it is a skewed key of a sort-merge join, which adaptive execution splits.
    """
    drop_id, drop_at = unused(docs, "drop_id", "drop_at")

    def hashed(version: Column) -> Column:
        long_lines = F.filter(F.transform(_keys(F.col("text")), lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: F.length(x["k"]) >= min_chars)
        return F.transform(
            long_lines,
            lambda x: F.struct(F.xxhash64(x["k"]).alias("a"), F.hash(x["k"]).alias("b"), F.struct(version.alias("v"), x["i"].alias("i")).alias("at")),
        )

    rows = (
        docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
        .select("doc_id", F.inline(let(F.xxhash64("text"), hashed)).alias("a", "b", "at"))
    )
    # written, so that texts are hashed once and both sides of the join are plain tables, whose skewed keys can be split
    rows = written(rows, "lines")
    once = rows.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("_one"))
    over = (
        once.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("a", "b", "keeper")
    )
    over = written(over, "lines-over")
    gone = written(rows.join(over.hint("merge"), ["a", "b"]).where(F.col("doc_id") != F.col("keeper")).select(F.col("doc_id").alias(drop_id), "at"), "lines-gone")
    drops = gone.groupBy(drop_id).agg(F.collect_list("at").alias(drop_at))
    joined = docs.join(drops.hint("shuffle_hash"), docs["doc_id"] == drops[drop_id], "left")

    # of rows that repeat a doc_id, each has its own version of the text
    at = let(F.xxhash64("text"), lambda v: F.transform(F.filter(drop_at, lambda x: x["v"] == v), lambda x: x["i"]))
    joined = joined.withColumn(drop_at, F.when(F.col(drop_at).isNotNull(), at))

    def rebuilt(lines: Column) -> Column:
        # positions, so that the cost is linear in the lines however many are dropped
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop_at))
        return F.concat_ws("\n", F.transform(stay, lambda i: F.get(lines, i)))

    text = F.when(F.coalesce(F.size(drop_at), F.lit(0)) <= 0, F.coalesce("text", F.lit(""))).otherwise(let(_lines(F.col("text")), rebuilt))
    n_lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    cleaned = joined.select(
        *[c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")],
        text.alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size(drop_at), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return cleaned
