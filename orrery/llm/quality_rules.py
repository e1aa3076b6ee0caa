"""Operator 2: quality rules with cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed with their host; distinct documents are counted for each hash; lines
above the limit are removed; documents that are left depleted are rejected.  Word and line statistics
of the text itself (the base rules) come from array functions inside the row, without any shuffle.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of
its own; rows with a null ``doc_id`` are judged by the base rules and count for no line; repeated rows
each get a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import BLANK, BLANKS, let, words
from orrery.session import written

MIN_WORDS = 50
#: A line of a host that more documents hold than this is removed.
MAX_DOCS_PER_HOST = 20
#: A document whose removed lines leave less than this part of its words is depleted.
MIN_LEFT = 0.3


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.  ``w``: a bound array of words.

    Windows are compared by 64-bit hashes; they are sorted with their places only in texts that
    repeat one at all.
    """
    places = F.sequence(F.lit(0), F.size(w) - 3)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(hashes: Column) -> Column:
        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return let(
                F.transform(twice, lambda x: x["i"]),
                lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2))),
            )

        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, of))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.transform(places, window), covered)).cast("long")


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    blanks = F.length(text) - F.length(F.translate(text, BLANKS, ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    dup = let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(text) - blanks).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def _host_lines(text: Column, host: Column, version: Column) -> Column:
    lines = F.split(F.lower(text), "\n", -1)
    counted = F.transform(
        F.transform(lines, lambda line: F.btrim(line, F.lit(BLANKS))),
        lambda k: F.struct(F.xxhash64(F.coalesce(host, F.lit("\x00")), k).alias("a"), F.hash(F.coalesce(host, F.lit("\x00")), k).alias("b"), version.alias("version"), F.regexp_count(k, F.lit(BLANK + "+")).alias("gaps"), F.length(k).alias("n")),
    )
    return F.transform(F.filter(counted, lambda x: x["n"] > 0), lambda x: F.struct(x["a"], x["b"], x["version"], (x["gaps"] + 1).cast("long").alias("words")))


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, max_docs: int = MAX_DOCS_PER_HOST, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and n_removed_words, for each row of ``docs``.

    96 bits of hash stand for a line of a host.  Scale: texts are never shuffled.  Rows of (line hash, document) are combined by document first;
    the count for each line combines before its shuffle, so a line of a third of all documents is one
    row for each map task; the join back is a sort-merge join, whose skewed keys are split.
    """
    version = F.xxhash64("text")
    rows = (
        docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
        .select("doc_id", F.inline(let(version, lambda v: _host_lines(F.col("text"), F.col(host), v))).alias("a", "b", "version", "words"))
        .groupBy("a", "b", "doc_id", "version")
        .agg(F.sum("words").alias("words"))
    )
    # written, so that texts are hashed once and both sides of the join are plain tables, whose skewed keys can be split
    held = written(rows, "host-lines")
    over = held.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("_one")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("a", "b")
    over = written(over, "host-lines-over")
    gone_lines = written(held.join(over.hint("merge"), ["a", "b"]).select("doc_id", "version", "words"), "host-lines-gone")
    removed = gone_lines.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(F.sum("words").alias("_removed"))
    stats = docs.select("doc_id", version.alias("_v"), text_statistics(F.col("text")).alias("s")).select("doc_id", "_v", "s.*")
    found = stats.join(removed, (stats["doc_id"] == removed["_id"]) & (stats["_v"] == removed["_version"]), "left")
    gone = F.coalesce("_removed", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= F.lit(min_left) * F.col("n_words"))).alias("kept"),
        gone.alias("n_removed_words"),
    )
