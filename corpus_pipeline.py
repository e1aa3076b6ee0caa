"""The corpus pipeline: five stages from ``documents`` to encoded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.

Defined results: every stage passes on nulls as its operator defines them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import line_dedup, mixing, ngram_join, pieces, toxicity
from orrery.session import intermediate, release, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mixture: nine tenths of the tokens, each document once at most.
MIX = {"domain": {"d0": 3.0, "d1": 2.5, "d2": 2.5, "d3": 2.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "source": {"src0": 3.0}}
SHARE, EPOCHS, SEED = 0.9, 1, 17


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs.select(*COLUMNS), model).where(F.col("score") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share; ``n_chars`` follows the text."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document of the smallest doc_id; of rows that repeat a doc_id, one."""
    docs = docs.select(*COLUMNS)
    groups = ngram_join.jaccard_components(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    twice = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    # both sides are narrow lists of ids; texts are shuffled once, and only repeated rows are sorted out
    marks = gone.withColumn("_mark", F.lit("gone")).unionByName(twice.withColumn("_mark", F.lit("twice")))
    marked = docs.join(marks.hint("shuffle_hash"), "doc_id", "left").where(F.col("_mark").isNull() | (F.col("_mark") == "twice"))
    marked = written(marked, "marked")
    once = marked.where(F.col("_mark") == "twice").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return marked.where(F.col("_mark").isNull()).select(*COLUMNS).unionByName(once.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, each as often as it takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS), SHARE, MIX, EPOCHS, SEED).where("_copies > 0")
    if EPOCHS > 1:
        mixed = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return mixed.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of ids, the ids, and the hashes of ids and decoded text."""
    return pieces.encode_texts(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: Boosted trees and SentencePiece are not SQL: tests compare run() with a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Of the tables on the way only those stay that this result, which is lazy, reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with intermediate() as keep:
            after = written(stage(spark, docs, sf_dir), "stage")
            keep(after)
        if before is not None:
            release(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
