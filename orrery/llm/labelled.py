"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import held_out
from orrery.session import written


def training_rows(docs: DataFrame, labels: DataFrame, target: str, most: int, seed: int) -> DataFrame:
    """doc_id, text, y of ``most`` labelled documents at most, none of them held out.

    The sample is the first in a seeded hash order of the ids, so it is the same however the tables are
    partitioned; an id with several labels counts once (the larger label).  Only labels and ids are
    sorted; the ids (8 bytes each, ``most`` at most) are broadcast to find their texts.  Rows that share
    an id are taken once.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("y"))
        .orderBy(order, "doc_id")
        .limit(most)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return written(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), f"train-{target}")
