"""Reads of versioned records: what holds now, what held at a version, and what evidence was there.

A decision holds from its version (``version``) to that of the next one on its observation, or to the version
that ended it (``ended``, null or missing if nothing did), whichever is first.  All reads are grouped or
joined by the observation; none compares versions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.checks import contains


def intervals(decisions: DataFrame) -> DataFrame:
    """``decisions`` (observation_id, version, ...) with ``valid_to``, null where it still holds."""
    w = Window.partitionBy("observation_id").orderBy("version")
    following = F.lead("version").over(w)
    return decisions.withColumn("valid_to", F.least(following, F.col("ended")) if "ended" in decisions.columns else following)


def as_of(decisions: DataFrame, asked: DataFrame) -> DataFrame:
    """The decision that each row of ``asked`` (observation_id, as_of) finds; rows that find none are left out."""
    return asked.join(intervals(decisions), "observation_id").where(contains(F.col("version"), F.col("valid_to"), F.col("as_of")))


def current(decisions: DataFrame) -> DataFrame:
    """The newest decision of each observation, unless it has ended; an older one does not come back.

    An aggregation, so that observations with many decisions send one for each map task.
    """
    rest = [c for c in decisions.columns if c not in ("observation_id", "version")]
    best = decisions.groupBy("observation_id").agg(F.max(F.struct("version", *rest)).alias("_b")).select("observation_id", "_b.*")
    return best.where("ended IS NULL") if "ended" in rest else best


def observations_as_of(observations: DataFrame, event_time: int, version: int) -> DataFrame:
    """Evidence whose event was not later and that had been committed, by id."""
    return observations.where((F.col("event_time") <= event_time) & (F.col("version") <= version)).orderBy("observation_id")


def contiguous(versions: DataFrame) -> DataFrame:
    """``versions`` (version, ...), one row for each, with ``contiguous`` (the one before is there) and ``latest``."""
    before = versions.select((F.col("version") + 1).alias("version"), F.lit(True).alias("_has"))
    after = versions.select((F.col("version") - 1).alias("version"), F.lit(False).alias("_last"))
    x = versions.join(before, "version", "left").join(after, "version", "left")
    has = F.coalesce("_has", F.lit(False)) | (F.col("version") == 1)
    return x.select(*versions.columns, has.alias("contiguous"), F.coalesce("_last", F.lit(True)).alias("latest"))
