"""The active workspace: what is known now of each identity, derived from committed associations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_history(entries: DataFrame, capacity: int, by: str = "identity_id", order: str = "version") -> DataFrame:
    """(by, history): the newest ``capacity`` values of ``order``, oldest first.

    The rank limit is pushed below the shuffle, so a busy identity sends ``capacity`` rows for each map task.
    """
    if capacity <= 0:
        return entries.select(by).dropDuplicates().withColumn("history", F.array().cast("array<long>"))
    w = Window.partitionBy(by).orderBy(F.desc(order))
    top = entries.select(by, order).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= capacity)
    return top.groupBy(by).agg(F.sort_array(F.collect_list(order)).alias("history"))


def evicted_history(entries: DataFrame, capacity: int, by: str = "identity_id", order: str = "version") -> DataFrame:
    """What ``bounded_history`` leaves out: the rows beyond the newest ``capacity``."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return entries.withColumn("_k", F.row_number().over(w)).where(F.col("_k") > max(capacity, 0)).drop("_k")


def history_error(capacity: int, size) -> F.Column:
    return F.when(size > capacity, "OverCapacity")


def apply_committed(associations: DataFrame, capacity: int, current: DataFrame | None = None) -> DataFrame:
    """identity_id, version, last_activation, commits, history after committed associations.

    ``associations``: identity_id, version, activation, decision_id.  Those of one identity and version
    count as one commit.  What is not newer than the version in ``current`` is stale and left out (see
    ``stale``).  The activation is the latest seen, whatever the order of arrival.
    """
    if current is not None:
        associations = _fresh(associations, current, stale=False)
    per = associations.groupBy("identity_id", "version").agg(F.max("activation").alias("activation"))
    new = per.groupBy("identity_id").agg(F.max("version").alias("version"), F.max("activation").alias("last_activation"), F.count(F.lit(1)).alias("commits")).join(bounded_history(per, capacity), "identity_id")
    if current is None:
        return new
    a = current.toDF(*[f"_{c}" for c in current.columns])
    x = new.join(a, F.col("identity_id") == F.col("_identity_id"), "full")
    both = F.concat(F.coalesce("_history", F.array().cast("array<long>")), F.coalesce("history", F.array().cast("array<long>")))
    return x.select(
        F.coalesce("identity_id", "_identity_id").alias("identity_id"),
        F.greatest("version", "_version").alias("version"),
        F.greatest("last_activation", "_last_activation").alias("last_activation"),
        (F.coalesce("commits", F.lit(0)) + F.coalesce("_commits", F.lit(0))).alias("commits"),
        F.slice(both, F.greatest(F.size(both) - capacity, F.lit(0)) + 1, capacity).alias("history"),
    )


def _fresh(associations: DataFrame, current: DataFrame, stale: bool) -> DataFrame:
    at = current.select(F.col("identity_id"), F.col("version").alias("_at"))
    x = associations.join(at, "identity_id", "left")
    old = F.coalesce(F.col("version") <= F.col("_at"), F.lit(False))
    return x.where(old if stale else ~old).drop("_at")


def stale(associations: DataFrame, current: DataFrame) -> DataFrame:
    """Associations whose version does not advance the identity's."""
    return _fresh(associations, current, stale=True)


def evict_before(workspace: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): activation strictly before the cutoff goes."""
    gone = F.col("last_activation") < cutoff
    return workspace.where(~gone), workspace.where(gone)


def upsert_summaries(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Summaries (identity_id, provider_id, schema_id, version, ...): of equal keys the last version stays."""
    every = current.unionByName(fresh)
    rest = [c for c in every.columns if c not in ("identity_id", "provider_id", "schema_id")]
    newest = every.groupBy("identity_id", "provider_id", "schema_id").agg(F.max_by(F.struct(*rest), F.col("version")).alias("_s"))
    return newest.select("identity_id", "provider_id", "schema_id", "_s.*")
