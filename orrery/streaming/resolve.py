"""Structured Streaming forms: event files in, workspace and ledger out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import candidates
from orrery.operators.infer import Config
from orrery.operators.ledger import Ledger
from orrery.operators.runtime import Runtime
from orrery.plans import adapters
from orrery.session import scratch, table
from orrery.sources.kv import FolderBackend
from orrery.streaming.ingress import limited


def workspace_from_stream(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """identity_id, n, last_activation after all events.

    Stateful aggregation without a watermark: evidence that comes late still counts, since neither clock
    may drop it.  A micro-batch writes only the identities that it changed, as the table of its batch id, so a
    repeated batch changes nothing; of each identity the last batch holds.
    """
    root = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").repartition(parts).write.parquet(f"{root}/in")
    events = limited(spark, f"{root}/in", 1)
    state = events.groupBy(F.col("user_id").alias("identity_id")).agg(F.count(F.lit(1)).alias("n"), F.max(adapters.micros(F.col("ts"))).alias("last_activation"))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    q = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    last = out.groupBy("identity_id").agg(F.max(F.struct("batch", "n", "last_activation")).alias("l"))
    return last.select("identity_id", "l.n", "l.last_activation")


class ValueProvider:
    """Gates events by a block of the user number and scores users by closeness to the event's value."""

    provider_id, model_version = 1, 1

    def __init__(self, identities: DataFrame, blocks: int):
        self.identities, self.blocks = identities, blocks

    def generate_candidates(self, observations: DataFrame) -> DataFrame:
        return candidates.gate(observations, self.identities, F.col("user_id") % self.blocks, F.col("identity_id") % self.blocks)

    def emit_factors(self, observations: DataFrame, gated: DataFrame) -> DataFrame:
        groups = candidates.groups(gated).join(observations.select("observation_id", "value"), "observation_id")
        scores = F.concat(F.transform("candidates", lambda i: -F.abs(F.col("value") - 2 * i) / 20), F.array(F.lit(0.0), F.lit(0.0)))
        n = F.size("candidates") + 2
        return groups.select(F.lit(1).cast("long").alias("batch_id"), F.col("observation_id").alias("factor_id"), F.array("observation_id").alias("variables"), F.array(n).alias("cardinalities"), scores.alias("log_potentials"))


def resolve_stream(stream: DataFrame, runtime: Runtime, name: str, checkpoint: str):
    """Start a query that resolves each micro-batch.  The batch's number is its idempotency key, so one
    that is tried again after a failure commits nothing twice."""

    def put(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            runtime.process(batch, f"{name}:{batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolved_from_stream(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    """observation_id, action, identity_id of all events, resolved in ``parts`` micro-batches.

    An event that supersedes a missing one is rejected and gets no decision.
    """
    root = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    o = adapters.observations(spark, sf_dir).select("observation_id", "ingestion_time", "content_hash", "supersedes", "user_id", "value")
    # one file after the other by ascending id, since files are read by their time: what is superseded comes first
    lo, hi = o.agg(F.min("observation_id"), F.max("observation_id")).first()
    step = -(-(hi - lo + 1) // parts) if hi is not None else 1
    for k in range(parts if hi is not None else 0):
        part = o.where((F.col("observation_id") >= lo + k * step) & (F.col("observation_id") < lo + (k + 1) * step))
        part.repartition(1).write.mode("append").parquet(f"{root}/in")
    runtime = Runtime(Ledger(FolderBackend(spark, f"{root}/ledger")), f"{root}/tables", [ValueProvider(adapters.identities(spark, sf_dir).select("identity_id"), adapters.blocks(spark, sf_dir))], Config(new_prior=-1.0, noise_prior=-2.0))
    resolve_stream(limited(spark, f"{root}/in", 1), runtime, "events", f"{root}/state").awaitTermination()
    return runtime.ledger.table(spark, "decisions").select("observation_id", "action", "identity_id")
