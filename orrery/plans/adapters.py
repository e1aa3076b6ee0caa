"""Domain tables derived from the generated star schema, by fixed rules that SQL can follow too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.session import table

#: Users of a block of candidates, about: an observation has as many candidates however many users there are.
BLOCK_USERS = 94
#: The number of blocks in SQL.
BLOCKS_SQL = f"(SELECT greatest(1, ceil(count(DISTINCT user_id) / {BLOCK_USERS}.0))::BIGINT FROM events)"


def micros(c: Column) -> Column:
    """Microseconds since the epoch; the tables' timestamps carry no zone and are read as UTC."""
    return F.unix_micros(c.cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with two clocks: ingestion is 0 to 6 seconds after the event."""
    return observed(table(spark, sf_dir, "events"))


def observed(e: DataFrame, *keep: str) -> DataFrame:
    """The observations of rows of events; ``keep``: columns that go along."""
    code = F.lit(0)
    for k, kind in enumerate(("click", "error", "purchase", "signup", "view"), 1):
        code = F.when(F.col("event_type") == kind, F.lit(k)).otherwise(code)
    return e.select(
        F.col("event_id").alias("observation_id"),
        F.lit(1).cast("long").alias("source_id"),
        code.cast("long").alias("modality"),
        micros(F.col("ts")).alias("event_time"),
        (micros(F.col("ts")) + (F.col("event_id") % 7) * 1_000_000).alias("ingestion_time"),
        F.col("props").alias("payload"),
        F.sha2("props", 256).alias("content_hash"),
        F.when(F.col("event_id") % 10 == 9, F.col("event_id") - 9).alias("supersedes"),
        (F.floor(F.col("event_id") / 1000) + 1).alias("version"),
        "user_id",
        "event_type",
        "value",
        *keep,
    )


def blocks(spark: SparkSession, sf_dir: str) -> int:
    """Blocks that the users are split into."""
    users = table(spark, sf_dir, "events").agg(F.count_distinct("user_id")).first()[0]
    return max(1, -(-users // BLOCK_USERS))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("identity_id")).agg(F.min(micros(F.col("ts"))).alias("created_at"), F.max(micros(F.col("ts"))).alias("last_activation"), F.count(F.lit(1)).alias("n"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of decisions: each customer is an observation, each order a newer decision on it."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    version = F.row_number().over(w).cast("long")
    return o.select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("observation_id"), version.alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transaction, depends_on): each order depends on the customer's order before."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_orderkey").alias("txn"), F.lag("o_orderkey").over(w).alias("depends_on"), F.col("o_custkey").alias("customer"))


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = lambda k: [((F.col(k) * 37 % 180) - 90).cast("double").alias("lat"), ((F.col(k) * 91 % 360) - 180).cast("double").alias("lon")]
    c = table(spark, sf_dir, "customer").select("c_custkey", *at("c_custkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", *at("s_suppkey"))
    return c, s
