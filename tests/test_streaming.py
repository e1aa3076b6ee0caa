import pytest

from orrery.operators.ledger import Ledger
from orrery.operators.runtime import Runtime
from orrery.plans import adapters
from orrery.sources.kv import FolderBackend, MemoryBackend
from orrery.sources.snapshot import Published
from orrery.streaming import resolve
from orrery.streaming.ingress import Full, Ingress, limited


def test_ingress(spark):
    with pytest.raises(ValueError):
        Ingress(0)
    q = Ingress(2)
    q.offer((1,))
    q.offer((2,))
    with pytest.raises(Full):
        q.offer((3,))
    assert len(q) == 2 and q.batch(spark, "x long").count() == 2 and q.take() is None


def test_snapshots(spark, tmp_path):
    p = Published(MemoryBackend(), str(tmp_path))
    assert p.load(spark, "t") is None
    p.publish("t", spark.range(3))
    old = p.load(spark, "t")
    assert p.publish("t", spark.range(5)) == 2
    assert (old.count(), p.load(spark, "t").count(), p.load(spark, "t", 1).count()) == (3, 5, 3)


def test_stop_and_restart_gives_the_same_ledger(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    o = adapters.observations(spark, sf).select("observation_id", "ingestion_time", "content_hash", F.lit(None).cast("long").alias("supersedes"), "user_id", "value")
    users = adapters.identities(spark, sf).select("identity_id")

    def run(root, stops):
        for k, n in enumerate(stops):
            o.where((F.col("observation_id") % 4 >= (stops[k - 1] if k else 0)) & (F.col("observation_id") % 4 < n)).repartition(1).write.mode("append").parquet(f"{root}/in")
            runtime = Runtime(Ledger(FolderBackend(spark, f"{root}/ledger")), f"{root}/tables", [resolve.ValueProvider(users, adapters.blocks(spark, sf))])
            resolve.resolve_stream(limited(spark, f"{root}/in", 1), runtime, "e", f"{root}/state").awaitTermination()
        return runtime.ledger

    def rows(ledger):
        return sorted((r["observation_id"], r["action"], r["identity_id"]) for r in ledger.table(spark, "decisions").collect())

    once, twice = run(str(tmp_path / "a"), (4,)), run(str(tmp_path / "b"), (2, 4))
    assert rows(once) == rows(twice) and len(rows(once)) == o.count()
    assert (once.version, twice.version) == (2, 4)


def test_links_to_missing_observations_are_rejected(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 60 AND event_id <> 20")
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["observation_id"] for r in resolve.resolved_from_stream(spark, str(tmp_path)).collect()}
    assert got == {r["event_id"] for r in e.where(F.col("event_id") != 29).collect()}


def test_quiet_identities_leave_the_state(spark, tmp_path):
    from orrery.streaming.eviction import active_identities

    def put(rows):
        spark.createDataFrame(rows, "identity_id long, t string").selectExpr("identity_id", "cast(t as timestamp) activation").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00")])
    seen = []

    def run():
        q = active_identities(limited(spark, str(tmp_path / "in"), 1), "1 hour", "1 minute").writeStream.outputMode("update")
        q.foreachBatch(lambda b, _: seen.extend(map(tuple, b.select("identity_id", "event", "n").collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(seen) == [(1, "active", 2), (2, "active", 1)]
    seen.clear()
    put([(2, "2024-01-01 02:00:00")])  # state survives the restart; time moves on
    run()
    put([(3, "2024-01-01 02:00:30")])
    run()
    assert (2, "active", 2) in seen and (1, "evicted", 2) in seen and (2, "evicted", 2) not in seen


def test_discard(spark):
    import os

    from orrery.session import discard, scratch, written

    assert written(spark.range(3), "x").count() == 3
    path = scratch(spark).removeprefix("file:")
    assert os.path.isdir(path)
    discard(spark)
    assert not os.path.exists(path)
