import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, hostgraph, outbox, workspace
from orrery.operators.ledger import Envelope, Ledger, LedgerError, new_observations
from orrery.operators.runtime import BatchError, Runtime
from orrery.sources.kv import FolderBackend, KeyExists, MemoryBackend, version_key


class Book:
    """Numbers envelopes for a ledger."""

    def __init__(self, ledger=None):
        self.ledger, self.n = ledger or Ledger(), 0

    def __call__(self, *commands, depends=(), txn=None):
        self.n += 1
        txn = txn or self.n
        return self.ledger.commit(Envelope(txn, self.ledger.version, f"{txn:032x}", txn, tuple(commands), tuple(depends)))


def seen(i, **more):
    return {"kind": "PersistObservation", "id": i, **more}


def resolution(n, observation, action="noise", target=None, created=None):
    return {"kind": "CommitResolution", "inference": {"id": n, "observation": observation, "providers": [{"id": 1, "schema": 1, "version": 1, "calibration": 1}], "solver_version": 1}, "decision": {"id": n, "inference": n, "action": action, "target": target, "policy_version": 1, "loss_version": 1}, "created_identity": created}


def life(kind, i, **more):
    return {"kind": kind, "identity": i, **more}


def fails(code, f, *a, **k):
    with pytest.raises(LedgerError) as e:
        f(*a, **k)
    assert e.value.code == code


def test_envelope_order_of_errors():
    b = Book()
    b(seen(1))
    l = b.ledger
    e = Envelope(1, 0, f"{1:032x}", 1, (seen(1),))
    assert l.commit(e).replayed and l.version == 1
    fails("IdempotencyCollision", l.commit, Envelope(1, 0, f"{1:032x}", 2, (seen(1),)))
    fails("VersionConflict", l.commit, Envelope(2, 0, f"{2:032x}", 1, (seen(2),)))
    fails("DuplicateTransaction", l.commit, Envelope(1, 1, f"{2:032x}", 1, (seen(2),)))
    fails("MissingDependency", l.commit, Envelope(2, 1, f"{2:032x}", 1, (seen(2),), (9,)))
    fails("ImmutableObservation", b, seen(1))
    fails("MissingObservation", b, seen(5, supersedes=77))
    assert b(seen(5), seen(6, supersedes=5), txn=50).version == 2
    with pytest.raises(ValueError):
        Envelope(9, 0, "0" * 32, 1, (seen(1),))
    with pytest.raises(ValueError):
        Envelope(9, 0, f"{9:032x}", 1, ())


def test_resolutions_and_as_of():
    b = Book()
    b(seen(1))
    b(resolution(10, 1, "new", created=5))
    b(resolution(11, 1, "assign", target=5))
    assert b.ledger.current_decision(1)["id"] == 11
    assert b.ledger.decision_as_of(1, 2)["id"] == 10 and b.ledger.decision_as_of(1, 3)["id"] == 11
    assert sum(d["end"] is None for d in b.ledger.state.decisions.values()) == 1
    fails("MissingObservation", b, resolution(12, 9))
    fails("DuplicateRecord", b, resolution(11, 1))
    fails("DuplicateRecord", b, resolution(20, 1), resolution(21, 1))
    fails("DuplicateIdentity", b, resolution(13, 1, "new", created=5))
    fails("InvalidCreation", b, resolution(13, 1, "new"))
    fails("MissingIdentity", b, resolution(13, 1, "assign", target=99))
    for record, name, value in (("inference", "providers", []), ("inference", "solver_version", 0), ("decision", "policy_version", None), ("decision", "loss_version", 0)):
        bare = resolution(13, 1)
        bare[record][name] = value
        fails("IncompleteProvenance", b, bare)
    for name in ("id", "schema", "version", "calibration"):
        bare = resolution(13, 1)
        bare["inference"]["providers"][0][name] = 0
        fails("IncompleteProvenance", b, bare)
    b(life("Retire", 5), txn=90)
    fails("InvalidAssignment", b, resolution(13, 1, "assign", target=5))


def test_merge_split_revert():
    b = Book()
    b(life("CreateIdentity", 9), life("CreateIdentity", 3), seen(1), seen(2))
    b({"kind": "Merge", "decision": 10, "left": 9, "right": 3})
    assert b.ledger.canonical(9) == 3 and b.ledger.state.statuses == {9: "Merged", 3: "Active"}
    fails("InvalidMerge", b, {"kind": "Merge", "decision": 10, "left": 9, "right": 3})
    fails("InvalidMerge", b, {"kind": "Merge", "decision": 12, "left": 9, "right": 9})
    b({"kind": "Split", "merges": [10], "partitions": [{"identities": [9], "observations": [1]}, {"identities": [3], "observations": [2]}]}, txn=60)
    assert b.ledger.canonical(9) == 9 and b.ledger.state.statuses == {9: "Active", 3: "Active"}
    part = lambda i, *o: {"identities": [i], "observations": list(o)}
    split = lambda *parts: {"kind": "Split", "merges": [10], "partitions": list(parts)}
    fails("InvalidSplit", b, split(part(9, 1), part(3, 2)))  # that merge is closed by now
    fails("IncompleteSplit", b, split(part(9, 1)))
    fails("IncompleteSplit", b, split(part(9, 1), part(3)))
    fails("OverlappingSplit", b, split(part(9, 1), part(9, 2)))
    fails("OverlappingSplit", b, split(part(9, 1), part(3, 1)))
    b({"kind": "Merge", "decision": 11, "left": 3, "right": 9}, txn=70)
    b({"kind": "Revert", "target": 70, "mode": "Strict"}, txn=71)
    # the class splits, the status stays
    assert b.ledger.canonical(9) == 9 and b.ledger.state.statuses[9] == "Merged"


def test_merge_chain_has_the_smallest_name():
    b = Book()
    b(*[life("CreateIdentity", i) for i in range(1, 129)])
    for i in range(128, 1, -1):
        b({"kind": "Merge", "decision": 1000 + i, "left": i, "right": i - 1})
    assert {b.ledger.canonical(i) for i in range(1, 129)} == {1}


def test_reverts():
    b = Book()
    b(seen(1))
    b(resolution(10, 1), txn=2)
    b(seen(2), depends=(2,), txn=3)
    fails("DependentActive", b, {"kind": "Revert", "target": 2, "mode": "Strict"}, txn=9)
    b({"kind": "Revert", "target": 2, "mode": "Compensating"}, txn=4)
    assert b.ledger.current_decision(1)["id"] == 10
    b({"kind": "Revert", "target": 2, "mode": "Cascade"}, txn=5)
    assert b.ledger.current_decision(1) is None and not b.ledger.state.transactions[3]["active"]
    assert b.ledger.dependency_closure(2) == [2, 3] and b.ledger.dependency_closure(77) == [77]
    fails("InactiveTransaction", b, {"kind": "Revert", "target": 2, "mode": "Strict"}, txn=9)
    fails("MissingDependency", b, seen(9), depends=(3,), txn=9)


def test_outbox():
    b = Book()
    b(seen(1), resolution(10, 1))
    b({"kind": "EnqueueMaterialization", "id": 4, "decision": 10})
    fails("MissingMaterialization", b, {"kind": "Materialized", "id": 4, "decision": 11}, txn=90)
    b({"kind": "Materialized", "id": 4, "decision": 10}, txn=91)
    fails("MissingMaterialization", b, {"kind": "Materialized", "id": 4, "decision": 10}, txn=92)
    fails("MissingDecision", b, {"kind": "EnqueueMaterialization", "id": 5, "decision": 99}, txn=92)
    fails("MissingMaterialization", b, {"kind": "EnqueueMaterialization", "id": 6, "decision": 10}, {"kind": "Materialized", "id": 6, "decision": 10}, txn=93)


@pytest.mark.parametrize("kind, allowed", [("Promote", {"Active", "Dormant"}), ("Dormant", {"Active"}), ("Reactivate", {"Dormant"}), ("Retire", {"Active", "Dormant"})])
def test_lifecycle(kind, allowed):
    for status in ("Active", "Dormant", "Resolved", "Merged", "Retired"):
        b = Book()
        b(life("CreateIdentity", 1))
        b.ledger.state.statuses[1] = status
        if status in allowed:
            b(life(kind, 1, target="x"))
        else:
            fails("InvalidLifecycle", b, life(kind, 1, target="x"))
    fails("MissingIdentity", Book(), life(kind, 5, target="x"))


def test_random_commands_replay_to_the_same_state():
    rng, b = random.Random(8), Book()
    for n in range(300):
        i, j = rng.randrange(12), rng.randrange(12)
        c = rng.choice([life("CreateIdentity", i), life("Dormant", i), life("Reactivate", i), life("Retire", i), {"kind": "Merge", "decision": 1000 + n, "left": i, "right": j}, seen(i), resolution(n, i), {"kind": "Revert", "target": rng.randrange(1, n + 2), "mode": rng.choice(["Strict", "Cascade", "Compensating"])}])
        try:
            b(c, depends=[t for t in (rng.randrange(1, n + 2),) if rng.random() < 0.3], txn=n + 1)
        except LedgerError:
            pass
    again = Ledger(b.ledger.backend)
    assert again.state == b.ledger.state and again.version > 20
    # no class holds a merge that is closed
    for m in again.state.merges.values():
        if m["end"] is None:
            assert again.canonical(m["left"]) == again.canonical(m["right"])


def test_failed_write_publishes_nothing():
    class Broken(MemoryBackend):
        def apply(self, *a, **k):
            raise OSError

    b = Book(Ledger(Broken()))
    with pytest.raises(OSError):
        b(seen(1))
    assert b.ledger.version == 0 and not b.ledger.state.observations


@pytest.mark.parametrize("kind", ["memory", "folder"])
def test_backends(spark, tmp_path, kind):
    k = MemoryBackend() if kind == "memory" else FolderBackend(spark, str(tmp_path / "kv"))
    k.apply({"commits/a": b"1", "commits/b": b"2", "other": b"3"})
    assert k.get("commits/a") == b"1" and k.get("none") is None
    assert k.scan("commits/") == [("commits/a", b"1"), ("commits/b", b"2")]
    with pytest.raises(KeyExists):
        k.apply({"commits/a": b"9"}, exclusive=True)
    k.apply({}, ("commits/a",))
    assert k.get("commits/a") is None


def test_durable_ledger(spark, tmp_path):
    root = str(tmp_path / "ledger")
    b = Book(Ledger(FolderBackend(spark, root)))
    b(seen(1))
    b(life("CreateIdentity", 3))
    again = Ledger(FolderBackend(spark, root))
    assert again.state == b.ledger.state
    again.commit(Envelope(70, 2, f"{70:032x}", 1, (seen(7),)))
    fails("VersionConflict", b, seen(8))  # the other writer was first
    FolderBackend(spark, root).apply({}, (version_key(2),))
    fails("VersionGap", Ledger, FolderBackend(spark, root))


@pytest.mark.parametrize("edges_of_a_task", [1_000_000, 0])
def test_graph(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(graph, "TASK_EDGES", edges_of_a_task)
    e = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7), (2000, 2000), (None, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert {got[k] for k in range(301)} == {0} and got[1001] == 1000 and got[2000] == 2000 and len(got) == 304
    assert graph.connected_components(e.limit(0)).count() == 0
    reached = lambda edges, *roots: sorted(r["node"] for r in graph.closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(r,) for r in roots], "node long")).collect())
    assert reached([(k, k + 1) for k in range(300)] + [(901, 900), (900, 901), (None, 7)], 250) == list(range(250, 301))
    assert reached([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], 1) == [1, 2, 3, 4]
    assert reached([(1, 3), (2, 3), (3, 4)], 1) == [1, 3, 4]  # two parents, one of them reached
    rng = random.Random(3)
    for _ in range(3):
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(9)] + [(109, 3)]
        want, roots = {5, 103, 777}, (5, 103, 777)
        while more := {b for a, b in edges if a in want} - want:
            want |= more
        assert reached(edges, *roots) == sorted(want)


@pytest.mark.parametrize("edges_of_a_task", [1_000_000, 0])
def test_closure_of_a_long_chain(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(graph, "TASK_EDGES", edges_of_a_task)
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.closure(chain, spark.createDataFrame([(1,)], "node long")).count() == 100_000


def test_chains_of_components_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    e = spark.range(5_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.connected_components(e).select("component").distinct().count() == 1


def test_workspace(spark):
    a = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 8, 6), (1, 2, 9, 7), (2, 1, 12, 8)], "identity_id long, version long, activation long, decision_id long")
    w = workspace.apply_committed(a, 1)
    r = {x["identity_id"]: x for x in w.collect()}
    assert (r[1]["version"], r[1]["last_activation"], r[1]["history"]) == (2, 10, [2])
    late = spark.createDataFrame([(1, 2, 99, 1), (1, 3, 5, 2)], "identity_id long, version long, activation long, decision_id long")
    assert workspace.stale(late, w).count() == 1
    r = {x["identity_id"]: x for x in workspace.apply_committed(late, 1, w).collect()}
    assert (r[1]["version"], r[1]["last_activation"], r[1]["history"]) == (3, 10, [3]) and r[2]["version"] == 1
    kept, gone = workspace.evict_before(w, 11)
    assert [x["identity_id"] for x in gone.collect()] == [1] and kept.count() == 1
    h = spark.createDataFrame([(1, k) for k in range(1, 4)], "identity_id long, version long")
    assert workspace.bounded_history(h, 2).first()["history"] == [2, 3]
    assert workspace.bounded_history(h, 0).first()["history"] == []
    assert [r["version"] for r in workspace.evicted_history(h, 2).collect()] == [1] and workspace.evicted_history(h, 0).count() == 3
    s = spark.createDataFrame([(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b")], "identity_id long, provider_id long, schema_id long, version long, data string")
    assert workspace.upsert_summaries(s, s).collect()[0]["data"] == "b"


def test_host_graph(spark):
    nodes = spark.createDataFrame([(1, "Event"), (2, "Physical")], "node long, kind string")
    r = spark.createDataFrame([(1, 9, "Occur", 1, 2), (2, 9, "Occur", 1, 2), (3, 9, "Occur", 1, 5), (4, 8, "Occur", 7, 8), (5, 8, "Occur", 1, 8)], "seq long, materialization_id long, role string, source long, target long")
    got = [x["outcome"] for x in hostgraph.materialize(r, nodes).orderBy("seq").collect()]
    assert got == ["Inserted", "Replayed", "Collision", "MissingSource", "MissingTarget"]
    every, twice = hostgraph.add_nodes(nodes, spark.createDataFrame([(1, "Event"), (3, "Event")], "node long, kind string"))
    assert every.count() == 3 and twice.count() == 1
    assert hostgraph.roles(spark).count() == 6
    ok = {x[1]: f"native:{x[0]}" for x in hostgraph.ROLES}
    assert hostgraph.profile_error(ok) is None and hostgraph.profile_error(ok | {"Occur": "native:1"}) == "DuplicatePredicate"
    box = spark.createDataFrame([(1, 10), (2, 11)], "materialization_id long, decision_id long")
    assert [x["error"] for x in outbox.receipt_errors(spark.createDataFrame([(1, 99), (5, 1)], "materialization_id long, decision_id long"), box).orderBy("materialization_id").collect()] == ["DecisionMismatch", "MissingMaterialization"]


class Nearest:
    """Gates by a key and prefers the candidate over the rest."""

    provider_id, model_version = 1, 1

    def generate_candidates(self, observations):
        return observations.select("observation_id", F.when(F.col("observation_id") != 3, F.lit(100)).cast("long").alias("identity_id"))

    def emit_factors(self, observations, candidates):
        n = candidates.groupBy("observation_id").agg(F.count("identity_id").cast("int").alias("n"))
        table = F.when(F.col("n") == 1, F.array(F.lit(3.0), F.lit(0.0), F.lit(-4.0))).otherwise(F.array(F.lit(0.0), F.lit(-4.0)))
        return n.select(F.lit(1).cast("long").alias("batch_id"), F.col("observation_id").alias("factor_id"), F.array("observation_id").alias("variables"), F.array(F.col("n") + 2).alias("cardinalities"), table.alias("log_potentials"))


def evidence(spark, rows):
    return spark.createDataFrame(rows, "observation_id long, ingestion_time long, content_hash string, supersedes long")


def test_runtime(spark, tmp_path):
    broken = [True]

    def deliver(rows):
        return rows.where(F.lit(not broken[0]))

    plan = lambda d: d.where("action = 'assign'").select(F.col("decision_id").alias("materialization_id"), "decision_id")
    run = Runtime(Ledger(), str(tmp_path), [Nearest()], plan=plan, deliver=deliver)
    batch = evidence(spark, [(1, 10, "a", None), (2, 20, "b", 1), (3, 30, "c", None)])
    r = run.process(batch, "one")
    assert (r.evidence_version, r.resolution_version, r.final_version) == (1, 2, 2)
    assert {x["observation_id"]: x["action"] for x in r.decisions.collect()} == {1: "assign", 2: "assign", 3: "new"}
    assert r.pending.count() == 2  # the host was down; decisions are durable
    w = run.current.first()  # both observations of one identity are one commit
    assert (w["identity_id"], w["version"], w["last_activation"], w["commits"]) == (100, 2, 20, 1)
    broken[0] = False
    assert run.retry("one", 30).count() == 0 and run.ledger.version == 3
    assert run.retry("one", 30).count() == 0 and run.ledger.version == 3
    again = evidence(spark, [(1, 10, "a", None), (2, 10, "z", None), (4, 40, "d", 99), (5, 50, "e", 4)])
    good, bad = new_observations(again, run.ledger.table(spark, "observations"))
    assert {x["observation_id"]: x["error"] for x in bad.collect()} == {2: "ImmutableObservation", 4: "MissingObservation"}
    assert [x["observation_id"] for x in good.collect()] == [5]
    with pytest.raises(BatchError):
        Runtime(Ledger(), str(tmp_path), []).process(batch, "none")
    with pytest.raises(BatchError):
        run.process(batch.limit(0), "empty")


def test_providers_agree_with_message_passing(spark, tmp_path):
    class Paired(Nearest):
        def emit_factors(self, observations, candidates):
            one = super().emit_factors(observations, candidates)
            two = spark.createDataFrame([(1, 900, [1, 2], [3, 3], [0.0] * 9)], one.schema)
            return one.unionByName(two)

    batch = evidence(spark, [(1, 10, "a", None), (2, 20, "b", None), (3, 30, "c", None)])
    plain = Runtime(Ledger(), str(tmp_path / "a"), [Nearest()]).process(batch, "x").decisions
    paired = Runtime(Ledger(), str(tmp_path / "b"), [Paired()]).process(batch, "x").decisions
    key = lambda d: {r["observation_id"]: (r["action"], round(r["risk"], 9)) for r in d.collect()}
    assert key(plain) == key(paired)
