"""Failures between the steps of a batch, writers that race, reverts, restarts, and reads of history."""

import os

import pytest
from pyspark.sql import functions as F
from test_ledger import Book, Nearest, evidence, fails, life, resolution, seen

from orrery.operators import hostgraph
from orrery.operators.ledger import Ledger
from orrery.operators.runtime import BatchError, Runtime
from orrery.sources.kv import FolderBackend, KeyExists, MemoryBackend, StorageError, version_key
from orrery.sources.snapshot import Published

ROWS = [(1, 10, "a", None), (2, 20, "b", 1), (3, 30, "c", None)]
PLAN = lambda d: d.where("action = 'assign'").select(F.col("decision_id").alias("materialization_id"), "decision_id")


class Flaky(Nearest):
    def __init__(self):
        self.broken = True

    def emit_factors(self, observations, candidates):
        if self.broken:
            raise OSError("the model is away")
        return super().emit_factors(observations, candidates)


def actions(df):
    return {r["observation_id"]: r["action"] for r in df.collect()}


def test_a_batch_given_again_is_resolved(spark, tmp_path):
    provider = Flaky()
    run = Runtime(Ledger(FolderBackend(spark, f"{tmp_path}/ledger")), f"{tmp_path}/tables", [provider])
    batch = evidence(spark, ROWS)
    with pytest.raises(OSError):
        run.process(batch, "one")
    assert run.ledger.version == 1  # the evidence is there
    provider.broken = False
    # in a new process
    run = Runtime(Ledger(FolderBackend(spark, f"{tmp_path}/ledger")), f"{tmp_path}/tables", [provider])
    r = run.process(batch, "one")
    assert actions(r.decisions) == {1: "assign", 2: "assign", 3: "new"} and (r.evidence_version, r.resolution_version) == (1, 2)
    again = run.process(batch, "one")
    assert run.ledger.version == 2 and actions(again.decisions) == actions(r.decisions)
    fails("IdempotencyCollision", run.process, evidence(spark, [(1, 10, "other", None)]), "one")
    # another batch with some of the same evidence resolves only what is new
    assert actions(run.process(evidence(spark, [*ROWS[:2], (8, 50, "h", 2)]), "two").decisions) == {8: "assign"}


def test_a_losing_writer_touches_nothing(spark, tmp_path):
    one, two = (Ledger(FolderBackend(spark, f"{tmp_path}/ledger")) for _ in range(2))
    table = lambda k: {"t": spark.range(k, k + 3).toDF("x")}
    assert one.commit_tables(f"{tmp_path}/tables", table(0), 1, f"{1:032x}", 5).version == 1
    fails("VersionConflict", two.commit_tables, f"{tmp_path}/tables", table(100), 1, f"{2:032x}", 5)
    for l in (one, Ledger(FolderBackend(spark, f"{tmp_path}/ledger"))):
        assert sorted(r["x"] for r in l.table(spark, "t").collect()) == [0, 1, 2]
    assert len(os.listdir(f"{tmp_path}/tables/t")) == 1
    # the same key: the same rows in any order are a repetition, others are a collision
    assert one.commit_tables(f"{tmp_path}/tables", {"t": spark.range(0, 3).toDF("x").orderBy(F.desc("x"))}, 1, f"{1:032x}", 5).replayed
    fails("IdempotencyCollision", one.commit_tables, f"{tmp_path}/tables", table(7), 9, f"{1:032x}", 5)
    fails("DuplicateTransaction", one.commit_tables, f"{tmp_path}/tables", table(7), 1, f"{9:032x}", 5)
    fails("MissingDependency", one.commit_tables, f"{tmp_path}/tables", table(7), 9, f"{9:032x}", 5, (77,))


def test_manifests_are_whole_or_not_there(spark, tmp_path):
    root = f"{tmp_path}/kv"
    b = Book(Ledger(FolderBackend(spark, root)))
    b(seen(1))
    # a writer that died before its file got its name
    with open(f"{root}/_aside/half", "w") as f:
        f.write('{"txn":')
    again = Ledger(FolderBackend(spark, root))
    assert again.state == b.ledger.state
    b(seen(2))
    with open(f"{root}/{version_key(2)}", "w"):
        pass  # damage from outside
    with pytest.raises(StorageError) as e:
        Ledger(FolderBackend(spark, root))
    assert e.value.kind == "corrupt"


@pytest.mark.parametrize("exclusive", [False, True])
def test_several_keys_are_one_change(spark, tmp_path, monkeypatch, exclusive):
    root = f"{tmp_path}/kv"
    k = FolderBackend(spark, root)
    k.apply({"old": b"0"})
    # the writer dies after its change took effect and before it wrote the rest
    monkeypatch.setattr(FolderBackend, "_finish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        k.apply({"a/x": b"1", "a/y": b"2"}, ("old",), exclusive=exclusive)
    monkeypatch.undo()
    other = FolderBackend(spark, root)
    assert (other.get("a/x"), other.get("a/y"), other.get("old")) == (b"1", b"2", None)
    with pytest.raises(KeyExists):
        other.apply({"b": b"1", "a/y": b"9"}, exclusive=True)
    assert other.get("b") is None and other.scan("a/") == [("a/x", b"1"), ("a/y", b"2")]


def test_a_claim_that_was_lost_has_no_effect(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/kv"
    k, whole = FolderBackend(spark, root), FolderBackend._put
    # the writer dies between its journal and the key that decides
    monkeypatch.setattr(FolderBackend, "_put", lambda self, key, *a: whole(self, key, *a) if key.startswith("_journal") else (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        k.apply({"a": b"1", "z": b"2"}, exclusive=True)
    monkeypatch.undo()
    other = FolderBackend(spark, root)
    assert other.get("a") is None and other.get("z") is None
    other.apply({"z": b"3"}, exclusive=True)
    assert other.get("a") is None and other.get("z") == b"3"


def test_reverts_keep_history(spark, tmp_path):
    run = Runtime(Ledger(), str(tmp_path), [Nearest()], plan=PLAN)
    run.process(evidence(spark, ROWS), "one")  # versions 1 and 2
    l = run.ledger
    assert l.current_decision(1)["action"] == "assign" and l.current_decision(1)["begin"] == 2 and l.current_decision(77) is None
    b = Book(l)
    b(seen(9), resolution(50, 9), txn=90)  # version 3
    assert l.current_decision(9)["id"] == 50 and l.decision_as_of(9, 2) is None
    evidence_txn, resolved_txn = sorted(t for t, r in l.state.transactions.items() if r.get("tables"))
    fails("DependentActive", b, {"kind": "Revert", "target": evidence_txn, "mode": "Strict"}, txn=91)
    b({"kind": "Revert", "target": evidence_txn, "mode": "Cascade"}, txn=91)  # version 4
    assert not l.state.transactions[resolved_txn]["active"]
    assert l.current_decision(1) is None
    assert l.decision_as_of(1, 3)["action"] == "assign" and l.decision_as_of(1, 4) is None and l.decision_as_of(1, 1) is None
    # evidence stays, and all versions can be read
    assert l.table(spark, "observations").count() == 3 and l.table(spark, "observations", 1).count() == 3
    assert l.table(spark, "decisions", 2).count() == 3 and l.table(spark, "decisions", live=True) is None
    assert l.table(spark, "decisions", 3, live=True).count() == 3
    assert run.retry("one", 1, spark).count() == 0  # nothing of what was reverted is delivered
    again = Ledger(l.backend)
    assert again.state == l.state and again.current_decision(1) is None


def test_newer_decisions_close_older_ones(spark, tmp_path):
    l = Ledger()
    d = lambda n, action: spark.createDataFrame([(n, 1, action, 5)], "decision_id long, observation_id long, action string, identity_id long")
    l.commit_tables(str(tmp_path), {"decisions": d(10, "assign")}, 1, f"{1:032x}", 1)
    l.commit_tables(str(tmp_path), {"decisions": d(11, "noise")}, 2, f"{2:032x}", 1)
    assert [l.decision_as_of(1, v) and l.decision_as_of(1, v)["id"] for v in (0, 1, 2, 9)] == [None, 10, 11, 11]
    assert l.decision_as_of(1, 1)["end"] == 2 and l.current_decision(1)["id"] == 11
    Book(l)({"kind": "Revert", "target": 2, "mode": "Strict"}, txn=70)
    assert l.current_decision(1) is None  # the one before does not come back
    assert [l.decision_as_of(1, v) and l.decision_as_of(1, v)["id"] for v in (1, 2, 3)] == [10, 11, None]


def test_reads_of_evidence(spark, tmp_path):
    l = Ledger()
    b = Book(l)
    b(seen(1, event_time=100, content_hash="x"), seen(2, event_time=300))
    rows = spark.createDataFrame([(7, 150, "h"), (8, 250, "i")], "observation_id long, event_time long, content_hash string")
    l.commit_tables(str(tmp_path), {"observations": rows}, 5, f"{5:032x}", 1)
    assert l.observation(1)["version"] == 1 and l.observation(7)["content_hash"] == "h" and l.observation(7)["version"] == 2
    assert l.observation(99) is None
    read = lambda t, v: [r["observation_id"] for r in l.observations_as_of(spark, t, v).collect()]
    assert read(260, 2) == [1, 7, 8] and read(260, 1) == [1] and read(200, 9) == [1, 7] and read(400, 9) == [1, 2, 7, 8]


def test_compaction_changes_no_read(spark, tmp_path):
    l = Ledger(FolderBackend(spark, f"{tmp_path}/ledger"))
    for k in range(1, 6):
        if k == 4:
            l.compact(spark, f"{tmp_path}/tables", "t", files=1)
        l.commit_tables(f"{tmp_path}/tables", {"t": spark.range(k * 10, k * 10 + 2).toDF("x")}, k, f"{k:032x}", 1)
    for ledger in (l, Ledger(FolderBackend(spark, f"{tmp_path}/ledger"))):
        read = lambda **k: sorted(r["x"] for r in ledger.table(spark, "t", **k).collect())  # noqa: B023, E731
        assert read() == [10, 11, 20, 21, 30, 31, 40, 41, 50, 51] and read(version=2) == [10, 11, 20, 21]
        assert read(version=4) == [10, 11, 20, 21, 30, 31, 40, 41] and read(only=2) == [20, 21] and read(only=5) == [50, 51]
        assert len(ledger.table(spark, "t").inputFiles()) < 10


def test_a_restarted_runtime_delivers_and_knows_its_workspace(spark, tmp_path):
    up = [False]
    deliver = lambda rows: rows.where(F.lit(up[0]))
    make = lambda: Runtime(Ledger(FolderBackend(spark, f"{tmp_path}/ledger")), f"{tmp_path}/tables", [Nearest()], plan=PLAN, deliver=deliver)
    first = make()
    first.process(evidence(spark, ROWS), "one")
    first.process(evidence(spark, [(8, 50, "h", None)]), "two")
    again = make()
    rows = lambda w: sorted(map(tuple, w.select("identity_id", "version", "last_activation", "commits", "history").collect()))
    assert rows(again.workspace(spark)) == rows(first.workspace(spark)) and len(rows(first.current)) == 2  # one known, one created
    up[0] = True
    assert again.retry("one", 30).count() == 0 and again.ledger.table(spark, "receipts").count() == 3
    assert make().retry("one", 30).count() == 0


def test_snapshots_race(spark, tmp_path):
    backend = MemoryBackend()
    a, b = Published(backend, str(tmp_path)), Published(backend, str(tmp_path))
    a.number = lambda name: 0  # both look before either has published
    b.number = lambda name: 0
    assert (a.publish("t", spark.range(3)), b.publish("t", spark.range(5))) == (1, 2)
    p = Published(backend, str(tmp_path))
    assert (p.number("t"), p.load(spark, "t", 1).count(), p.load(spark, "t").count(), p.load(spark, "t", 9)) == (2, 3, 5, None)


def test_a_batch_keeps_its_providers(spark, tmp_path):
    class Swaps(Nearest):
        def generate_candidates(self, observations):
            run.publish([Nearest()], 7, 3)  # in the middle of the batch
            return super().generate_candidates(observations)

    class Named(Swaps):
        provider_id, schema_id, model_version, calibration_id = 4, 5, 6, 7

        def contributions(self, observations, factors):
            return factors.select("factor_id", F.lit(1.5).alias("value"), F.lit("LogPotential").alias("semantics"))

    run = Runtime(Ledger(), str(tmp_path), [Named()])
    r = run.process(evidence(spark, ROWS), "one")
    p = run.ledger.table(spark, "provenance", only=r.resolution_version).collect()
    assert [(x["provider_id"], x["schema_id"], x["model_version"], x["calibration_id"], x["host_snapshot"]) for x in p] == [(4, 5, 6, 7, 0)]
    c = run.ledger.table(spark, "contributions").collect()
    assert sorted((x["observation_id"], x["value"], x["provider_id"]) for x in c) == [(k, 1.5, 4) for k in (1, 2, 3)]
    r = run.process(evidence(spark, [(9, 60, "k", None)]), "two")
    assert [x["host_snapshot"] for x in run.ledger.table(spark, "provenance", only=r.resolution_version).collect()] == [7]


def broken(change):
    """A provider whose factor tables break one rule."""

    class Broken(Nearest):
        def emit_factors(self, observations, candidates):
            t = super().emit_factors(observations, candidates)
            return t.select(*[F.expr(change.get(c, c)).alias(c) for c in t.columns])

    return Broken()


#: Changes of a factor table as SQL, and the rule that each breaks.
CHANGES = {
    "EmptyScope": {"variables": "cast(array() as array<long>)", "cardinalities": "cast(array() as array<int>)"},
    "DuplicateVariable": {"variables": "array(factor_id, factor_id)", "cardinalities": "array(1, 3)"},
    "InvalidCardinality": {"cardinalities": "array(0)"},
    "TableLength": {"log_potentials": "slice(log_potentials, 1, 1)"},
    "NonFinitePotential": {"log_potentials": "transform(log_potentials, v -> double('NaN'))"},
    "UnknownVariable": {"variables": "array(99L)"},
    "CardinalityMismatch": {"cardinalities": "array(size(log_potentials) + 1)", "log_potentials": "concat(log_potentials, array(0.0D))"},
}


@pytest.mark.parametrize("code", CHANGES)
def test_factor_tables_are_checked(spark, tmp_path, code):
    run = Runtime(Ledger(), str(tmp_path), [broken(CHANGES[code])])
    with pytest.raises(BatchError) as e:
        run.process(evidence(spark, ROWS), "one")
    assert e.value.code == code and run.ledger.version == 1  # evidence only


def test_providers_are_checked(spark, tmp_path):
    class Half(Nearest):
        def generate_candidates(self, observations):
            return super().generate_candidates(observations).where("observation_id > 1")

    class More(Nearest):
        def generate_candidates(self, observations):
            return super().generate_candidates(observations).unionByName(spark.createDataFrame([(77, 1)], "observation_id long, identity_id long"))

    class Nameless(Nearest):
        calibration_id = 0

    for provider, code in ((Half(), "IncompleteProvider"), (More(), "ObservationOutOfBounds"), (Nameless(), "IncompleteProvenance")):
        run = Runtime(Ledger(), str(tmp_path), [provider])
        with pytest.raises(BatchError) as e:
            run.process(evidence(spark, ROWS), "one")
        assert e.value.code == code and run.ledger.version == 1


def test_host_edges_of_earlier_batches(spark):
    nodes = spark.createDataFrame([(1, "Event"), (2, "Physical"), (3, "Physical")], "node long, kind string")
    schema = "seq long, materialization_id long, role string, source long, target long, decision_id long, version long"
    one = hostgraph.materialize(spark.createDataFrame([(1, 9, "Occur", 1, 2, 5, 1)], schema), nodes)
    edges = hostgraph.inserted(one)
    rows = [(0, 9, "Occur", 1, 2, 5, 1), (1, 9, "Occur", 1, 3, 5, 1), (2, 9, "Occur", 1, 2, 6, 1), (3, 8, "Occur", 1, 2, 5, 2), (4, 9, "Occur", 7, 7, 5, 1)]
    two = hostgraph.materialize(spark.createDataFrame(rows, schema), nodes, edges).orderBy("seq")
    assert [r["outcome"] for r in two.collect()] == ["Replayed", "Collision", "Collision", "Inserted", "Collision"]
    assert sorted(r["materialization_id"] for r in hostgraph.inserted(two, edges).collect()) == [8, 9]


def test_commands_and_tables_share_versions(spark, tmp_path):
    l = Ledger()
    b = Book(l)
    b(life("CreateIdentity", 3))
    l.commit_tables(str(tmp_path), {"t": spark.range(2)}, 40, f"{40:032x}", 1)
    b(life("Dormant", 3), txn=50)
    assert l.version == 3 and Ledger(l.backend).state == l.state
