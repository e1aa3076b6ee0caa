"""The append-only ledger: envelopes of commands, bulk tables, replay, and views of any version.

Control commands (lifecycle, merges, splits, reverts, receipts) come in small ordered envelopes; they are
validated one after the other against what is known, in the driver, and a manifest is written before
anything takes effect.  Mass data (observations, decisions) comes as whole tables; its checks are joins,
its rows stay in Parquet under the version that a manifest publishes.  What the driver holds is the
control state: a few hundred bytes for each identity or decision that control commands name, none for a
row of mass data.

Every attempt to commit tables writes folders of its own, which only the manifest names: a writer that
loses its version touches nothing of the winner's.  Nothing that was committed is ever rewritten; a revert is one
more version, at which the decisions of what it reverts end.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import versions
from orrery.session import written
from orrery.sources.kv import Backend, KeyExists, MemoryBackend, document, key_version, version_key

ACTIVE, DORMANT, RESOLVED, MERGED, RETIRED = "Active", "Dormant", "Resolved", "Merged", "Retired"
LAST_VERSION = 2**63 - 1


class LedgerError(Exception):
    """A rejected envelope; ``code`` names the rule."""

    def __init__(self, code: str, at: int | None = None):
        super().__init__(code if at is None else f"{code} (command {at})")
        self.code, self.at = code, at


@dataclass(frozen=True)
class Envelope:
    """An atomic batch of commands.  ``key``: 32 hexadecimal digits, not all zero."""

    txn: int
    expected: int
    key: str
    issued_at: int
    commands: tuple[dict, ...]
    depends_on: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not self.commands:
            raise ValueError("EmptyEnvelope")
        if len(self.key) != 32 or int(self.key, 16) == 0:
            raise ValueError("ReservedKey")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Commit:
    version: int
    replayed: bool


@dataclass(frozen=True)
class Staged:
    """Rows of a table that are written already, for the version that comes next."""

    rows: DataFrame
    path: str
    version: int


@dataclass
class Classes:
    """Merge classes: a forest with the smallest member of each tree."""

    parent: dict[int, int] = field(default_factory=dict)

    def find(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> tuple[int, int]:
        """(kept root, lost root); equal if they were one class."""
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a
        return a, b


@dataclass
class State:
    version: int = 0
    observations: dict[int, dict] = field(default_factory=dict)
    inferences: dict[int, int] = field(default_factory=dict)
    decisions: dict[int, dict] = field(default_factory=dict)
    current: dict[int, int] = field(default_factory=dict)
    statuses: dict[int, str] = field(default_factory=dict)
    targets: dict[int, object] = field(default_factory=dict)
    merges: dict[int, dict] = field(default_factory=dict)
    classes: Classes = field(default_factory=Classes)
    outbox: dict[int, dict] = field(default_factory=dict)
    receipts: list[dict] = field(default_factory=list)
    transactions: dict[int, dict] = field(default_factory=dict)
    dependents: dict[int, list[int]] = field(default_factory=dict)
    keys: dict[str, tuple[str, int]] = field(default_factory=dict)

    # ------------------------------------------------------------ checks

    def replay_of(self, e: Envelope) -> int | None:
        if e.key not in self.keys:
            return None
        digest, version = self.keys[e.key]
        if digest != e.digest():
            raise LedgerError("IdempotencyCollision")
        return version

    def validate(self, e: Envelope) -> None:
        if e.expected != self.version:
            raise LedgerError("VersionConflict")
        if e.txn in self.transactions:
            raise LedgerError("DuplicateTransaction")
        if self.version >= LAST_VERSION:
            raise LedgerError("VersionExhausted")
        if any(not self.transactions.get(d, {}).get("active") for d in e.depends_on):
            raise LedgerError("MissingDependency")
        seen = _Pending(self)
        for k, c in enumerate(e.commands):
            check = getattr(seen, f"check_{c['kind']}", None)
            if check is None:
                raise LedgerError("UnknownCommand", k)
            code = check(c)
            if code:
                raise LedgerError(code, k)

    def closure(self, txn: int) -> list[int]:
        """The transaction and all that depend on it, active or not, ascending."""
        seen, todo = {txn}, [txn]
        while todo:
            todo = [d for t in todo for d in self.dependents.get(t, ()) if d not in seen and not seen.add(d)]
        return sorted(seen)

    # ------------------------------------------------------------ effects

    def apply(self, e: Envelope) -> int:
        v = self.version + 1
        self._open(e.txn, v, e.issued_at)
        for c in e.commands:
            getattr(self, f"_{c['kind']}")(c, v, e.txn)
        for d in e.depends_on:
            self.dependents.setdefault(d, []).append(e.txn)
        self.keys[e.key] = (e.digest(), v)
        self.version = v
        return v

    def publish(self, doc: dict) -> int:
        """The effect of a manifest that names tables."""
        self._open(doc["txn"], doc["version"], doc["issued_at"])
        self.transactions[doc["txn"]]["tables"] = doc["tables"]
        for d in doc["depends_on"]:
            self.dependents.setdefault(d, []).append(doc["txn"])
        self.keys[doc["key"]] = (doc["digest"], doc["version"])
        self.version = doc["version"]
        return self.version

    def _open(self, txn: int, v: int, issued_at: int) -> None:
        self.transactions[txn] = {"version": v, "active": True, "ended": None, "decisions": [], "merges": [], "outbox": [], "issued_at": issued_at}

    def _PersistObservation(self, c: dict, v: int, txn: int) -> None:
        self.observations[c["id"]] = {"version": v, "event_time": c.get("event_time"), "content_hash": c.get("content_hash"), "supersedes": c.get("supersedes")}

    def _CommitResolution(self, c: dict, v: int, txn: int) -> None:
        i, d = c["inference"], c["decision"]
        old = self.current.get(i["observation"])
        if old is not None and self.decisions[old]["end"] is None:
            self.decisions[old]["end"] = v
        self.inferences[i["id"]] = i["observation"]
        self.decisions[d["id"]] = {"observation": i["observation"], "inference": i["id"], "action": d["action"], "target": d.get("target"), "begin": v, "end": None}
        self.current[i["observation"]] = d["id"]
        if d["action"] == "new":
            self._CreateIdentity({"identity": c["created_identity"]}, v, txn)
        self.transactions[txn]["decisions"].append(d["id"])

    def _CreateIdentity(self, c: dict, v: int, txn: int) -> None:
        self.statuses[c["identity"]] = ACTIVE
        self.classes.find(c["identity"])

    def _Promote(self, c: dict, v: int, txn: int) -> None:
        self.statuses[c["identity"]] = RESOLVED
        self.targets[c["identity"]] = c["target"]

    def _Merge(self, c: dict, v: int, txn: int) -> None:
        self.merges[c["decision"]] = {"left": c["left"], "right": c["right"], "begin": v, "end": None}
        kept, lost = self.classes.union(c["left"], c["right"])
        if kept != lost:
            self.statuses[lost] = MERGED
            if self.statuses.get(kept) == MERGED:
                self.statuses[kept] = ACTIVE
        self.transactions[txn]["merges"].append(c["decision"])

    def _Split(self, c: dict, v: int, txn: int) -> None:
        for m in c["merges"]:
            self.merges[m]["end"] = v
        for p in c["partitions"]:
            for i in p["identities"]:
                self.statuses[i] = ACTIVE
        self._rebuild()

    def _Dormant(self, c: dict, v: int, txn: int) -> None:
        self.statuses[c["identity"]] = DORMANT

    def _Reactivate(self, c: dict, v: int, txn: int) -> None:
        self.statuses[c["identity"]] = ACTIVE

    def _Retire(self, c: dict, v: int, txn: int) -> None:
        self.statuses[c["identity"]] = RETIRED

    def _Revert(self, c: dict, v: int, txn: int) -> None:
        """What a reverted transaction decided ends here, never later than it had ended already.

        The decision before is not restored; observations, created identities and lifecycle moves stay.
        """
        if c["mode"] == "Compensating":
            return
        for t in self.closure(c["target"]) if c["mode"] == "Cascade" else [c["target"]]:
            record = self.transactions[t]
            if not record["active"]:
                continue
            record["active"], record["ended"] = False, v
            for d in record["decisions"]:
                row = self.decisions[d]
                row["end"] = v if row["end"] is None else min(row["end"], v)
                if self.current.get(row["observation"]) == d:
                    del self.current[row["observation"]]
            for m in record["merges"]:
                self.merges[m]["end"] = v if self.merges[m]["end"] is None else min(self.merges[m]["end"], v)
            for m in record["outbox"]:
                self.outbox.pop(m, None)
        self._rebuild()

    def _EnqueueMaterialization(self, c: dict, v: int, txn: int) -> None:
        self.outbox[c["id"]] = {"decision": c["decision"], "done": False, "relation": c.get("relation")}
        self.transactions[txn]["outbox"].append(c["id"])

    def _Materialized(self, c: dict, v: int, txn: int) -> None:
        self.outbox[c["id"]]["done"] = True
        self.receipts.append({"id": c["id"], "decision": c["decision"], "version": v})

    def _rebuild(self) -> None:
        """Classes of the merges that are open; a member that is not the smallest is merged."""
        nodes = list(self.classes.parent)
        self.classes = Classes({n: n for n in nodes})
        for m in self.merges.values():
            if m["end"] is None:
                self.classes.union(m["left"], m["right"])
        for n in nodes:
            if self.classes.find(n) != n:
                self.statuses[n] = MERGED


class _Pending:
    """The state as the earlier commands of an envelope leave it, for checks only."""

    def __init__(self, base: State):
        self.base = base
        self.observations: set[int] = set()
        self.inferences: set[int] = set()
        self.decisions: set[int] = set()
        self.resolved: set[int] = set()
        self.merges: set[int] = set()
        self.outbox: set[int] = set()
        self.statuses: dict[int, str] = {}

    def status(self, i: int) -> str | None:
        return self.statuses.get(i, self.base.statuses.get(i))

    def _decided(self, d: int) -> bool:
        return d in self.decisions or d in self.base.decisions

    def check_PersistObservation(self, c: dict) -> str | None:
        if c["id"] in self.base.observations or c["id"] in self.observations:
            return "ImmutableObservation"
        old = c.get("supersedes")
        if old is not None and old not in self.base.observations and old not in self.observations:
            return "MissingObservation"
        self.observations.add(c["id"])
        return None

    def check_CommitResolution(self, c: dict) -> str | None:
        i, d, created = c["inference"], c["decision"], c.get("created_identity")
        seen = i["observation"]
        if seen not in self.base.observations and seen not in self.observations:
            return "MissingObservation"
        # one resolution for an observation in an envelope: two would be valid at the same versions
        if i["id"] in self.base.inferences or i["id"] in self.inferences or self._decided(d["id"]) or seen in self.resolved:
            return "DuplicateRecord"
        begins = (i.get("begin", self.base.version + 1), d.get("begin", self.base.version + 1))
        if d["inference"] != i["id"] or begins != (self.base.version + 1,) * 2 or i.get("end") is not None or d.get("end") is not None:
            return "InvalidLineage"
        providers = i.get("providers") or ()
        named = all(p.get(k) for p in providers for k in ("id", "schema", "version", "calibration"))
        if not providers or not named or not all((i.get("solver_version"), d.get("policy_version"), d.get("loss_version"))):
            return "IncompleteProvenance"
        if (d["action"] == "new") != (created is not None):
            return "InvalidCreation"
        if created is not None:
            if self.status(created) is not None:
                return "DuplicateIdentity"
            self.statuses[created] = ACTIVE
        if d["action"] == "assign" and isinstance(d.get("target"), int):
            if self.status(d["target"]) is None:
                return "MissingIdentity"
            if self.status(d["target"]) not in (ACTIVE, DORMANT):
                return "InvalidAssignment"
        self.inferences.add(i["id"])
        self.decisions.add(d["id"])
        self.resolved.add(seen)
        return None

    def check_CreateIdentity(self, c: dict) -> str | None:
        if self.status(c["identity"]) is not None:
            return "DuplicateIdentity"
        self.statuses[c["identity"]] = ACTIVE
        return None

    def _move(self, identity: int, allowed: tuple[str, ...], after: str) -> str | None:
        now = self.status(identity)
        if now is None:
            return "MissingIdentity"
        if now not in allowed:
            return "InvalidLifecycle"
        self.statuses[identity] = after
        return None

    def check_Promote(self, c: dict) -> str | None:
        return self._move(c["identity"], (ACTIVE, DORMANT), RESOLVED)

    def check_Dormant(self, c: dict) -> str | None:
        return self._move(c["identity"], (ACTIVE,), DORMANT)

    def check_Reactivate(self, c: dict) -> str | None:
        return self._move(c["identity"], (DORMANT,), ACTIVE)

    def check_Retire(self, c: dict) -> str | None:
        return self._move(c["identity"], (ACTIVE, DORMANT), RETIRED)

    def check_Merge(self, c: dict) -> str | None:
        taken = c["decision"] in self.base.merges or c["decision"] in self.merges or self._decided(c["decision"])
        if c["left"] == c["right"] or taken:
            return "InvalidMerge"
        for i in (c["left"], c["right"]):
            if self.status(i) is None:
                return "MissingIdentity"
            if self.status(i) not in (ACTIVE, DORMANT, MERGED):
                return "InvalidMerge"
        if not all(self._decided(s) for s in c.get("supports", ())):
            return "InvalidMerge"
        self.merges.add(c["decision"])
        return None

    def check_Split(self, c: dict) -> str | None:
        # a complete split: two parts at least, each with evidence, and nothing in two of them
        if len(c["partitions"]) < 2 or not all(p.get("identities") and p.get("observations") for p in c["partitions"]):
            return "IncompleteSplit"
        for kind in ("identities", "observations"):
            named = [x for p in c["partitions"] for x in p[kind]]
            if len(set(named)) < len(named):
                return "OverlappingSplit"
        if any(m not in self.base.merges or self.base.merges[m]["end"] is not None for m in c["merges"]):
            return "InvalidSplit"
        for p in c["partitions"]:
            for i in p["identities"]:
                if self.status(i) is None:
                    return "MissingIdentity"
            for o in p.get("observations", ()):
                if o not in self.base.observations and o not in self.observations:
                    return "MissingObservation"
        for p in c["partitions"]:
            self.statuses |= dict.fromkeys(p["identities"], ACTIVE)
        return None

    def check_Revert(self, c: dict) -> str | None:
        record = self.base.transactions.get(c["target"])
        if not record or not record["active"]:
            return "InactiveTransaction"
        if c["mode"] == "Strict" and any(self.base.transactions[d]["active"] for d in self.base.dependents.get(c["target"], ())):
            return "DependentActive"
        return None

    def check_EnqueueMaterialization(self, c: dict) -> str | None:
        if c["id"] in self.base.outbox or c["id"] in self.outbox:
            return "DuplicateMaterialization"
        if not self._decided(c["decision"]):
            return "MissingDecision"
        self.outbox.add(c["id"])
        return None

    def check_Materialized(self, c: dict) -> str | None:
        row = self.base.outbox.get(c["id"])
        if row is None or row["done"] or row["decision"] != c["decision"]:
            return "MissingMaterialization"
        return None


class Ledger:
    """Commits over a backend; opened again, it replays all manifests through the same checks."""

    def __init__(self, backend: Backend | None = None):
        self.backend, self.state = backend if backend is not None else MemoryBackend(), State()
        for n, (key, raw) in enumerate(self.backend.scan("commits/"), 1):
            if key_version(key) != n:
                raise LedgerError("VersionGap")
            doc = document(key, raw)
            if doc.get("tables"):
                self.state.publish(doc)
                continue
            e = Envelope(doc["txn"], doc["expected"], doc["key"], doc["issued_at"], tuple(doc["commands"]), tuple(doc["depends_on"]))
            self.state.validate(e)
            self.state.apply(e)

    @property
    def version(self) -> int:
        return self.state.version

    def commit(self, e: Envelope) -> Commit:
        """Validate, write the manifest, then take effect; a failed write changes nothing."""
        again = self.state.replay_of(e)
        if again is not None:
            return Commit(again, True)
        self.state.validate(e)
        try:
            self.backend.apply({version_key(self.version + 1): json.dumps(asdict(e)).encode()}, exclusive=True)
        except KeyExists as x:
            raise LedgerError("VersionConflict") from x
        return Commit(self.state.apply(e), False)

    def replayed(self, key: str, digest: str) -> int | None:
        """The version that this key committed before; a collision if that was something else."""
        if key not in self.state.keys:
            return None
        old, version = self.state.keys[key]
        if old != digest:
            raise LedgerError("IdempotencyCollision")
        return version

    def stage(self, root: str, name: str, df: DataFrame) -> Staged:
        """Write a table before its commit, so that what is committed beside it can be derived from its rows."""
        v = self.version + 1
        path = f"{root.rstrip('/')}/{name}/{v:020d}-{uuid.uuid4().hex}"
        df.withColumn("version", F.lit(v).cast("long")).write.parquet(path)
        return Staged(df.sparkSession.read.parquet(path).drop("version"), path, v)

    def commit_tables(self, root: str, tables: dict[str, DataFrame | Staged], txn: int, key: str, issued_at: int, depends_on: tuple[int, ...] = (), digest: str | None = None) -> Commit:
        """Publish whole tables as one version: write their rows, then the manifest that names them.

        ``digest`` stands for the content; without one the rows themselves are summed up.
        """
        rows = {name: t.rows if isinstance(t, Staged) else t for name, t in tables.items()}
        if key in self.state.keys:
            return Commit(self.replayed(key, digest or content_digest(rows)), True)
        if txn in self.state.transactions:
            raise LedgerError("DuplicateTransaction")
        if self.version >= LAST_VERSION:
            raise LedgerError("VersionExhausted")
        if any(not self.state.transactions.get(d, {}).get("active") for d in depends_on):
            raise LedgerError("MissingDependency")
        v = self.version + 1
        if any(isinstance(t, Staged) and t.version != v for t in tables.values()):
            raise LedgerError("VersionConflict")
        staged = {name: t if isinstance(t, Staged) else self.stage(root, name, t) for name, t in tables.items()}
        paths = {name: t.path for name, t in staged.items()}
        if digest is None:
            digest = content_digest({name: t.rows for name, t in staged.items()})
        doc = {"txn": txn, "key": key, "issued_at": issued_at, "tables": paths, "version": v, "depends_on": list(depends_on), "digest": digest}
        try:
            self.backend.apply({version_key(v): json.dumps(doc).encode()}, exclusive=True)
        except KeyExists as x:
            for t in staged.values():
                _remove(t.rows.sparkSession, t.path)
            raise LedgerError("VersionConflict") from x
        return Commit(self.state.publish(doc), False)

    # ------------------------------------------------------------ reads of control state

    def canonical(self, identity: int) -> int | None:
        return self.state.classes.find(identity) if identity in self.state.classes.parent else None

    def dependency_closure(self, txn: int) -> list[int]:
        return self.state.closure(txn)

    # ------------------------------------------------------------ reads of either kind

    def table(self, spark: SparkSession, name: str, version: int | None = None, live: bool = False, only: int | None = None) -> DataFrame | None:
        """All rows of a table up to ``version``: a scan of the published folders, nothing else.

        Evidence stays whatever is reverted.  ``live``: without the transactions that were reverted by then.
        ``only``: the rows of that one version.  Folders that ``compact`` has put together are read as one.
        """
        upto = self.version if version is None else version
        folders = {t["version"]: t["tables"][name] for t in self.state.transactions.values() if name in t.get("tables", {})}
        gone = {t["version"] for t in self.state.transactions.values() if t["ended"] is not None and t["ended"] <= upto} if live else set()
        wanted = {v for v in folders if (v == only if only is not None else v <= upto) and v not in gone}
        if not wanted:
            return None
        paths = set()
        for key, raw in self.backend.scan(f"compacted/{name}/"):
            # one folder of all versions up to its own
            if key_version(key) in folders and any(v <= key_version(key) for v in wanted):
                paths = {document(key, raw)["path"]} | {folders[v] for v in wanted if v > key_version(key)}
        df = spark.read.parquet(*sorted(paths or {folders[v] for v in wanted}))
        if only is not None:
            return df.where(F.col("version") == only)
        return df.where(F.col("version") <= upto).where(~F.col("version").isin(sorted(gone)) if gone else F.lit(True))

    def compact(self, spark: SparkSession, root: str, name: str, files: int | None = None) -> None:
        """Write a table's versions so far into one folder that reads prefer; the old folders stay for open readers."""
        df = self.table(spark, name)
        last = max((t["version"] for t in self.state.transactions.values() if name in t.get("tables", {})), default=None)
        if df is None:
            return
        path = f"{root.rstrip('/')}/{name}/compacted-{last:020d}-{uuid.uuid4().hex}"
        (df if files is None else df.repartition(files)).write.parquet(path)
        self.backend.apply({f"compacted/{name}/{last:020d}.json": json.dumps({"path": path}).encode()})

    def decisions(self, spark: SparkSession, observation: int | None = None) -> DataFrame:
        """decision_id, observation_id, action, identity_id, version, ended of all decisions ever made.

        ``ended``: the version that reverted it, if one did.  Decisions of control commands and of tables are one
        history; ``versions`` has the reads of it.
        """
        schema = "decision_id long, observation_id long, action string, identity_id long, version long, ended long"
        ends = {t["version"]: t["ended"] for t in self.state.transactions.values() if t["ended"] is not None}
        of_txn = {d: t for t in self.state.transactions.values() for d in t["decisions"]}
        rows = [
            (k, d["observation"], d["action"], d["target"] if isinstance(d["target"], int) else None, d["begin"], of_txn[k]["ended"])
            for k, d in self.state.decisions.items()
            if observation is None or d["observation"] == observation
        ]
        few = spark.createDataFrame(rows, schema)
        bulk = self.table(spark, "decisions")
        if bulk is None:
            return few
        if observation is not None:
            bulk = bulk.where(F.col("observation_id") == observation)
        ended = spark.createDataFrame(sorted(ends.items()), "version long, ended long")
        bulk = bulk.select("decision_id", "observation_id", "action", "identity_id", "version").join(F.broadcast(ended), "version", "left")
        return bulk.select(*few.columns).unionByName(few)

    def _session(self, spark: SparkSession | None) -> SparkSession | None:
        """A session, where there are tables to be read."""
        if not any(t.get("tables") for t in self.state.transactions.values()):
            return None
        return spark or SparkSession.getActiveSession()

    def current_decision(self, observation: int, spark: SparkSession | None = None) -> dict | None:
        session = self._session(spark)
        if session is None:
            d = self.state.current.get(observation)
            return None if d is None else {"id": d} | self.state.decisions[d]
        return _one(versions.current(self.decisions(session, observation)).withColumn("valid_to", F.lit(None).cast("long")))

    def decision_as_of(self, observation: int, version: int, spark: SparkSession | None = None) -> dict | None:
        session = self._session(spark)
        if session is None:
            return next(({"id": k} | d for k, d in self.state.decisions.items() if d["observation"] == observation and d["begin"] <= version and (d["end"] is None or version < d["end"])), None)
        asked = session.createDataFrame([(observation, version)], "observation_id long, as_of long")
        return _one(versions.as_of(self.decisions(session, observation), asked))

    def observation(self, observation: int, spark: SparkSession | None = None) -> dict | None:
        """One piece of evidence with the version that committed it."""
        if observation in self.state.observations:
            return {"id": observation} | self.state.observations[observation]
        session = self._session(spark)
        table = None if session is None else self.table(session, "observations")
        row = None if table is None else table.where(F.col("observation_id") == observation).first()
        return None if row is None else {"id": observation} | {k: v for k, v in row.asDict().items() if k != "observation_id"}

    def observations_as_of(self, spark: SparkSession, event_time: int, version: int) -> DataFrame:
        """observation_id, event_time, version of evidence by both clocks, in the order of ids."""
        schema = "observation_id long, event_time long, version long"
        rows = spark.createDataFrame([(k, o["event_time"], o["version"]) for k, o in self.state.observations.items()], schema)
        bulk = self.table(spark, "observations", version)
        if bulk is not None:
            rows = rows.unionByName(bulk.select("observation_id", "event_time", "version"))
        return versions.observations_as_of(rows, event_time, version)


def _one(found: DataFrame) -> dict | None:
    r = found.first()
    return None if r is None else {"id": r["decision_id"], "observation": r["observation_id"], "action": r["action"], "target": r["identity_id"], "begin": r["version"], "end": r["valid_to"]}


def _remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_digest(df: DataFrame, *columns: str) -> str:
    """Stands for the rows of a table, whatever their order: their number and the sum of their hashes."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*(columns or sorted(df.columns))).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def content_digest(tables: dict[str, DataFrame]) -> str:
    return hashlib.sha256(json.dumps({name: [sorted(df.columns), row_digest(df)] for name, df in sorted(tables.items())}).encode()).hexdigest()


def new_observations(fresh: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(to add, rejected) of mass evidence, by joins.

    The same id with the same hash is an idempotent repetition and is left out silently; with another
    hash it is rejected, as is a reference to an observation that neither table has.  Of the known evidence
    only ids between the smallest and the largest that the batch names are read.
    """
    if known is not None:
        low, high = fresh.agg(F.min(F.least("observation_id", "supersedes")), F.max(F.greatest("observation_id", "supersedes"))).first()
        known = known.where(F.col("observation_id").between(F.lit(low), F.lit(high)))
    one = fresh.dropDuplicates(["observation_id", "content_hash"])
    twice = one.groupBy("observation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("observation_id")
    bad = one.join(twice, "observation_id", "left_semi").withColumn("error", F.lit("ImmutableObservation"))
    good = one.join(twice, "observation_id", "left_anti")
    if known is not None:
        old = known.select("observation_id", F.col("content_hash").alias("_old"))
        x = good.join(old, "observation_id", "left")
        bad = bad.unionByName(x.where("_old IS NOT NULL AND _old <> content_hash").drop("_old").withColumn("error", F.lit("ImmutableObservation")))
        good = x.where("_old IS NULL").drop("_old")
    ids = one.select(F.col("observation_id").alias("supersedes"))
    ids = ids if known is None else ids.unionByName(known.select(F.col("observation_id").alias("supersedes")))
    linked = good.where("supersedes IS NOT NULL")
    lost = linked.join(ids.dropDuplicates(), "supersedes", "left_anti").select(*good.columns)
    bad = bad.unionByName(lost.withColumn("error", F.lit("MissingObservation")))
    return written(good.join(lost.select("observation_id"), "observation_id", "left_anti"), "fresh"), bad
