"""One batch from evidence to decisions: persist, gate, factor, solve, decide, commit, deliver.

A batch may be given again at any point after a failure: what an attempt committed is read back and not
committed twice, and what it did not reach is done then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import candidates, decide, infer, outbox, workspace
from orrery.operators.factors import FactorProvider, contributions_by_variable, factor_error
from orrery.operators.ledger import Ledger, Staged, new_observations, row_digest
from orrery.session import written


class BatchError(Exception):
    """A batch that cannot be processed; nothing but evidence may have been committed.  ``code`` names the rule."""

    def __init__(self, code: str, detail: object = None):
        super().__init__(code if detail is None else f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Snapshot:
    """What a batch is pinned to from its beginning to its end."""

    providers: tuple[FactorProvider, ...]
    host: int = 0
    candidates: int = 1


@dataclass
class Result:
    evidence_version: int
    resolution_version: int
    final_version: int
    decisions: DataFrame
    rejected: DataFrame
    pending: DataFrame


OUTBOX = "materialization_id long, decision_id long"
#: What a provider says about itself, 1 where it says nothing; 0 is no version.
ARTIFACT = ("provider_id", "schema_id", "model_version", "calibration_id")


@dataclass
class Runtime:
    """``plan`` turns decisions into rows to deliver (materialization_id, decision_id, ...); ``deliver`` returns those that went through."""

    ledger: Ledger
    root: str
    providers: list[FactorProvider]
    config: infer.Config = field(default_factory=infer.Config)
    losses: decide.Losses = field(default_factory=decide.Losses)
    plan: Callable[[DataFrame], DataFrame] | None = None
    deliver: Callable[[DataFrame], DataFrame] | None = None
    capacity: int = 16
    current: DataFrame | None = None
    snapshot: Snapshot | None = None

    def publish(self, providers: list[FactorProvider], host: int, candidates: int) -> None:
        """Swap providers and snapshot versions at once; a batch that is under way keeps its own."""
        self.snapshot = Snapshot(tuple(providers), host, candidates)

    def _commit(self, tables: dict[str, DataFrame | Staged], tag: str, issued_at: int, batch_key: str, digest: str, after: int | None = None) -> int:
        txn = max(self.ledger.state.transactions, default=0) + 1
        depends = tuple(t for t, r in self.ledger.state.transactions.items() if r["version"] == after)
        return self.ledger.commit_tables(self.root, tables, txn, _key(batch_key, tag), issued_at, depends, digest).version

    def process(self, observations: DataFrame, batch_key: str) -> Result:
        """``observations``: observation_id, ingestion_time, content_hash, supersedes, and what providers need.

        ``batch_key`` names the batch: the same one again commits nothing twice, and with other evidence it
        is a collision.
        """
        pinned = self.snapshot or Snapshot(tuple(self.providers))
        if not pinned.providers:
            raise BatchError("NoProviders")
        self.config.validate()
        spark = observations.sparkSession
        issued = observations.agg(F.max("ingestion_time")).first()[0]
        if issued is None:
            raise BatchError("EmptyBatch")
        digest = row_digest(observations, "observation_id", "content_hash")
        evidence = self.ledger.replayed(_key(batch_key, "evidence"), digest)
        if evidence is None:
            fresh, rejected = new_observations(observations, self.ledger.table(spark, "observations"))
            evidence = self._commit({"observations": fresh, "rejected": rejected}, "evidence", issued, batch_key, digest)
        # what that version holds, be it of this attempt or of one before
        fresh = self.ledger.table(spark, "observations", only=evidence).drop("version")
        rejected = self.ledger.table(spark, "rejected", only=evidence).drop("version")
        resolution = self.ledger.replayed(_key(batch_key, "resolution"), digest)
        if resolution is None:
            resolution = self._commit(self._resolve(fresh, pinned, batch_key), "resolution", issued, batch_key, digest, evidence)
            if self.current is not None:
                self.current = written(workspace.apply_committed(_associations(self.ledger.table(spark, "decisions", only=resolution), fresh), self.capacity, self.current), "workspace")
        self.workspace(spark)
        box = self.ledger.table(spark, "outbox", only=resolution) if self.plan is not None else None
        left = spark.createDataFrame([], OUTBOX) if box is None else box.select("materialization_id", "decision_id")
        if box is not None and self.deliver is not None:
            left = self.retry(batch_key, issued)
        return Result(evidence, resolution, self.ledger.version, self.ledger.table(spark, "decisions", only=resolution), rejected, left)

    def _resolve(self, fresh: DataFrame, pinned: Snapshot, batch_key: str) -> dict[str, DataFrame | Staged]:
        """The tables of a resolution."""
        spark = fresh.sparkSession
        each = [_complete(p.generate_candidates(fresh), fresh) for p in pinned.providers]
        gated = each[0] if len(each) == 1 else written(candidates.union(*each), "gated")
        tables = [p.emit_factors(fresh, gated) for p in pinned.providers]
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        every = written(every, "factors")
        groups = written(candidates.groups(gated), "groups")
        _validate(every, groups)
        entries = self.ledger.stage(self.root, "inferences", self._posterior(every, groups))
        decided = decide.decide(entries.rows, self.losses).withColumnRenamed("inference_id", "observation_id")
        number = lambda tag: F.xxhash64("observation_id", F.lit(f"{batch_key}{tag}")).bitwiseAND(F.lit(2**63 - 1))
        decided = decided.withColumn("decision_id", number("")).withColumn("created_identity", F.when(F.col("action") == "new", number(":identity")))
        decided = written(decided.withColumn("policy_version", F.lit(self.losses.policy_version)).withColumn("loss_version", F.lit(self.losses.loss_version)), "decided")
        artifacts = [tuple(int(getattr(p, k, 1)) for k in ARTIFACT) for p in pinned.providers]
        if not all(all(a) for a in artifacts) or not all((self.config.version, self.losses.policy_version, self.losses.loss_version)):
            raise BatchError("IncompleteProvenance")
        pins = (self.config.version, pinned.host, pinned.candidates, hashlib.sha256(repr(self.config).encode()).hexdigest())
        provenance = [(k, *a, *pins) for k, a in enumerate(artifacts)]
        schema = "ordinal int, " + ", ".join(f"{k} long" for k in ARTIFACT) + ", solver_version int, host_snapshot long, candidate_version long, configuration_hash string"
        out = {"inferences": entries, "decisions": decided, "provenance": spark.createDataFrame(provenance, schema)}
        given = [contributions_by_variable(t, p.contributions(fresh, t)).withColumn("provider_id", F.lit(a[0])) for p, t, a in zip(pinned.providers, tables, artifacts, strict=True) if hasattr(p, "contributions")]
        if given:
            every = given[0]
            for g in given[1:]:
                every = every.unionByName(g)
            out["contributions"] = every.withColumnRenamed("variable", "observation_id")
        if self.plan is not None:
            out["outbox"] = written(self.plan(decided), "outbox")
        return out

    def workspace(self, spark: SparkSession) -> DataFrame:
        """What is known now of each identity; after a restart it is derived from the ledger again."""
        if self.current is None:
            decided, seen = self.ledger.table(spark, "decisions", live=True), self.ledger.table(spark, "observations")
            if decided is None:
                empty = spark.createDataFrame([], "identity_id long, version long, activation long, decision_id long")
                return workspace.apply_committed(empty, self.capacity)
            self.current = written(workspace.apply_committed(_associations(decided, seen), self.capacity), "workspace")
        return self.current

    def retry(self, batch_key: str, issued_at: int, spark: SparkSession | None = None) -> DataFrame:
        """Deliver what is pending and commit receipts of what went through; the rest stays pending."""
        spark = spark or SparkSession.getActiveSession()
        box, old = self.ledger.table(spark, "outbox", live=True), self.ledger.table(spark, "receipts")
        if box is None:
            return spark.createDataFrame([], OUTBOX)
        box = box.select("materialization_id", "decision_id")
        old = spark.createDataFrame([], OUTBOX) if old is None else old.select("materialization_id", "decision_id")
        fresh = written(outbox.retry(box, old, self.deliver), "receipts")
        wrong = outbox.receipt_errors(fresh, box).first()
        if wrong is not None:
            raise BatchError(wrong["error"], wrong["materialization_id"])
        if not fresh.isEmpty():
            self._commit({"receipts": fresh}, f"receipt:{self.ledger.version}", issued_at, batch_key, row_digest(fresh))
        return outbox.pending(box, old.unionByName(fresh))

    def _posterior(self, every: DataFrame, groups: DataFrame) -> DataFrame:
        """inference_id, outcome_rank, identity_id, p of each observation, and how its solution ended.

        If all factors have one variable this is a softmax; else message passing by component.
        """
        how = ["iterations", "residual", "reason"]
        if every.where(F.size("variables") > 1).isEmpty():
            # a row for each observation up to the last step: its tables are added up place by place
            tables = every.groupBy(F.element_at("variables", 1).alias("observation_id")).agg(F.collect_list("log_potentials").alias("t"))
            plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
            c, n = self.config, F.size("candidates")
            prior = F.concat(F.array_repeat(F.lit(float(c.candidate_prior)), n), F.array(F.lit(float(c.new_prior)), F.lit(float(c.noise_prior))))
            # no factor at all leaves the priors
            score = F.when(F.col("t").isNull(), prior).otherwise(F.aggregate("t", prior, plus))
            scored = groups.join(tables, "observation_id", "left").select("observation_id", "candidates", n.alias("n"), score.alias("s"))
            # the largest is bound to a variable, so that it is found once a row
            shifted = lambda m: F.transform("s", lambda x: F.exp(x - m))
            scored = scored.select("observation_id", "candidates", "n", F.element_at(F.transform(F.array(F.array_max("s")), shifted), 1).alias("e"))
            total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
            solved = scored.select("observation_id", "n", "candidates", total.alias("total"), F.posexplode("e").alias("state", "e"))
            solved = solved.select("observation_id", "state", "n", F.get("candidates", F.col("state")).alias("identity_id"), (F.col("e") / F.col("total")).alias("p"), F.lit(2).alias("iterations"), F.lit(0.0).alias("residual"), F.lit("Exact").alias("reason"))
        else:
            variables = groups.select(F.col("observation_id").alias("variable"), F.size("candidates").alias("candidates"))
            v, f = infer.by_component(variables, every)
            p = infer.posteriors(v, f, self.config, "component").select(F.col("variable").alias("observation_id"), "state", "p", *how)
            solved = p.join(groups.select("observation_id", F.size("candidates").alias("n"), "candidates"), "observation_id").withColumn("identity_id", F.get("candidates", F.col("state")))
        rank = F.greatest(F.col("state") - F.col("n") + 1, F.lit(0))
        return solved.select(F.col("observation_id").alias("inference_id"), rank.cast("int").alias("outcome_rank"), "identity_id", "p", *how)


def _key(batch_key: str, tag: str) -> str:
    return hashlib.sha256(f"{batch_key}:{tag}".encode()).hexdigest()[:32]


def _associations(decided: DataFrame, seen: DataFrame) -> DataFrame:
    """identity_id, version, activation, decision_id of decisions that assign or create an identity."""
    known = decided.withColumn("identity_id", F.coalesce("created_identity", "identity_id")).where("identity_id IS NOT NULL")
    return known.join(seen.select("observation_id", "ingestion_time"), "observation_id").select("identity_id", F.col("version").cast("long").alias("version"), F.col("ingestion_time").alias("activation"), "decision_id")


def _complete(gated: DataFrame, fresh: DataFrame) -> DataFrame:
    """A provider's candidates, which must name all observations of the batch and no others."""
    gated = written(gated, "candidates")
    has = gated.select("observation_id").distinct().withColumn("_has", F.lit(True))
    wrong = fresh.select("observation_id", F.lit(True).alias("_in")).join(has, "observation_id", "full").where("_in IS NULL OR _has IS NULL").first()
    if wrong is not None:
        raise BatchError("IncompleteProvider" if wrong["_in"] else "ObservationOutOfBounds", wrong["observation_id"])
    return gated


def _validate(every: DataFrame, groups: DataFrame) -> None:
    """Factor tables keep the rules, and their cardinalities are those of the candidates."""
    error = factor_error(F.col("variables"), F.col("cardinalities"), F.col("log_potentials"))
    bad = every.withColumn("error", error).where("error IS NOT NULL").first()
    if bad is not None:
        raise BatchError(bad["error"], bad["factor_id"])
    scope = every.select("factor_id", F.explode(F.arrays_zip("variables", "cardinalities")).alias("x")).select("factor_id", F.col("x.variables").alias("observation_id"), F.col("x.cardinalities").alias("c"))
    sizes = groups.select("observation_id", (F.size("candidates") + 2).alias("n"))
    bad = scope.join(sizes, "observation_id", "left").where("n IS NULL OR n <> c").first()
    if bad is not None:
        raise BatchError("UnknownVariable" if bad["n"] is None else "CardinalityMismatch", bad["factor_id"])
