"""The host graph: nodes of four kinds, typed edges, idempotent insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge roles with their codes and the kinds of their ends (fixed values).
ROLES = (
    (0, "Triggers", "State", "Event"),
    (1, "LeadsTo", "Event", "State"),
    (2, "Evolution", "State", "State"),
    (3, "Contain", "Event", "Event"),
    (4, "Occur", "Event", "Physical"),
    (5, "Influence", "Event", "Physical"),
)


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLES), "code int, role string, source_kind string, target_kind string")


def _by_role(role: Column, place: int, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for r in ROLES:
        out = F.when(role == r[1], F.lit(r[place])).otherwise(out)
    return out


def role_code(role: Column) -> Column:
    return _by_role(role, 0, "int")


def end_kinds(role: Column) -> tuple[Column, Column]:
    """Kinds of a relation's source and target."""
    return _by_role(role, 2, "string"), _by_role(role, 3, "string")


def profile_error(predicates: dict[str, str]) -> str | None:
    """A host schema names a distinct, non-empty predicate for each role."""
    if set(predicates) != {r[1] for r in ROLES} or not all(predicates.values()):
        return "EmptyPredicate"
    return "DuplicatePredicate" if len(set(predicates.values())) < len(predicates) else None


def add_nodes(nodes: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all nodes, rejected): a node that exists is rejected, of equal new ones one is added."""
    twice = fresh.join(nodes.select("node", "kind"), ["node", "kind"], "left_semi")
    added = fresh.join(nodes.select("node", "kind"), ["node", "kind"], "left_anti").dropDuplicates(["node", "kind"])
    return nodes.unionByName(added), twice


#: What makes a request for a known id the same one again.
PAYLOAD = ("role", "source", "target", "decision_id", "version")


def materialize(requests: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``requests`` (seq, materialization_id, role, source, target) with ``outcome``; ``nodes``: node, kind.

    ``edges``: what earlier batches inserted, with the same columns but ``seq``; its ids are taken.  Where
    requests name their ``decision_id`` and ``version`` these belong to the payload too.
    The role says of which kinds the ends are.
    In order of ``seq``: the first request of an id whose ends exist is Inserted; a later one with the same
    payload is Replayed, with another one a Collision; before that a missing end is reported, the source
    first.  Set-based: the inserted row of an id comes from one aggregation, joined back.
    """
    payload = [c for c in PAYLOAD if c in requests.columns]
    has = lambda name: nodes.select(F.col("node").alias(name), F.col("kind").alias(f"_{name}_kind")).dropDuplicates().withColumn(f"_has_{name}", F.lit(True))
    source_kind, target_kind = end_kinds(F.col("role"))
    known = requests.withColumn("_source_kind", source_kind).withColumn("_target_kind", target_kind)
    known = known.join(has("source"), ["source", "_source_kind"], "left").join(has("target"), ["target", "_target_kind"], "left")
    ok = F.col("_has_source").isNotNull() & F.col("_has_target").isNotNull()
    held = known.where(ok).select("materialization_id", F.struct(F.lit(0).alias("new"), "seq", *payload).alias("_r"))
    if edges is not None:
        earlier = F.struct(F.lit(-1).alias("new"), F.lit(None).cast(requests.schema["seq"].dataType).alias("seq"), *payload)
        held = held.unionByName(edges.select("materialization_id", earlier.alias("_r")))
    first = held.groupBy("materialization_id").agg(F.min("_r").alias("_first"))
    x = known.join(first, "materialization_id", "left")
    same = F.lit(True)
    for c in payload:
        same = same & F.col(f"_first.{c}").eqNullSafe(F.col(c))
    before = (F.col("_first.new") < 0) | (F.col("_first.seq") < F.col("seq"))
    outcome = (
        F.when(F.col("_first.seq") == F.col("seq"), "Inserted")
        .when(before, F.when(same, "Replayed").otherwise("Collision"))
        .when(F.col("_has_source").isNull(), "MissingSource")
        .otherwise("MissingTarget")
    )
    return x.select(*requests.columns, outcome.alias("outcome"))


def inserted(outcomes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The edges after a batch: what it inserted, and those of earlier ones."""
    payload = [c for c in PAYLOAD if c in outcomes.columns]
    new = outcomes.where("outcome = 'Inserted'").select("materialization_id", *payload)
    return new if edges is None else edges.select(*new.columns).unionByName(new)


def incoming(edges: DataFrame) -> DataFrame:
    """(node, incoming): edges that end in each node."""
    return edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))
