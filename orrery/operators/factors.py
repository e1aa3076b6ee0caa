"""Factor tables, their validation, and the interface of factor providers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.checks import INF, _first

SCHEMA = "batch_id long, factor_id long, variables array<long>, cardinalities array<int>, log_potentials array<double>"


class FactorProvider(Protocol):
    """What proposes candidates and scores them, for a whole batch at a time, as DataFrames."""

    provider_id: int
    model_version: int

    def generate_candidates(self, observations: DataFrame) -> DataFrame:
        """(observation_id, identity_id)."""

    def emit_factors(self, observations: DataFrame, candidates: DataFrame) -> DataFrame:
        """Factor tables as in SCHEMA."""


def factor_error(variables: Column, cardinalities: Column, potentials: Column) -> Column:
    """The first rule that a factor table breaks, null if none.  Potentials of minus infinity are not finite."""
    size = F.aggregate(cardinalities, F.lit(1).cast("long"), lambda a, c: a * c.cast("long"))
    return _first(
        ((F.size(variables) <= 0) | (F.size(variables) != F.size(cardinalities)), "EmptyScope"),
        (F.size(F.array_distinct(variables)) != F.size(variables), "DuplicateVariable"),
        (F.exists(cardinalities, lambda c: c <= 0), "InvalidCardinality"),
        (size != F.size(potentials), "TableLength"),
        (F.exists(potentials, lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == INF)), "NonFinitePotential"),
    )


def contributions_by_variable(factors: DataFrame, contributions: DataFrame) -> DataFrame:
    """Each factor's contributions (factor_id, value, ...), once for every variable of its scope."""
    scope = factors.select("factor_id", F.explode("variables").alias("variable"))
    return scope.join(contributions, "factor_id")
