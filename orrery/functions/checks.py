"""Validators, probabilities and clocks as column functions.

A validator returns a column that is null where the row is valid and else holds the name of the first
rule it breaks.  They stay inside code generation; a caller filters, counts or keeps the codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
MAX_MICROS, MIN_MICROS = 2**63 - 1, -(2**63)
EPSILON = 2.0**-52


def _first(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds."""
    out = F.lit(None).cast("string")
    for broken, code in reversed(rules):
        out = F.when(broken, F.lit(code)).otherwise(out)
    return out


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


# ---------------------------------------------------------------- probabilities


def saturate(x: Column) -> Column:
    """Clamp to [0, 1]; NaN and null are 0."""
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(x)


def probability_error(x: Column) -> Column:
    return _first((~finite(x), "NonFinite"), ((x < 0) | (x > 1), "OutOfRange"))


def to_log(p: Column) -> Column:
    """Natural logarithm; 0 is minus infinity (``ln`` alone gives null)."""
    return F.when(p == 0, F.lit(-INF)).otherwise(F.ln(p))


def from_log(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (x == -INF), F.lit(0.0)).when(x >= 0, F.lit(1.0)).otherwise(F.exp(x))


def from_log_error(x: Column) -> Column:
    return _first((x.isNull() | F.isnan(x) | (x == INF), "NonFinite"), (x > 0, "OutOfRange"))


# ---------------------------------------------------------------- clocks, in microseconds


def _saturated(result: Column, negative: Column) -> Column:
    return F.coalesce(result, F.when(negative, F.lit(MIN_MICROS)).otherwise(F.lit(MAX_MICROS)))


def from_millis(x: Column) -> Column:
    return _saturated(F.try_multiply(x.cast("long"), F.lit(1_000).cast("long")), x < 0)


def from_secs(x: Column) -> Column:
    return _saturated(F.try_multiply(x.cast("long"), F.lit(1_000_000).cast("long")), x < 0)


def as_millis(us: Column) -> Column:
    """Floor division, also before the epoch."""
    return F.floor((us - F.pmod(us, F.lit(1_000))) / 1_000).cast("long")


def as_secs(us: Column) -> Column:
    return F.floor((us - F.pmod(us, F.lit(1_000_000))) / 1_000_000).cast("long")


def as_secs_double(us: Column) -> Column:
    return us / F.lit(1e6)


def duration_since(later: Column, earlier: Column) -> Column:
    """Elapsed microseconds, 0 if the other is later."""
    return F.greatest(_saturated(F.try_subtract(later, earlier), F.lit(False)), F.lit(0).cast("long"))


def add_micros(us: Column, delta: Column) -> Column:
    return _saturated(F.try_add(us, delta), delta < 0)


def subtract_micros(us: Column, delta: Column) -> Column:
    return _saturated(F.try_subtract(us, delta), delta > 0)


def next_version(v: Column) -> Column:
    """One more, or null behind the largest."""
    return F.try_add(v.cast("long"), F.lit(1).cast("long"))


# ---------------------------------------------------------------- records


def observation_error(observation: Column, supersedes: Column) -> Column:
    """Nothing supersedes itself.  The two clocks may stand in any order."""
    return _first((observation.isNull() | (observation < 0), "InvalidId"), (supersedes == observation, "SelfSupersession"))


def idempotency_error(key_hex: Column) -> Column:
    return _first((key_hex.isNull() | ~F.lower(key_hex).rlike("^[0-9a-f]{32}$"), "InvalidKey"), (key_hex == "0" * 32, "ReservedKey"))


def payload_error(kind: Column, key: Column) -> Column:
    return _first(((kind == "external") & (F.coalesce(F.length(key), F.lit(0)) == 0), "EmptyKey"))


def covariance_error(xx: Column, xy: Column, yx: Column, yy: Column) -> Column:
    """Finite, symmetric, non-negative diagonal and determinant."""
    ok = finite(xx) & finite(xy) & finite(yx) & finite(yy)
    return _first((~ok, "NonFinite"), (F.abs(xy - yx) > EPSILON, "Asymmetric"), ((xx < 0) | (yy < 0), "NegativeVariance"), (xx * yy - xy * yx < 0, "NotPositive"))


def mention_error(start: Column, end: Column) -> Column:
    return _first((F.coalesce(start >= end, F.lit(True)), "EmptyMention"))


SEMANTICS = ("LogLikelihood", "LogLikelihoodRatio", "LogPotential", "CalibratedPosterior")


def contribution_error(value: Column, semantics: Column, domain: Column) -> Column:
    return _first(
        (~semantics.isin(*SEMANTICS), "UnknownSemantics"),
        (~finite(value), "NonFinite"),
        ((semantics == SEMANTICS[3]) & ((value < 0) | (value > 1)), "OutOfRange"),
        (F.coalesce(F.length(domain), F.lit(0)) == 0, "EmptyDomain"),
    )


def interval_error(begin: Column, end: Column) -> Column:
    return _first((end.isNotNull() & (end <= begin), "EmptyInterval"))


def contains(begin: Column, end: Column, version: Column) -> Column:
    """Half-open; a null end is open."""
    return (version >= begin) & (end.isNull() | (version < end))


def keeps_global_marginal(treatment: Column) -> Column:
    return treatment.isin("Global", "ExactInduced", "NoCrossBoundary", "ConstantInduced")


def loss_error(false_assign: Column, false_create: Column, false_noise: Column, abstain: Column) -> Column:
    """Names the first loss that is not finite and non-negative."""
    bad = lambda x: ~finite(x) | (x < 0)
    return _first((bad(false_assign), "false_assign"), (bad(false_create), "false_create"), (bad(false_noise), "false_noise"), (bad(abstain), "abstain"))


def host_reference_error(key: Column) -> Column:
    return _first((F.coalesce(F.length(key), F.lit(0)) == 0, "EmptyKey"))


def merge_error(left: Column, right: Column) -> Column:
    return _first((left == right, "SelfMerge"))


def envelope_error(commands: Column) -> Column:
    return _first((F.coalesce(F.size(commands), F.lit(0)) <= 0, "EmptyEnvelope"))


def display(prefix: str, x: Column) -> Column:
    """I#, O#, E#, S# before ids; v before versions."""
    return F.concat(F.lit(prefix), x.cast("string"))


def distribution_errors(entries: DataFrame, residual: str | None = None, rule: str | None = None) -> DataFrame:
    """(inference_id, error) of long-form distributions (inference_id, outcome_key, outcome_rank, p).

    In order: a residual without rule, an outcome twice, New or Noise missing, a total that is not 1
    within 1e-10.  ``residual`` and ``rule`` name optional columns that are constant in an inference.
    """
    r = F.coalesce(F.first(residual), F.lit(0.0)) if residual else F.lit(0.0)
    unruled = ((F.first(residual).isNotNull()) & (F.coalesce(F.length(F.first(rule)), F.lit(0)) == 0)) if residual else F.lit(False)
    per = entries.groupBy("inference_id", "outcome_key").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"), F.first("outcome_rank").alias("rank"), *([F.first(residual).alias(residual), F.first(rule).alias(rule)] if residual else []))
    code = _first(
        (unruled, "EmptyResidualRule"),
        (F.max("n") > 1, "DuplicateOutcome"),
        (~F.bool_or(F.col("rank") == 1) | ~F.bool_or(F.col("rank") == 2), "MissingOutcome"),
        (F.abs(F.sum("p") + r - 1) > 1e-10, "NotNormalized"),
    )
    return per.groupBy("inference_id").agg(code.alias("error"))


def split_errors(partitions: DataFrame) -> DataFrame:
    """(plan_id, error) of split plans in long form (plan_id, part, kind 'identity'/'observation', id)."""
    parts = partitions.groupBy("plan_id").agg(F.count_distinct("part").alias("parts"))
    filled = partitions.where("id IS NOT NULL").groupBy("plan_id", "part").agg(F.sum((F.col("kind") == "identity").cast("int")).alias("i")).groupBy("plan_id").agg(F.count(F.lit(1)).alias("filled"), F.min("i").alias("least"))
    twice = partitions.where("id IS NOT NULL").groupBy("plan_id", "kind", "id").agg(F.count_distinct("part").alias("n")).groupBy("plan_id").agg(F.max("n").alias("most"))
    code = _first(
        (F.col("parts") < 2, "TooFewPartitions"),
        (F.coalesce(F.col("filled"), F.lit(0)) < F.col("parts"), "EmptyPartition"),
        (F.col("most") > 1, "Overlap"),
    )
    return parts.join(filled, "plan_id", "left").join(twice, "plan_id", "left").select("plan_id", code.alias("error"))


#: Allowed lifecycle moves by command; a merge endpoint may also be merged already.
MOVES = (
    ("Promote", "Active", "Resolved"), ("Promote", "Dormant", "Resolved"),
    ("Merge", "Active", "Merged"), ("Merge", "Dormant", "Merged"), ("Merge", "Merged", "Merged"),
    ("Dormant", "Active", "Dormant"), ("Reactivate", "Dormant", "Active"),
    ("Retire", "Active", "Retired"), ("Retire", "Dormant", "Retired"),
    ("Split", "Active", "Active"), ("Split", "Dormant", "Active"), ("Split", "Resolved", "Active"), ("Split", "Merged", "Active"), ("Split", "Retired", "Active"),
)


def move(command: Column, status: Column) -> Column:
    """The status after a command, null if the command is not allowed."""
    out = F.lit(None).cast("string")
    for c, s, after in MOVES:
        out = F.when((command == c) & (status == s), F.lit(after)).otherwise(out)
    return out
