"""Quality metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.checks import _first, finite, probability_error

#: Smallest positive normal double: the floor of probabilities under a logarithm.
MIN_POSITIVE = 2.2250738585072014e-308


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return _ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return _ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def sample_error(p: Column) -> Column:
    return probability_error(p)


def calibration(samples: DataFrame, bins: int) -> DataFrame:
    """n, nll, brier, ece of samples (p, outcome boolean).

    Bins are of equal width.  Two levels: one row for each bin leaves each task.
    """
    if bins <= 0:
        raise ValueError("bins must be positive")
    hit = F.when(F.col("outcome"), F.col("p")).otherwise(1 - F.col("p"))
    y = F.col("outcome").cast("double")
    binned = samples.select("p", y.alias("y"), F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin"), (-F.ln(F.greatest(hit, F.lit(MIN_POSITIVE)))).alias("nll"), ((F.col("p") - y) ** 2).alias("brier"))
    per = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"))
    n = F.sum("n")
    return per.agg(n.alias("n"), (F.sum("nll") / n).alias("nll"), (F.sum("brier") / n).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"))


def reliability(samples: DataFrame, bins: int) -> DataFrame:
    """Extension: the reliability diagram, a row for each bin that has samples."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return samples.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("outcome").cast("double")).alias("rate"))


def pairwise_counts(classes: DataFrame) -> DataFrame:
    """tp, fp, fn of pairs from (truth, predicted), by class sizes, never by enumerating pairs."""
    pairs = lambda *by: classes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("k"))
    both, truth, predicted = pairs("truth", "predicted").toDF("tp"), pairs("truth").toDF("t"), pairs("predicted").toDF("p")
    one = both.withColumn("j", F.lit(1)).join(truth.withColumn("j", F.lit(1)), "j").join(predicted.withColumn("j", F.lit(1)), "j")
    return one.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))


def b_cubed(classes: DataFrame) -> DataFrame:
    """Extension: B-cubed precision and recall from (truth, predicted), by cell sizes."""
    cell = classes.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    t, p = cell.groupBy("truth").agg(F.sum("n").alias("nt")), cell.groupBy("predicted").agg(F.sum("n").alias("np"))
    x = cell.join(t, "truth").join(p, "predicted")
    n = F.sum("n")
    return x.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / n).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("nt")) / n).alias("recall"))


def adjusted_rand(classes: DataFrame) -> DataFrame:
    """Extension: the adjusted Rand index of (truth, predicted), by class sizes; null where it is not defined."""
    n = classes.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("pairs")).withColumn("j", F.lit(1))
    x = pairwise_counts(classes).withColumn("j", F.lit(1)).join(n, "j")
    truth, predicted = (F.col("tp") + F.col("fn")).cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    expected = F.try_divide(truth * predicted, F.col("pairs"))
    return x.select(F.try_divide(F.col("tp") - expected, (truth + predicted) / 2 - expected).alias("adjusted_rand"))


def scale_error(sizes: list[Column], throughput: Column, p50: Column, p95: Column, p99: Column) -> Column:
    zero = F.lit(False)
    for s in sizes:
        zero = zero | (s <= 0)
    return _first((zero, "EmptyDimension"), (~finite(throughput) | (throughput <= 0), "InvalidThroughput"), (~(finite(p50) & finite(p95) & finite(p99)) | (p50 > p95) | (p95 > p99), "LatencyOrder"))
