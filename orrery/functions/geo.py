"""Spatial kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.checks import EPSILON, INF, _first, finite

EARTH_METERS = 6_371_000.0
MAX_ACCURACY = 1.7976931348623157e308**0.5 / 2


def clamp_angle(x: Column, most: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(-most)), F.lit(most)))


def point(lat: Column, lon: Column, altitude: Column | None = None) -> Column:
    """A saturated point: NaN is 0, angles are clamped, an altitude that is not finite is dropped."""
    alt = F.lit(None).cast("double") if altitude is None else F.when(finite(altitude), altitude)
    return F.struct(clamp_angle(lat, 90.0).alias("lat"), clamp_angle(lon, 180.0).alias("lon"), alt.alias("altitude"))


def point_error(lat: Column, lon: Column, altitude: Column | None = None) -> Column:
    rules = [(~finite(lat), "NonFiniteLatitude"), (F.abs(lat) > 90, "LatitudeRange"), (~finite(lon), "NonFiniteLongitude"), (F.abs(lon) > 180, "LongitudeRange")]
    if altitude is not None:
        rules.append((altitude.isNotNull() & ~finite(altitude), "NonFiniteAltitude"))
    return _first(*rules)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle meters; NaN for an invalid point."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    bad = point_error(lat1, lon1).isNotNull() | point_error(lat2, lon2).isNotNull()
    return F.when(bad, F.lit(float("nan"))).otherwise(2 * EARTH_METERS * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def accuracy(x: Column) -> Column:
    """Saturated standard deviation in meters."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(F.least(x, F.lit(MAX_ACCURACY)))


def accuracy_error(x: Column) -> Column:
    return _first((~finite(x), "NonFiniteAccuracy"), ((x < 0) | (x > MAX_ACCURACY), "AccuracyRange"))


def isotropic_log_likelihood(distance: Column, sigma1: Column, sigma2: Column) -> Column:
    """-(d / hypot(s1, s2))^2 / 2, without a normalising constant."""
    sigma = F.hypot(sigma1, sigma2)
    near = F.when(distance <= EPSILON, F.lit(0.0)).otherwise(F.lit(-INF))
    return F.when(F.isnan(distance), F.lit(-INF)).when(sigma <= EPSILON, near).otherwise(-0.5 * (distance / sigma) ** 2)


def covariance2d_error(xx: Column, xy: Column, yy: Column) -> Column:
    """Finite, non-negative variances, correlation of 1 at most."""
    limit = F.sqrt(xx) * F.sqrt(yy)
    return _first((~(finite(xx) & finite(xy) & finite(yy)), "NonFiniteCovariance"), ((xx < 0) | (yy < 0), "NegativeVariance"), (F.abs(xy) > limit * (1 + 64 * EPSILON), "CorrelationRange"))


def mean2d_error(x: Column, y: Column) -> Column:
    return _first((~(finite(x) & finite(y)), "NonFiniteMean"))


def gaussian_log_likelihood(df: DataFrame, dx: Column, dy: Column, xx: Column, xy: Column, yy: Column, into: str = "ll") -> DataFrame:
    """``df`` with -q / 2 of the Mahalanobis form of a mean difference under a summed covariance.

    The covariance is factored by Cholesky, the larger variance s first: with r = xy / s and the rest
    t = (smaller variance) / s - r^2, a difference (g, h) in units of sqrt(s), in that order of axes, has
    q = g^2 + (h - r g)^2 / t.  Dividing by s first keeps all of it near 1.  Fixed results: a covariance that is not
    finite or not positive semi-definite is null, a difference that is not finite is minus infinity, equal
    means are 0 even under a singular covariance, which otherwise is minus infinity, and so is a q that
    overflows.  Steps are projections of their own, so that none is computed more than once a row.
    """
    c = F.col
    swap = c("_in.yy") > c("_in.xx")
    either = lambda first, second: F.when(swap, c(f"_in.{second}")).otherwise(c(f"_in.{first}"))
    x = df.withColumn("_in", F.struct(dx.alias("dx"), dy.alias("dy"), xx.alias("xx"), xy.alias("xy"), yy.alias("yy")))
    x = x.withColumn("_in", F.struct("_in.xy", F.greatest("_in.xx", "_in.yy").alias("s"), F.least("_in.xx", "_in.yy").alias("small"), either("dx", "dy").alias("g"), either("dy", "dx").alias("h")))
    unit = F.sqrt("_in.s")
    x = x.withColumn("_r", F.when(c("_in.s") > 0, c("_in.xy") / c("_in.s")).otherwise(F.lit(0.0)))
    x = x.withColumn("_t", F.when(c("_in.s") > 0, c("_in.small") / c("_in.s") - c("_r") * c("_r")).otherwise(-F.abs("_in.xy") + F.least("_in.small", F.lit(0.0))))
    x = x.withColumn("_w", F.when((c("_in.s") > 0) & (c("_t") > 0), F.struct((c("_in.g") / unit).alias("g"), ((c("_in.h") / unit - c("_r") * (c("_in.g") / unit)) / F.sqrt("_t")).alias("h"))))
    x = x.withColumn("_q", c("_w.g") * c("_w.g") + c("_w.h") * c("_w.h"))
    ll = (
        F.when(~(finite(c("_in.s")) & finite(c("_in.xy")) & finite(c("_in.small"))), F.lit(None).cast("double"))
        .when(~(finite(c("_in.g")) & finite(c("_in.h"))), F.lit(-INF))
        .when((c("_in.g") == 0) & (c("_in.h") == 0), F.lit(0.0))
        .when(c("_t") < -64 * EPSILON, F.lit(None).cast("double"))
        .when(finite(c("_q")), -0.5 * c("_q"))
        .otherwise(F.lit(-INF))
    )
    return x.withColumn(into, ll).drop("_in", "_r", "_t", "_w", "_q")
