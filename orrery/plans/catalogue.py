"""Registered queries of the resolution engine and their SQL.

Each function is a query over the generated tables; the text under the same name is its SQL.  Doubles are
rounded to six places on both sides, since sums have no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import checks, geo, metrics
from orrery.operators import candidates, decide, factors, graph, infer, versions, workspace
from orrery.plans import adapters
from orrery.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parameters of the flagship query.
NEW_PRIOR, NOISE_PRIOR = -1.0, -2.0
LOSSES = decide.Losses()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


# ---------------------------------------------------------------- validators and scalars


@query("""
SELECT event_id AS observation_id,
  CASE WHEN event_id % 13 = 0 THEN 'SelfSupersession' END AS observation_error,
  CASE WHEN event_id % 5 = 1 THEN 'Asymmetric' WHEN event_id % 5 = 2 THEN 'NegativeVariance'
       WHEN value * value - (value + 1) * (value + 1) < 0 AND event_id % 5 = 3 THEN 'NotPositive' END AS covariance_error,
  CASE WHEN event_id % 4 = 0 THEN 'ReservedKey' END AS key_error
FROM events""")
def obs_validate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k, v = F.col("event_id") % 5, F.col("value")
    off = F.when(k == 3, v + 1).otherwise(F.lit(0.0))
    key = F.when(F.col("event_id") % 4 == 0, F.lit("0" * 32)).otherwise(F.md5(F.col("event_id").cast("string")))
    return e.select(
        F.col("event_id").alias("observation_id"),
        checks.observation_error(F.col("event_id"), F.when(F.col("event_id") % 13 == 0, F.col("event_id"))).alias("observation_error"),
        checks.covariance_error(F.when(k == 2, -v - 1).otherwise(v), off, F.when(k == 1, F.lit(1.0)).otherwise(off), v).alias("covariance_error"),
        checks.idempotency_error(key).alias("key_error"),
    )


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR coalesce(n_chars, 0) <= 5 THEN 'EmptyMention' END AS mention_error,
  CASE WHEN doc_id % 2 = 0 AND length(coalesce(lang, '')) = 0 THEN 'EmptyKey' END AS payload_error,
  CASE WHEN length(coalesce(source, '')) = 0 THEN 'EmptyKey' END AS host_error,
  CASE WHEN doc_id % 7 = 0 THEN 'EmptyInterval' END AS interval_error,
  (doc_id >= 100 AND (doc_id % 2 = 0 OR doc_id < 500)) AS in_interval
FROM documents""")
def record_validate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        checks.mention_error(F.lit(5), F.when(i % 3 == 0, F.lit(5)).otherwise(F.coalesce("n_chars", F.lit(0)))).alias("mention_error"),
        checks.payload_error(F.when(i % 2 == 0, "external").otherwise("inline"), F.col("lang")).alias("payload_error"),
        checks.host_reference_error(F.col("source")).alias("host_error"),
        checks.interval_error(i, F.when(i % 7 == 0, i)).alias("interval_error"),
        checks.contains(F.lit(100), F.when(i % 2 == 1, F.lit(500)), i).alias("in_interval"),
    )


@query("""
WITH x AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE (value - 50) / 100 END AS x FROM events)
SELECT event_id, round(CASE WHEN isnan(x) OR x <= 0 THEN 0 WHEN x >= 1 THEN 1 ELSE x END, 6) AS saturated,
  CASE WHEN isnan(x) OR isinf(x) THEN 'NonFinite' WHEN x < 0 OR x > 1 THEN 'OutOfRange' END AS error FROM x""")
def prob_saturate(spark, sf_dir):
    x = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("inf"))).otherwise((F.col("value") - 50) / 100)
    return table(spark, sf_dir, "events").select("event_id", x.alias("x")).select("event_id", r6(checks.saturate(F.col("x"))).alias("saturated"), checks.probability_error(F.col("x")).alias("error"))


@query("""
WITH x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE least(value / 500, 1) END AS p, (value - 100) / 10 AS l FROM events)
SELECT event_id, CASE WHEN p = 0 THEN '-inf' ELSE round(ln(p), 6)::VARCHAR END = '-inf' AS is_zero,
  round(CASE WHEN p = 0 THEN 0 ELSE ln(p) END, 6) AS log_p, round(CASE WHEN l >= 0 THEN 1 ELSE exp(l) END, 6) AS p_of_l,
  CASE WHEN l > 0 THEN 'OutOfRange' END AS l_error FROM x""")
def prob_log(spark, sf_dir):
    p = F.when(F.col("event_id") % 9 == 0, F.lit(0.0)).otherwise(F.least(F.col("value") / 500, F.lit(1.0)))
    x = table(spark, sf_dir, "events").select("event_id", p.alias("p"), ((F.col("value") - 100) / 10).alias("l"))
    log = checks.to_log(F.col("p"))
    return x.select("event_id", (log == -checks.INF).alias("is_zero"), r6(F.when(log == -checks.INF, F.lit(0.0)).otherwise(log)).alias("log_p"), r6(checks.from_log(F.col("l"))).alias("p_of_l"), checks.from_log_error(F.col("l")).alias("l_error"))


@query("""
WITH x AS (SELECT event_id, epoch_us(ts) - 1704900000000001 AS us, event_id % 7 AS k FROM events)
SELECT event_id, floor(us / 1000.0)::BIGINT AS millis, ((us - ((us % 1000000) + 1000000) % 1000000) // 1000000)::BIGINT AS secs, round(us / 1e6, 6) AS secs_double,
  greatest(us, 0)::BIGINT AS since_zero, (us + k * 1000)::BIGINT AS moved,
  CASE WHEN k = 0 THEN 9223372036854775807 WHEN k = 1 THEN -9223372036854775808 ELSE k * 1000 END::BIGINT AS scaled FROM x""")
def time_floor(spark, sf_dir):
    us = adapters.micros(F.col("ts")) - F.lit(1704900000000001)
    x = table(spark, sf_dir, "events").select("event_id", us.alias("us"), (F.col("event_id") % 7).alias("k"))
    big = F.when(F.col("k") == 0, F.lit(2**63 - 1)).when(F.col("k") == 1, F.lit(-(2**63))).otherwise(F.col("k"))
    return x.select(
        "event_id",
        checks.as_millis(F.col("us")).alias("millis"),
        checks.as_secs(F.col("us")).alias("secs"),
        r6(checks.as_secs_double(F.col("us"))).alias("secs_double"),
        checks.duration_since(F.col("us"), F.lit(0).cast("long")).alias("since_zero"),
        checks.add_micros(F.col("us"), F.col("k") * 1000).alias("moved"),
        checks.from_millis(big).alias("scaled"),
    )


@query("""
SELECT o_orderkey, 'O#' || o_orderkey AS observation, 'v' || (o_orderkey + 1) AS next_version,
  CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Dormant' ELSE 'Merged' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'Promote' WHEN 1 THEN 'Merge' WHEN 2 THEN 'Dormant' WHEN 3 THEN 'Reactivate' ELSE 'Retire' END AS command,
  CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus IN ('O', 'P') THEN 'Resolved' WHEN o_orderkey % 5 = 1 THEN 'Merged'
       WHEN o_orderkey % 5 = 2 AND o_orderstatus = 'O' THEN 'Dormant' WHEN o_orderkey % 5 = 3 AND o_orderstatus = 'P' THEN 'Active'
       WHEN o_orderkey % 5 = 4 AND o_orderstatus IN ('O', 'P') THEN 'Retired' END AS after
FROM orders""")
def lifecycle_transitions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "P", "Dormant").otherwise("Merged")
    k = F.col("o_orderkey") % 5
    command = F.when(k == 0, "Promote").when(k == 1, "Merge").when(k == 2, "Dormant").when(k == 3, "Reactivate").otherwise("Retire")
    x = o.select("o_orderkey", status.alias("status"), command.alias("command"))
    return x.select("o_orderkey", checks.display("O#", F.col("o_orderkey")).alias("observation"), checks.display("v", checks.next_version(F.col("o_orderkey"))).alias("next_version"), "status", "command", checks.move(F.col("command"), F.col("status")).alias("after"))


@query("""
WITH e AS (SELECT o_custkey AS inference_id, o_orderkey % 4 AS outcome, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey) AS p, count(*) AS n
  FROM orders GROUP BY 1, 2)
SELECT inference_id, CASE WHEN inference_id % 3 = 0 THEN 'DuplicateOutcome' WHEN NOT bool_or(outcome = 1) OR NOT bool_or(outcome = 2) THEN 'MissingOutcome'
  WHEN inference_id % 3 = 1 THEN 'NotNormalized' END AS error FROM e GROUP BY inference_id""")
def distribution_validate(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("inference_id"), (F.col("o_orderkey") % 4).alias("outcome_rank")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("inference_id").agg(F.sum("n").alias("t"))
    e = n.join(total, "inference_id").withColumn("p", F.col("n") / F.col("t") * F.when(F.col("inference_id") % 3 == 1, 0.5).otherwise(1.0)).withColumn("outcome_key", F.col("outcome_rank").cast("string"))
    twice = e.where("inference_id % 3 = 0")
    return checks.distribution_errors(e.unionByName(twice))


@query("""
WITH p AS (SELECT conv_id AS plan_id, role AS part, turn // 2 AS id FROM conversations),
a AS (SELECT plan_id, count(DISTINCT part) AS parts FROM p GROUP BY 1),
b AS (SELECT plan_id, max(n) AS most FROM (SELECT plan_id, id, count(DISTINCT part) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT plan_id, CASE WHEN parts < 2 THEN 'TooFewPartitions' WHEN most > 1 THEN 'Overlap' END AS error FROM a JOIN b USING (plan_id)""")
def split_validate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return checks.split_errors(c.select(F.col("conv_id").alias("plan_id"), F.col("role").alias("part"), F.lit("identity").alias("kind"), F.floor(F.col("turn") / 2).alias("id")))


@query("""
WITH x AS (SELECT *, event_id % 6 AS k FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 'UnknownSemantics' WHEN k = 1 THEN 'NonFinite' WHEN k = 2 AND (value < 0 OR value > 100) THEN 'OutOfRange' WHEN k = 3 THEN 'EmptyDomain' END AS contribution_error,
  event_id % 5 < 4 AS keeps_marginal, CASE WHEN value < 50 THEN 'false_assign' WHEN k = 4 THEN 'false_noise' END AS loss_error, CASE WHEN user_id = event_id % 50 THEN 'SelfMerge' END AS merge_error,
  CASE WHEN event_id % 3 = 0 THEN 'EmptyEnvelope' END AS envelope_error, CASE WHEN k = 1 THEN 'NonFiniteLatitude' WHEN abs(value * 2 - 100) > 90 THEN 'LatitudeRange' WHEN k = 5 THEN 'LongitudeRange' END AS point_error,
  round(CASE WHEN k = 1 THEN 0 ELSE greatest(least(value * 2 - 100, 90), -90) END, 6) + 0.0 AS latitude, CASE WHEN k = 1 THEN 'NonFiniteMean' END AS mean_error,
  CASE WHEN event_id % 4 = 0 THEN 'EmptyDimension' WHEN value <= 0 THEN 'InvalidThroughput' WHEN event_id % 3 < 2 THEN 'LatencyOrder' END AS scale_error, CASE WHEN event_id % 7 > 4 THEN 'OverCapacity' END AS history_error,
  round(ln(exp(value / 100) + exp(1.0) + 1), 6) AS log_sum
FROM x""")
def model_validate(spark, sf_dir):
    e, k, v = table(spark, sf_dir, "events"), F.col("event_id") % 6, F.col("value")
    nan = lambda c: F.when(k == 1, F.lit(float("nan"))).otherwise(c)
    treatment = F.element_at(F.array(*map(F.lit, ("Global", "ExactInduced", "NoCrossBoundary", "ConstantInduced", "Conditional"))), (F.col("event_id") % 5 + 1).cast("int"))
    lat, lon = nan(v * 2 - 100), F.when(k == 5, F.lit(181.0)).otherwise(F.lit(1.0))
    one = F.lit(1.0)
    return e.select(
        "event_id",
        checks.contribution_error(nan(v / 100), F.when(k == 0, "Odd").when(k == 2, "CalibratedPosterior").otherwise("LogPotential"), F.when(k == 3, "").otherwise("events")).alias("contribution_error"),
        checks.keeps_global_marginal(treatment).alias("keeps_marginal"),
        checks.loss_error(v - 50, one, F.when(k == 4, -one).otherwise(one), one).alias("loss_error"),
        checks.merge_error(F.col("user_id"), F.col("event_id") % 50).alias("merge_error"),
        checks.envelope_error(F.array_repeat(F.lit("command"), (F.col("event_id") % 3).cast("int"))).alias("envelope_error"),
        geo.point_error(lat, lon).alias("point_error"),
        r6(geo.point(lat, lon)["lat"]).alias("latitude"),
        geo.mean2d_error(lat, lon).alias("mean_error"),
        metrics.scale_error([F.col("event_id") % 4], v, one, F.lit(2.0), F.col("event_id") % 3 * one).alias("scale_error"),
        workspace.history_error(4, F.col("event_id") % 7).alias("history_error"),
        r6(infer.log_sum_exp(F.array(v / 100, one, F.lit(0.0)))).alias("log_sum"),
    )


# ---------------------------------------------------------------- spatial

# a pair for each order line, of its customer and its supplier: as many as lines, whatever a nation holds
_POINTS = """c AS (SELECT c_custkey, (c_custkey * 37 % 180) - 90.0::DOUBLE AS lat, (c_custkey * 91 % 360) - 180.0::DOUBLE AS lon FROM customer),
s AS (SELECT s_suppkey, (s_suppkey * 37 % 180) - 90.0::DOUBLE AS lat, (s_suppkey * 91 % 360) - 180.0::DOUBLE AS lon FROM supplier),
h AS (SELECT l_orderkey, l_linenumber, c_custkey, s_suppkey, least(greatest(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2), 0), 1) AS a
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey JOIN s ON l_suppkey = s_suppkey),
d AS (SELECT l_orderkey, l_linenumber, c_custkey, s_suppkey, 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) AS m FROM h)"""
_PAIR = ("l_orderkey", "l_linenumber", "c_custkey", "s_suppkey")


def _distances(spark, sf_dir):
    c, s = adapters.points(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    pairs = lines.join(orders, "l_orderkey").join(c, "c_custkey").join(s.toDF("s_suppkey", "lat2", "lon2"), "s_suppkey")
    return pairs.select(*_PAIR, geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("m"))


@query(f"WITH {_POINTS} SELECT {', '.join(_PAIR)}, round(m / 1000, 3) AS km FROM d")
def geo_haversine(spark, sf_dir):
    """How far is the customer of an order line from its supplier?"""
    return _distances(spark, sf_dir).select(*_PAIR, (F.round(F.col("m") / 1000, 3) + 0.0).alias("km"))


@query(f"""WITH {_POINTS} SELECT {', '.join(_PAIR)}, CASE WHEN c_custkey % 10 = 0 THEN CASE WHEN m <= 2.220446049250313e-16 THEN 0.0 ELSE -1.0 END
  ELSE round(-0.5 * pow(m / sqrt(pow(1e6 * (c_custkey % 10), 2) + 1e12), 2), 6) + 0.0 END AS ll FROM d""")
def geo_isotropic_ll(spark, sf_dir):
    k = F.col("c_custkey") % 10
    ll = geo.isotropic_log_likelihood(F.col("m"), geo.accuracy(k * 1e6), F.when(k == 0, F.lit(0.0)).otherwise(F.lit(1e6)))
    return _distances(spark, sf_dir).select(*_PAIR, F.when(ll == -checks.INF, F.lit(-1.0)).otherwise(r6(ll)).alias("ll"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25 AS dx, l_discount * 100 - 5 AS dy, 1.1::DOUBLE + l_linenumber AS xx, l_tax * 10 AS xy, 2.1::DOUBLE AS yy FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE round(-0.5 * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / (xx * yy - xy * xy), 6) + 0.0 END AS ll,
  CASE WHEN abs(xy) > sqrt(xx) * sqrt(yy) THEN 'CorrelationRange' END AS error FROM x""")
def gauss2d_ll(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") - 25).alias("dx"), (F.col("l_discount") * 100 - 5).alias("dy"), (F.col("l_linenumber") + 1.1).alias("xx"), (F.col("l_tax") * 10).alias("xy"), F.lit(2.1).alias("yy"))
    c = [F.col(n) for n in ("dx", "dy", "xx", "xy", "yy")]
    return geo.gaussian_log_likelihood(x, *c).select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("ll")).alias("ll"), geo.covariance2d_error(*c[2:]).alias("error"))


# ---------------------------------------------------------------- candidates, factors, posteriors, decisions


def _gated(spark, sf_dir, *keep):
    n = adapters.blocks(spark, sf_dir)
    return candidates.gate(adapters.observations(spark, sf_dir), adapters.identities(spark, sf_dir), F.col("user_id") % n, F.col("identity_id") % n, keep)


_GATED = f"""blocks AS (SELECT {adapters.BLOCKS_SQL} AS n), keyed AS (SELECT event_id AS observation_id, user_id % n AS b FROM events, blocks),
gated AS (SELECT DISTINCT observation_id, u.identity_id FROM keyed LEFT JOIN (SELECT DISTINCT user_id AS identity_id, user_id % n AS b FROM events, blocks) u ON keyed.b = u.b)"""


@query(f"WITH {_GATED} SELECT observation_id, identity_id FROM gated")
def candidate_gate(spark, sf_dir):
    return _gated(spark, sf_dir)


@query("""
WITH a AS (SELECT o_orderkey AS observation_id, c_custkey AS identity_id FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_orderkey % 1000 = c_custkey)
SELECT observation_id, count(*) AS n, min(identity_id) AS first_candidate, max(identity_id) AS last_candidate FROM a GROUP BY 1""")
def candidate_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("observation_id"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity_id"))
    every = candidates.union(candidates.gate(o, c, F.col("o_custkey"), F.col("identity_id")), candidates.gate(o, c, F.col("observation_id") % 1000, F.col("identity_id")))
    g = candidates.groups(every).where(F.size("candidates") > 0)
    return g.select("observation_id", F.size("candidates").cast("long").alias("n"), F.element_at("candidates", 1).alias("first_candidate"), F.element_at("candidates", -1).alias("last_candidate"))


@query("""SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'EmptyScope' WHEN 2 THEN 'DuplicateVariable' WHEN 3 THEN 'InvalidCardinality'
  WHEN 4 THEN 'TableLength' ELSE 'NonFinitePotential' END AS error FROM embeddings""")
def factor_check(spark, sf_dir):
    k = F.col("vec_id") % 6
    longs = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    ints = lambda *x: F.array(*[F.lit(v).cast("int") for v in x])
    variables = F.when(k == 1, F.array().cast("array<long>")).when(k == 2, longs(1, 1)).otherwise(longs(0, 1))
    cards = F.when(k == 1, F.array().cast("array<int>")).when(k == 3, ints(0, 8)).when(k == 4, ints(8, 7)).otherwise(ints(8, 8))
    values = F.col("embedding").cast("array<double>")
    values = F.when(k == 5, F.concat(F.slice(values, 1, 63), F.array(F.lit(-checks.INF)))).otherwise(values)
    return table(spark, sf_dir, "embeddings").select("vec_id", factors.factor_error(variables, cards, values).alias("error"))


def _score(identity):
    """Of a user for an event: closeness of the event's value to twice the user's number.

    The formula is fixed, to nine places, so that scores which are equal by it are equal in any arithmetic.
    """
    score = -F.abs(F.col("value") - 2 * identity) / 20 + F.when(identity == F.col("user_id"), 1.0).otherwise(0.0)
    return F.floor(score * 1e9 + 0.5) / 1e9


def _entries(spark, sf_dir):
    """Scores of every outcome of every event: its gated users, New and Noise."""
    o = adapters.observations(spark, sf_dir).select("observation_id", "user_id", "value")
    known = _gated(spark, sf_dir, "user_id", "value").where("identity_id IS NOT NULL")
    known = known.select(F.col("observation_id").alias("inference_id"), F.lit(0).alias("outcome_rank"), "identity_id", _score(F.col("identity_id")).alias("score"))
    rest = o.select(F.col("observation_id").alias("inference_id"), F.inline(F.array(*[F.struct(F.lit(r).alias("outcome_rank"), F.lit(None).cast("long").alias("identity_id"), F.lit(s).alias("score")) for r, s in ((1, NEW_PRIOR), (2, NOISE_PRIOR))])))
    return known.unionByName(rest)


def _posterior(spark, sf_dir):
    return infer.softmax(_entries(spark, sf_dir), ["inference_id"], "score")


_ENTRIES = f"""{_GATED},
entries AS (SELECT g.observation_id AS inference_id, 0 AS outcome_rank, g.identity_id,
    floor((-abs(value - 2 * g.identity_id) / 20 + CASE WHEN g.identity_id = user_id THEN 1.0 ELSE 0.0 END) * 1e9 + 0.5) / 1e9 AS score
  FROM gated g JOIN events ON event_id = g.observation_id WHERE g.identity_id IS NOT NULL
  UNION ALL SELECT event_id, 1, NULL, {NEW_PRIOR} FROM events UNION ALL SELECT event_id, 2, NULL, {NOISE_PRIOR} FROM events),
post AS (SELECT *, exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w AS p FROM (SELECT *, max(score) OVER (PARTITION BY inference_id) AS m FROM entries) WINDOW w AS (PARTITION BY inference_id))"""

_RISKS = f"""{_ENTRIES},
risks AS (SELECT a.inference_id, CASE a.outcome_rank WHEN 0 THEN 'assign' WHEN 1 THEN 'new' ELSE 'noise' END AS action, a.identity_id,
    {LOSSES.false_assign} * (sum(p) OVER (PARTITION BY inference_id) - p) AS risk, CASE a.outcome_rank WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS tie FROM post a
  UNION ALL SELECT event_id, 'abstain', NULL, {LOSSES.abstain}, 3 FROM events)"""


@query(f"WITH {_ENTRIES} SELECT inference_id, outcome_rank, coalesce(identity_id, -1) AS identity_id, round(p, 6) AS p FROM post")
def unary_posterior(spark, sf_dir):
    return _posterior(spark, sf_dir).select("inference_id", "outcome_rank", F.coalesce("identity_id", F.lit(-1).cast("long")).alias("identity_id"), r6(F.col("p")).alias("p"))


@query(f"WITH {_RISKS} SELECT inference_id, action, coalesce(identity_id, -1) AS identity_id, round(risk, 6) AS risk FROM risks")
def expected_loss(spark, sf_dir):
    return decide.risks(_posterior(spark, sf_dir), LOSSES).select("inference_id", "action", F.coalesce("identity_id", F.lit(-1).cast("long")).alias("identity_id"), r6(F.col("risk")).alias("risk"))


@query(f"""WITH {_RISKS}, best AS (SELECT *, row_number() OVER (PARTITION BY inference_id ORDER BY round(risk, 9), tie, coalesce(identity_id, -1)) AS k FROM risks)
SELECT inference_id, action, coalesce(identity_id, -1) AS identity_id, round(risk, 6) AS risk FROM best WHERE k = 1""")
def bayes_decide(spark, sf_dir):
    """For each event: which known user is it, or is it new, or noise?"""
    d = decide.decide(_posterior(spark, sf_dir), LOSSES)
    return d.select("inference_id", "action", F.coalesce("identity_id", F.lit(-1).cast("long")).alias("identity_id"), r6(F.col("risk")).alias("risk"))


#: Conversations as graphs: a variable for each turn; its number holds both.
TURN_SPAN = 1_000_000
_TURNS = f"""t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, conv_id * {TURN_SPAN} + turn AS v FROM conversations)"""
CONFIG = infer.Config(new_prior=-1.0, noise_prior=-2.0)


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("batch_id"), (F.col("conv_id") * TURN_SPAN + F.col("turn")).alias("variable"), F.lit(1).alias("candidates"), F.length(F.coalesce("text", F.lit(""))).alias("n"), "turn")


def _unary(t):
    values = F.array((F.col("n") % 7 / -2.0), (F.col("n") % 3 / -1.0), F.lit(-0.5))
    return t.select("batch_id", F.col("variable").alias("factor_id"), F.array("variable").alias("variables"), F.array(F.lit(3)).alias("cardinalities"), values.alias("log_potentials"))


def _pair(t, step, weight):
    a = t.select("batch_id", F.col("variable").alias("a"), "turn")
    b = t.select("batch_id", F.col("variable").alias("b"), (F.col("turn") - step).alias("turn"))
    table_ = F.array(*[F.lit(0.0 if i == j else -weight) for i in range(3) for j in range(3)])
    return a.join(b, ["batch_id", "turn"]).select("batch_id", (F.col("a") + 10**15 * step).alias("factor_id"), F.array("a", "b").alias("variables"), F.array(F.lit(3), F.lit(3)).alias("cardinalities"), table_.alias("log_potentials"))


# forward and backward sums along each run of consecutive turns, scaled at every turn
@query(f"""WITH RECURSIVE {_TURNS}, u AS (SELECT conv_id, turn, v, exp(0.0 - (n % 7) / 2.0) AS e0, exp(-1.0 - (n % 3)) AS e1, exp(-2.5) AS e2 FROM t),
fw AS (SELECT u.*, e0 AS a0, e1 AS a1, e2 AS a2 FROM u ANTI JOIN (SELECT conv_id, turn + 1 AS turn FROM t) p ON p.conv_id = u.conv_id AND p.turn = u.turn
  UNION ALL SELECT u.*, u.e0 * (a0 + exp(-2.0) * (a1 + a2)) / (a0 + a1 + a2), u.e1 * (a1 + exp(-2.0) * (a0 + a2)) / (a0 + a1 + a2), u.e2 * (a2 + exp(-2.0) * (a0 + a1)) / (a0 + a1 + a2)
  FROM fw JOIN u ON u.conv_id = fw.conv_id AND u.turn = fw.turn + 1),
bw AS (SELECT u.*, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM u ANTI JOIN (SELECT conv_id, turn - 1 AS turn FROM t) p ON p.conv_id = u.conv_id AND p.turn = u.turn
  UNION ALL SELECT u.*, (bw.e0 * b0 + exp(-2.0) * (bw.e1 * b1 + bw.e2 * b2)) / (b0 + b1 + b2), (bw.e1 * b1 + exp(-2.0) * (bw.e0 * b0 + bw.e2 * b2)) / (b0 + b1 + b2), (bw.e2 * b2 + exp(-2.0) * (bw.e0 * b0 + bw.e1 * b1)) / (b0 + b1 + b2)
  FROM bw JOIN u ON u.conv_id = bw.conv_id AND u.turn = bw.turn - 1),
m AS (SELECT fw.v, unnest([0, 1, 2]) AS state, unnest([a0 * b0, a1 * b1, a2 * b2]) AS w, a0 * b0 + a1 * b1 + a2 * b2 AS z FROM fw JOIN bw ON fw.v = bw.v)
SELECT v AS variable, state, round(w / z, 6) AS p, 'Exact' AS reason FROM m""")
def pair_posterior_exact(spark, sf_dir):
    """All turns of each conversation, with a pair factor for each two consecutive ones: chains, solved exactly."""
    t = _turns(spark, sf_dir)
    p = infer.posteriors(t, _unary(t).unionByName(_pair(t, 1, 2.0)), CONFIG)
    return p.select("variable", "state", r6(F.col("p")).alias("p"), "reason")


@query()
def loopy_posterior(spark, sf_dir):
    """All turns, in cycles of three: damped iterations for each conversation."""
    t = _turns(spark, sf_dir)
    p = infer.posteriors(t, _unary(t).unionByName(_pair(t, 1, 1.0)).unionByName(_pair(t, 2, 0.5)), CONFIG)
    return p.select("group_id", "variable", "state", r6(F.col("p")).alias("p"), "iterations", "reason")


# ---------------------------------------------------------------- versioned reads


@query("""
WITH d AS (SELECT o_orderkey AS decision_id, o_custkey AS observation_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders),
i AS (SELECT *, lead(version) OVER (PARTITION BY observation_id ORDER BY version) AS valid_to FROM d)
SELECT c_custkey AS observation_id, c_custkey % 12 + 1 AS as_of, decision_id FROM customer JOIN i ON c_custkey = observation_id AND version <= c_custkey % 12 + 1 AND (valid_to IS NULL OR c_custkey % 12 + 1 < valid_to)""")
def decision_as_of(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("observation_id"), (F.col("c_custkey") % 12 + 1).alias("as_of"))
    return versions.as_of(adapters.decisions(spark, sf_dir), asked).select("observation_id", "as_of", "decision_id")


@query("SELECT o_custkey AS observation_id, max(o_orderkey) AS decision_id, count(*) AS version FROM orders GROUP BY 1")
def current_decision(spark, sf_dir):
    return versions.current(adapters.decisions(spark, sf_dir).select("observation_id", "version", "decision_id")).select("observation_id", "decision_id", "version")


@query("""SELECT event_id AS observation_id, epoch_us(ts) AS event_time, event_id // 1000 + 1 AS version FROM events
WHERE epoch_us(ts) <= 1705500000000000 AND event_id // 1000 + 1 <= 6 ORDER BY 1""")
def observations_as_of(spark, sf_dir):
    return versions.observations_as_of(adapters.observations(spark, sf_dir).select("observation_id", "event_time", "version"), 1705500000000000, 6)


@query("""WITH v AS (SELECT event_id // 1000 + 1 AS version, count(*) AS commands FROM events GROUP BY 1)
SELECT version, commands, version = row_number() OVER (ORDER BY version) AS contiguous, version = (SELECT max(version) FROM v) AS latest FROM v""")
def ledger_replay_contiguity(spark, sf_dir):
    # one row for each commit
    return versions.contiguous(adapters.observations(spark, sf_dir).groupBy("version").agg(F.count(F.lit(1)).alias("commands")))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS observation_id, l_orderkey * 10 + l_linenumber AS decision_id, l_linenumber::BIGINT AS version FROM lineitem)
SELECT *, CASE WHEN version = 3 THEN least(lead(version) OVER w, 8) ELSE lead(version) OVER w END AS valid_to FROM d WINDOW w AS (PARTITION BY observation_id ORDER BY version)""")
def ledger_history(spark, sf_dir):
    """Decisions of seven commits of tables to a ledger, one of them reverted: when did each of them hold?

    Each order is an observation, each of its line numbers a newer decision on it.
    """
    import uuid

    from orrery.operators.ledger import Envelope, Ledger
    from orrery.session import scratch
    from orrery.sources.kv import FolderBackend

    root = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    ledger = Ledger(FolderBackend(spark, f"{root}/manifests"))
    x = table(spark, sf_dir, "lineitem")
    lines = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("decision_id"), F.col("l_orderkey").cast("long").alias("observation_id"), F.lit("assign").alias("action"), F.col("l_partkey").cast("long").alias("identity_id"), "l_linenumber").dropDuplicates(["decision_id"])
    for k in range(1, 8):
        ledger.commit_tables(f"{root}/tables", {"decisions": lines.where(F.col("l_linenumber") == k).drop("l_linenumber")}, k, f"{k:032x}", k)
    ledger.commit(Envelope(100, ledger.version, f"{100:032x}", 8, ({"kind": "Revert", "target": 3, "mode": "Strict"},)))
    again = Ledger(FolderBackend(spark, f"{root}/manifests"))  # what a restart finds
    return versions.intervals(again.decisions(spark)).select("observation_id", "decision_id", "version", "valid_to")


# ---------------------------------------------------------------- merges, splits, dependencies

_MERGES = """k AS (SELECT doc_id, lower(coalesce(text, '')) AS k FROM documents),
m AS (SELECT doc_id, k, lag(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS b FROM k)"""


def _merges(spark, sf_dir):
    """Documents of one whole text, but for case, are merged in a chain; the decision is named by the later one."""
    key = F.sha2(F.lower(F.coalesce("text", F.lit(""))), 256)
    w = Window.partitionBy("k").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("k")).select("doc_id", F.lag("doc_id").over(w).alias("b"))


def _canonical(spark, sf_dir, merges):
    named = graph.connected_components(merges.where("b IS NOT NULL").select(F.col("doc_id").alias("a"), "b"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("identity_id"))
    x = d.join(named, d["identity_id"] == named["node"], "left")
    return x.select("identity_id", F.coalesce("component", "identity_id").alias("canonical_id"), F.when(F.coalesce("component", "identity_id") == F.col("identity_id"), "Active").otherwise("Merged").alias("status"))


@query(f"WITH {_MERGES} SELECT doc_id AS identity_id, min(doc_id) OVER (PARTITION BY k) AS canonical_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY k) THEN 'Active' ELSE 'Merged' END AS status FROM m")
def merge_canonical(spark, sf_dir):
    return _canonical(spark, sf_dir, _merges(spark, sf_dir))


@query(f"""WITH {_MERGES}, s AS (SELECT doc_id, k, sum(CASE WHEN b IS NULL OR doc_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY doc_id) AS part FROM m)
SELECT doc_id AS identity_id, min(doc_id) OVER (PARTITION BY k, part) AS canonical_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY k, part) THEN 'Active' ELSE 'Merged' END AS status FROM s""")
def split_effect(spark, sf_dir):
    """A third of the merges are closed; classes are those of the merges that stay open."""
    return _canonical(spark, sf_dir, _merges(spark, sf_dir).where("doc_id % 3 <> 0"))


_CHAIN = """c AS (SELECT o_orderkey AS txn, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
hit AS (SELECT txn, o_custkey, p, bool_or(txn % 50 = 0) OVER (PARTITION BY o_custkey ORDER BY txn) AS h FROM c)"""


def _reverted(spark, sf_dir):
    d = adapters.dependencies(spark, sf_dir)
    roots = d.where("txn % 50 = 0").select(F.col("txn").alias("node"))
    return d, graph.closure(d.select(F.col("depends_on").alias("a"), F.col("txn").alias("b")), roots).withColumnRenamed("node", "txn")


@query(f"WITH {_CHAIN} SELECT txn FROM hit WHERE h")
def dependency_closure(spark, sf_dir):
    return _reverted(spark, sf_dir)[1]


_DAG = """e AS (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, o_orderkey AS txn FROM orders
  UNION SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey), o_orderkey FROM orders),
reached AS (SELECT o_orderkey AS txn FROM orders WHERE o_orderkey % 200 = 0 UNION SELECT e.txn FROM reached JOIN e ON e.p = reached.txn)"""


@query(f"WITH RECURSIVE {_DAG} SELECT txn FROM reached")
def dependency_closure_dag(spark, sf_dir):
    """Transactions with two parents: the customer's order before, and the one before of the same priority."""
    o = table(spark, sf_dir, "orders")
    before = [F.lag("o_orderkey").over(Window.partitionBy("o_custkey", *by).orderBy("o_orderkey")) for by in ((), ("o_orderpriority",))]
    e = o.select(F.array(*before).alias("a"), F.col("o_orderkey").alias("b")).select(F.explode("a").alias("a"), "b")
    return graph.closure(e, o.where("o_orderkey % 200 = 0").select(F.col("o_orderkey").alias("node"))).withColumnRenamed("node", "txn")


@query(f"WITH {_CHAIN} SELECT o_custkey AS customer, count(*) FILTER (WHERE NOT h) AS active, count(*) FILTER (WHERE h) AS reverted, max(CASE WHEN NOT h THEN txn END) AS last_active FROM hit GROUP BY 1")
def cascade_revert(spark, sf_dir):
    d, gone = _reverted(spark, sf_dir)
    x = d.join(gone.withColumn("gone", F.lit(True)), "txn", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return x.groupBy("customer").agg(F.count_if(~F.col("gone")).alias("active"), F.count_if("gone").alias("reverted"), F.max(F.when(~F.col("gone"), F.col("txn"))).alias("last_active"))


@query(f"WITH {_CHAIN} SELECT a.txn, CASE WHEN b.txn IS NOT NULL THEN 'DependentActive' END AS error FROM hit a LEFT JOIN hit b ON b.p = a.txn WHERE a.txn % 50 = 0")
def strict_check(spark, sf_dir):
    """A strict revert looks at direct dependents only."""
    d = adapters.dependencies(spark, sf_dir)
    roots = d.where("txn % 50 = 0").select("txn")
    direct = d.where("depends_on IS NOT NULL").select(F.col("depends_on").alias("txn")).distinct().withColumn("has", F.lit(True))
    return roots.join(direct, "txn", "left").select("txn", F.when(F.col("has"), "DependentActive").alias("error"))


# ---------------------------------------------------------------- outbox, host graph, workspace, history


@query("""SELECT o.o_orderkey AS materialization_id, o.o_custkey AS decision_id FROM orders o ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') r ON o.o_orderkey = r.o_orderkey WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def outbox_pending(spark, sf_dir):
    from orrery.operators import outbox

    o = table(spark, sf_dir, "orders")
    box = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("materialization_id"), F.col("o_custkey").alias("decision_id"))
    receipts = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("materialization_id"), F.col("o_custkey").alias("decision_id"))
    return outbox.pending(box, receipts)


_HOST = """r AS (SELECT event_id AS seq, event_id % 700 AS mid, CASE WHEN event_type = 'error' THEN 'Occur' ELSE 'Influence' END AS role, user_id % 40 AS target, user_id AS src FROM events),
v AS (SELECT *, src % 50 <> 0 AS has_src, target IN (SELECT n_nationkey FROM nation) AS has_target FROM r),
f AS (SELECT mid, min(seq) AS seq FROM v WHERE has_src AND has_target GROUP BY 1),
p AS (SELECT f.mid, f.seq, r.role, r.target, r.src FROM f JOIN r ON r.seq = f.seq),
o AS (SELECT v.seq, v.mid, v.target, CASE WHEN p.seq IS NOT NULL AND v.seq = p.seq THEN 'Inserted' WHEN p.seq < v.seq THEN CASE WHEN p.role = v.role AND p.target = v.target AND p.src = v.src THEN 'Replayed' ELSE 'Collision' END
  WHEN NOT has_src THEN 'MissingSource' ELSE 'MissingTarget' END AS outcome FROM v LEFT JOIN p ON p.mid = v.mid)"""


def _host(spark, sf_dir):
    """Two batches one after the other: the second half of the events finds the edges of the first."""
    from orrery.operators import hostgraph

    e = table(spark, sf_dir, "events")
    requests = e.select(F.col("event_id").alias("seq"), (F.col("event_id") % 700).alias("materialization_id"), F.when(F.col("event_type") == "error", "Occur").otherwise("Influence").alias("role"), F.col("user_id").alias("source"), (F.col("user_id") % 40).alias("target"))
    sources = e.where("user_id % 50 <> 0").select(F.col("user_id").alias("node")).distinct()
    targets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    nodes = sources.withColumn("kind", F.lit("Event")).unionByName(targets.withColumn("kind", F.lit("Physical")))
    middle = e.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2)).first()[0] or 0
    one = written(hostgraph.materialize(requests.where(F.col("seq") <= middle), nodes), "batch")
    return one.unionByName(hostgraph.materialize(requests.where(F.col("seq") > middle), nodes, hostgraph.inserted(one)))


@query(f"WITH {_HOST} SELECT seq, mid AS materialization_id, outcome FROM o")
def host_materialize(spark, sf_dir):
    return _host(spark, sf_dir).select("seq", "materialization_id", "outcome")


@query(f"WITH {_HOST} SELECT target AS node, count(*) AS incoming FROM o WHERE outcome = 'Inserted' GROUP BY 1")
def host_incoming_degree(spark, sf_dir):
    return _host(spark, sf_dir).where("outcome = 'Inserted'").groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))


@query("SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5")
def history_last_k(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("identity_id"), F.col("event_id").alias("version"))
    h = workspace.bounded_history(e, 5)
    return h.select(F.col("identity_id").alias("user_id"), F.posexplode(F.reverse("history")).alias("p", "event_id")).select("user_id", "event_id", (F.col("p") + 1).cast("long").alias("k"))


_WORK = """a AS (SELECT user_id AS identity_id, max(event_id // 100) AS version, max(epoch_us(ts)) AS last_activation, count(DISTINCT event_id // 100) AS commits FROM events GROUP BY 1)"""


def _workspace(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("identity_id"), F.floor(F.col("event_id") / 100).alias("version"), adapters.micros(F.col("ts")).alias("activation"), F.col("event_id").alias("decision_id"))
    return workspace.apply_committed(e, capacity=4)


@query(f"WITH {_WORK} SELECT identity_id, version, last_activation, commits, least(commits, 4) AS kept FROM a")
def workspace_apply(spark, sf_dir):
    return _workspace(spark, sf_dir).select("identity_id", "version", "last_activation", "commits", F.size("history").cast("long").alias("kept"))


@query(f"WITH {_WORK} SELECT identity_id, last_activation, last_activation < 1706550000000000 AS evicted FROM a")
def workspace_evict(spark, sf_dir):
    kept, gone = workspace.evict_before(_workspace(spark, sf_dir), 1706550000000000)
    return gone.withColumn("evicted", F.lit(True)).unionByName(kept.withColumn("evicted", F.lit(False))).select("identity_id", "last_activation", "evicted")


# ---------------------------------------------------------------- metrics and export


@query("""
WITH c AS (SELECT doc_id % 50 AS truth, doc_id % 75 AS predicted FROM documents),
b AS (SELECT sum(n * (n - 1) / 2) AS tp FROM (SELECT count(*) AS n FROM c GROUP BY truth, predicted)),
t AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM c GROUP BY truth)), p AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM c GROUP BY predicted))
SELECT tp::BIGINT AS tp, (p - tp)::BIGINT AS fp, (t - tp)::BIGINT AS fn, round(tp / p, 6) AS "precision", round(tp / t, 6) AS recall, round(2 * (tp / p) * (tp / t) / (tp / p + tp / t), 6) AS f1 FROM b, t, p""")
def pairwise_prf(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("truth"), (F.col("doc_id") % 75).alias("predicted"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return metrics.pairwise_counts(c).select("tp", "fp", "fn", r6(metrics.precision(tp, fp)).alias("precision"), r6(metrics.recall(tp, fn)).alias("recall"), r6(metrics.f1(tp, fp, fn)).alias("f1"))


_SAMPLES = "s AS (SELECT least(greatest(n_chars / 5000.0, 0.01), 0.99)::DOUBLE AS p, quality = 1 AS outcome FROM documents JOIN labels USING (doc_id))"


def _samples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.least(F.greatest(F.col("n_chars") / 5000.0, F.lit(0.01)), F.lit(0.99)).alias("p"), (F.col("quality") == 1).alias("outcome"))


@query(f"""WITH {_SAMPLES}, x AS (SELECT p, outcome::INT AS y, least(floor(p * 10), 9) AS bin FROM s),
b AS (SELECT bin, count(*) AS n, sum(p) AS p, sum(y) AS y, sum(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS nll, sum((p - y) * (p - y)) AS brier FROM x GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(nll) / sum(n), 6) AS nll, round(sum(brier) / sum(n), 6) AS brier, round(sum(abs(p - y)) / sum(n), 6) AS ece FROM b""")
def calibration(spark, sf_dir):
    return metrics.calibration(_samples(spark, sf_dir), 10).select("n", *[r6(F.col(c)).alias(c) for c in ("nll", "brier", "ece")])


@query(f"WITH {_SAMPLES} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(outcome::INT), 6) AS rate FROM s GROUP BY 1")
def reliability_diagram(spark, sf_dir):
    return metrics.reliability(_samples(spark, sf_dir), 10).select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("rate")).alias("rate"))


@query("""
WITH c AS (SELECT doc_id % 50 AS truth, doc_id % 75 AS predicted FROM documents), x AS (SELECT truth, predicted, count(*) AS n FROM c GROUP BY ALL),
y AS (SELECT n, sum(n) OVER (PARTITION BY truth) AS nt, sum(n) OVER (PARTITION BY predicted) AS np FROM x)
SELECT round(sum(n * n / np) / sum(n), 6) AS "precision", round(sum(n * n / nt) / sum(n), 6) AS recall FROM y""")
def b_cubed(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("truth"), (F.col("doc_id") % 75).alias("predicted"))
    return metrics.b_cubed(c).select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("""
WITH c AS (SELECT doc_id % 50 AS truth, doc_id % 75 AS predicted FROM documents),
b AS (SELECT sum(n * (n - 1) / 2) AS tp FROM (SELECT count(*) AS n FROM c GROUP BY truth, predicted)),
t AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM c GROUP BY truth)), p AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM c GROUP BY predicted)),
a AS (SELECT count(*) * (count(*) - 1) / 2 AS a FROM c)
SELECT round((tp - t * p / a) / ((t + p) / 2 - t * p / a), 6) AS adjusted_rand FROM b, t, p, a""")
def adjusted_rand(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("truth"), (F.col("doc_id") % 75).alias("predicted"))
    return metrics.adjusted_rand(c).select(r6(F.col("adjusted_rand")).alias("adjusted_rand"))


@query("""
SELECT item_id, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS escaped,
  lower(hex(text)) AS hex_text, item_id % 2 = 0 AS valid_iri FROM benchmark""")
def rdf_escape(spark, sf_dir):
    from orrery.functions import rdf

    iri = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("urn:item:"), F.col("item_id").cast("string"))).otherwise(F.lit("not an iri"))
    return table(spark, sf_dir, "benchmark").select("item_id", rdf.literal(F.col("text")).alias("escaped"), rdf.hex_bytes(F.col("text").cast("binary")).alias("hex_text"), rdf.is_absolute_iri(iri).alias("valid_iri"))


_BASE = "urn:orrery:"
#: Events of one task of the export, about: each has some 300 lines.
EXPORT_ROWS = 10_000


@query(f"""
SELECT event_id AS observation_id, '<{_BASE}observation/' || event_id || '> a prov:Entity, li:Observation ; li:source 1 ; li:eventTime ' || epoch_us(ts) || ' ; li:ingestionTime '
  || (epoch_us(ts) + (event_id % 7) * 1000000) || ' ; li:contentHash "' || sha256(props) || '" .' AS line FROM events""")
def rdf_observations(spark, sf_dir):
    from orrery.functions import rdf

    return adapters.observations(spark, sf_dir).select("observation_id", rdf.observation_line(_BASE).alias("line"))


@query()
def rdf_decisions(spark, sf_dir):
    """Whole records as Turtle lines: observation, inference, provider, scores, alternatives, decision.

    The one provider scores known users by ``_entries``; New and Noise are priors, not contributions.
    """
    from orrery.functions import rdf

    n = adapters.blocks(spark, sf_dir)
    e = table(spark, sf_dir, "events").withColumn("observation_id", F.col("event_id"))
    # with fewer parts than the session's, adaptive execution was seen to deal the events out twice for the join
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // EXPORT_ROWS))
    # a row for each event all the way: its candidates, scores and posterior are arrays, and no pair is shuffled; what
    # is made of an event alone (its hash, clocks and version) is made where its lines are, and is not shuffled either
    x = candidates.gate_groups(e, adapters.identities(spark, sf_dir), F.col("user_id") % n, F.col("identity_id") % n, parts)
    x = adapters.observed(x, "candidates")
    x = x.withColumn("score", F.transform("candidates", _score))
    x = x.withColumn("p", infer.softmax_of(F.concat("score", F.array(F.lit(NEW_PRIOR), F.lit(NOISE_PRIOR)))))
    known = F.size("candidates")
    x = x.withColumn("action", decide.action_of(F.slice("p", F.lit(1), known), F.get("p", known), F.get("p", known + 1), LOSSES))
    one = lambda name, k=1: F.lit(k).alias(name)
    records = x.select(
        *("observation_id", "source_id", "event_time", "ingestion_time", "content_hash", "action", "candidates"),
        *[F.col("observation_id").alias(name) for name in ("inference_id", "decision_id")],
        *(F.col("version").alias("host_snapshot"), one("candidate_version"), one("solver_version", CONFIG.version), one("reason", "Exact"), one("policy_version"), one("loss_version")),
        *(one("provider_id"), one("schema_id"), one("model_version"), one("calibration_id", 0), one("semantics", "LogPotential"), one("validity_domain", "events")),
        F.col("score").alias("scores"),
        F.col("p").alias("probabilities"),
    )
    return rdf.packed_lines(records, _BASE, "rdf11")


@query("""
WITH r AS (SELECT * FROM (VALUES (0, 'Triggers', 'State', 'Event'), (1, 'LeadsTo', 'Event', 'State'), (2, 'Evolution', 'State', 'State'), (3, 'Contain', 'Event', 'Event'), (4, 'Occur', 'Event', 'Physical'), (5, 'Influence', 'Event', 'Physical')) r(code, role, source_kind, target_kind))
SELECT event_id, role, code, source_kind, target_kind FROM events JOIN r ON code = event_id % 6""")
def host_relation_ends(spark, sf_dir):
    from orrery.operators import hostgraph

    roles = hostgraph.roles(spark).select("code", "role")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).cast("int").alias("code")).join(F.broadcast(roles), "code")
    source, target = hostgraph.end_kinds(F.col("role"))
    return e.select("event_id", "role", hostgraph.role_code(F.col("role")).alias("code"), source.alias("source_kind"), target.alias("target_kind"))


# ---------------------------------------------------------------- streaming


@query("""SELECT user_id AS identity_id, count(*) AS n, max(epoch_us(ts)) AS last_activation FROM events GROUP BY 1""")
def stream_workspace(spark, sf_dir):
    """The workspace after all events came through a stream, files at a time."""
    from orrery.streaming import resolve

    return resolve.workspace_from_stream(spark, sf_dir)


@query("""
WITH u AS (SELECT user_id AS identity_id, event_id, epoch_us(ts) AS t FROM events), m AS (SELECT max(t) AS now FROM u)
SELECT identity_id, count(*) AS n, max(t) AS last_activation, max(t) < now - 3600000000 AS evicted FROM u, m GROUP BY identity_id, now""")
def stream_eviction(spark, sf_dir):
    """Identities that a stateful stream would evict: an hour without activity before the newest event."""
    from orrery.streaming import resolve

    w = resolve.workspace_from_stream(spark, sf_dir)
    now = w.agg(F.max("last_activation")).first()[0] or 0
    kept, gone = workspace.evict_before(w, now - 3_600_000_000)
    return gone.withColumn("evicted", F.lit(True)).unionByName(kept.withColumn("evicted", F.lit(False)))


@query(f"""WITH {_GATED}, kept AS (SELECT * FROM events e WHERE event_id % 10 <> 9 OR EXISTS (SELECT 1 FROM events x WHERE x.event_id = e.event_id - 9)),
s AS (SELECT g.observation_id, 0 AS k, g.identity_id, -abs(value - 2 * g.identity_id) / 20 AS score FROM gated g JOIN kept ON event_id = g.observation_id WHERE g.identity_id IS NOT NULL
  UNION ALL SELECT event_id, 1, NULL, -1.0 FROM kept UNION ALL SELECT event_id, 2, NULL, -2.0 FROM kept),
p AS (SELECT *, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY observation_id) AS p FROM (SELECT *, max(score) OVER (PARTITION BY observation_id) AS m FROM s)),
r AS (SELECT observation_id, CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'new' ELSE 'noise' END AS action, identity_id, round({LOSSES.false_assign} * (1 - p), 9) AS risk, CASE k WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS tie FROM p)
SELECT observation_id, action, identity_id FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY risk, tie, coalesce(identity_id, -1)) AS n FROM r) WHERE n = 1""")
def stream_resolve(spark, sf_dir):
    """Events come as a stream of files; every micro-batch is resolved and committed to a ledger."""
    from orrery.streaming import resolve

    return resolve.resolved_from_stream(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
