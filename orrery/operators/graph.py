"""Graph operators on DataFrames: connected components and transitive closure.

A graph of ``TASK_EDGES`` edges at most (16 bytes each, counted first) is solved by one task over its
arrays.  Larger ones iterate to the fixed point, writing each round as a table in the shared folder, so
that plans stay short and a lost executor costs one round at most; tables of earlier rounds are deleted.
Nothing is collected but a few counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import intermediate, release, written

#: Edges that one task solves, 16 MB of arrays.
TASK_EDGES = 1_000_000


def _distinct(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.lit(1).alias("_one")).drop("_one")


def _columns(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(n)]


def smallest_names(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component): roots hook onto smaller roots, then pointers jump."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        if np.array_equal(p, q):
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up, up[up]):
            up = up[up]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); a component is named by its smallest node.

    Null ends are dropped; self loops name a node.  Beyond a task's size large star and small star
    alternate until nothing changes: every node hangs its larger neighbours on the smallest node it knows,
    then itself and its smaller ones.  Rounds grow with the logarithm of the longest chain; a hub is a
    skewed join key, which adaptive execution splits.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    with intermediate() as keep:
        pairs = written(_distinct(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))), "edges")
        found = _in_one_task(pairs) if pairs.count() <= TASK_EDGES else _by_stars(pairs)
        keep(found)
    return found


def _in_one_task(pairs: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, name = smallest_names(*_columns(batches, 2))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(name, pa.int64())], ["node", "component"])

    return written(pairs.coalesce(1).mapInArrow(solve, "node long, component long"), "components")


def _by_stars(pairs: DataFrame) -> DataFrame:
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())

    nodes = written(_distinct(pairs.select(F.explode(F.array("v", "m")).alias("node"))), "nodes")
    e = written(pairs.where("v <> m"), "star")
    before, now = None, state(e)
    while now != before and now[0]:
        # large star: u tells its larger neighbours the smallest node that it knows
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        # a table, so that the join below has plain tables on both sides and a hub's rows can be split
        low = written(both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low")), "low")
        larger = e.select(F.col("m").alias("u"), F.col("v").alias("w"))
        large = written(_distinct(larger.join(low, "u").select(F.col("w").alias("v"), F.col("low").alias("m"))), "large-star")
        # small star: v tells itself and its smaller neighbours the smallest of them
        least = written(large.groupBy("v").agg(F.min("m").alias("low")), "least")
        small = large.join(least, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        small = written(_distinct(small.unionByName(least.select("v", F.col("low").alias("m")))), "star")
        release(e, low, large, least)
        e, before, now = small, now, state(small)
    roots = e.select(F.col("v").alias("node"), F.col("m").alias("component"))
    return written(nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that are reached from ``roots`` (node) along ``edges`` (a to b), the roots included.

    Any graph will do: chains, several parents, cycles.  Beyond a task's size nodes with one parent, which
    make up chains and trees, are settled by pointer jumping: after round k a node knows whether one of
    its 2^k nearest ancestors is a root, or which of them has several parents or none.  Only the nodes with
    several parents are then reached step by step, until a step reaches nothing new.
    """
    with intermediate() as keep:
        step = written(_distinct(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")), "edges")
        start = written(_distinct(roots.select(F.col("node").cast("long").alias("node")).where("node IS NOT NULL")), "roots")
        small = step.count() + start.count() <= TASK_EDGES
        found = _closure_in_one_task(step, start) if small else _closure_by_jumps(step, start)
        keep(found)
    return found


def reach(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ids reached from ``start`` along edges from ``a`` to ``b``."""
    nodes, at = np.unique(np.concatenate([a, b, start]), return_inverse=True)
    x, y, s = np.split(at, [len(a), 2 * len(a)])
    by = np.argsort(x, kind="stable")
    y, first = y[by].tolist(), np.searchsorted(x[by], np.arange(len(nodes) + 1)).tolist()
    seen, todo = np.zeros(len(nodes), bool).tolist(), s.tolist()
    for n in todo:
        seen[n] = True
    while todo:
        n = todo.pop()
        for m in y[first[n] : first[n + 1]]:
            if not seen[m]:
                seen[m] = True
                todo.append(m)
    return nodes[np.array(seen, bool)] if len(nodes) else nodes


def _closure_in_one_task(step: DataFrame, start: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, root = _columns(batches, 3)
        edge = root == 0
        yield pa.RecordBatch.from_arrays([pa.array(reach(a[edge], b[edge], a[~edge]), pa.int64())], ["node"])

    rows = step.withColumn("root", F.lit(0).cast("long")).unionByName(start.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1).cast("long").alias("root")))
    return written(rows.coalesce(1).mapInArrow(solve, "node long"), "reached")


def _closure_by_jumps(step: DataFrame, start: DataFrame) -> DataFrame:
    parents = step.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("up"))
    rooted = start.withColumn("_hit", F.lit(True))
    single = parents.where("n = 1").select(F.col("b").alias("node"), "up").join(rooted, "node", "left").select("node", "up", F.coalesce("_hit", F.lit(False)).alias("hit"), F.lit(False).alias("done"))
    several = written(parents.where("n > 1").select(F.col("b").alias("node")), "several")
    state = written(single, "jump")
    # after these rounds a node has looked past all others, so one still open is on a cycle or below one, without a root above
    for _ in range(state.count().bit_length() + 1):
        if state.where("NOT hit AND NOT done").isEmpty():
            break
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("hit").alias("up_hit"), F.col("done").alias("up_done"), F.lit(True).alias("inner"))
        joined = state.join(above, "up", "left")
        # an ancestor that is not single ends the jumps; so does one whose own jumps have ended, at its end
        moved = F.when(F.col("done") | F.col("hit") | F.col("inner").isNull(), F.col("up")).otherwise(F.col("next"))
        after = written(joined.select("node", moved.alias("up"), (F.col("hit") | F.coalesce("up_hit", F.lit(False))).alias("hit"), (F.col("done") | F.col("inner").isNull() | F.coalesce("up_done", F.lit(False))).alias("done")), "jump")
        release(state)
        state = after
    ends = state.select("node", F.when(F.col("done"), F.col("up")).alias("end"), "hit")
    into = step.join(several.select(F.col("node").alias("b")), "b", "left_semi")
    into = into.join(ends.withColumnRenamed("node", "a"), "a", "left").select(F.when(F.coalesce("hit", F.lit(False)), F.lit(None).cast("long")).otherwise(F.coalesce("end", "a")).alias("a"), "b", F.coalesce("hit", F.lit(False)).alias("hit"))
    into = written(_distinct(into), "into")
    known = start.unionByName(into.where("hit").select(F.col("b").alias("node")))
    parts = [written(_distinct(known), "reached")]
    frontier = parts[0]
    while True:
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        new = _distinct(into.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")))
        frontier = written(new.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > 16:  # one table instead of many small ones
            whole = written(seen.unionByName(frontier), "reached")
            release(*parts[:-1])
            parts = [whole]
    below = ends.join(seen.select(F.col("node").alias("end"), F.lit(True).alias("_seen")), "end", "left").where(F.col("hit") | F.col("_seen")).select("node")
    return written(_distinct(below.unionByName(seen)), "closure")
