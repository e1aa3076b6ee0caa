"""Operator 9: n-gram Jaccard self-join by T-occurrence search (DivideSkip), as components.

A document's set is its distinct 5-word shingles; two documents link when the Jaccard similarity of
their sets is 0.8 or more.  The result has one row for each document, with its set size and the
smallest doc_id that it reaches by links.  No link between different sets is lost:

1. Documents of equal sets form a class, represented by its smallest doc_id.
2. Documents without a possible partner leave.  First by prefixes: if two sets link, of the first
   n - ceil(0.8 n) + l shingles in a fixed order they share l at least.  Then by whole sets: 0.8 n shingles
   must occur elsewhere.  Both only count, for each document, shingles that another one has too.
3. The sets left are dealt to blocks by hash.  A block builds inverted lists and answers queries by
   DivideSkip: short lists are merged by a heap, with skips, up to T - L occurrences; the L longest are
   probed by binary search.  A block with many queries is searched by several tasks, each with its part of them.
4. Queries, first round: for each shingle of the prefixes (rare shingles first) the smallest document
   asks the blocks of the others.  That links almost all copies, in as many rows as there are prefix
   shingles.  Second round: in lists whose documents are not all in one component yet, every document outside
   the component of the first asks the blocks of that list.  After both, two documents that share a
   prefix shingle are in one component, or one of them has been compared with the other.

Defined results: null, empty or blank text has no shingle and is its own component; a null ``doc_id`` is
linked with nothing (null component); rows that share a ``doc_id`` count as linked; rows of equal texts
are one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.arrow import slices
from orrery.llm.shingles import fingerprint, shingle_set
from orrery.operators.graph import connected_components
from orrery.session import intermediate, release, written

#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
#: Shingles of one bucket of the filters, of one block of the search, and of the queries of one of its tasks, about.
BUCKET, BLOCK, QUERIES = 1 << 19, 1 << 19, 1 << 20
#: Sets whose shingles are sorted together before they are dealt out.
DEALT_ROWS = 2_000
#: Cost of a probe against that of a heap step in the choice of L.
MU = 0.0085


def least_overlap(n: int, m: int) -> int:
    """Intersection that sets of n and m need: ceil(t (n + m) / (1 + t))."""
    return -(-NUM * (n + m) // (DEN + NUM))


def at_least(n: int) -> int:
    """Intersection that a set of n needs with any other: ceil(0.8 n)."""
    return max(1, -(-NUM * n // DEN))


def prefix_length(n: int) -> int:
    """Shingles of the first filter: enough that partners share ``1 + n // 20`` of them."""
    return min(n, n - at_least(n) + 1 + n // 20)


# ---------------------------------------------------------------- sets and filters


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2, prefix (bytes of hashes) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([s[: prefix_length(len(s))].tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "f1", "f2", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix binary")


def shared_counts(sets: DataFrame, column: str, buckets: int) -> DataFrame:
    """(node, shared): how many shingles of ``column`` some other row has too; rows with none are left out.

    ``sets``: node and bytes of distinct hashes.  Shingles travel as packed arrays, one row for each
    batch and bucket.  What occurs twice in a batch is counted there and sent once, flagged, so a
    shingle of a third of all documents is one entry for each batch, not one for each document.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(slices(batches, DEALT_ROWS)):
            parts = [np.frombuffer(b.as_buffer(), np.uint64) if b.is_valid else np.zeros(0, np.uint64) for b in batch.column(1)]
            if not parts:
                continue
            tokens = np.concatenate(parts)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) for p in parts])
            order = np.argsort(tokens, kind="stable")
            tokens, node = tokens[order], node[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(tokens)])
            many = np.repeat(count > 1, count)
            ids, here = np.unique(node[many], return_counts=True)
            out_t, out_n, out_f = tokens[first], node[first], (count > 1).astype(np.uint8)
            home = (out_t >> np.uint64(40)) % np.uint64(buckets)
            by = np.argsort(home, kind="stable")
            out_t, out_n, out_f, home = out_t[by], out_n[by], out_f[by], home[by]
            cut = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(home)].astype(np.int64) if len(cut) else cut
            rows = [(int(home[a]), out_t[a:b].tobytes(), out_n[a:b].astype(np.int64).tobytes(), out_f[a:b].tobytes()) for a, b in zip(cut, ends, strict=True)]
            rows.append((int(ids[0] + k) % buckets if len(ids) else 0, b"", ids.astype(np.int64).tobytes(), here.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "tokens", "nodes", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        tokens, nodes, flags, ids, here = [], [], [], [], []
        for t, n, c in zip(*(table.column(x).to_pylist() for x in ("tokens", "nodes", "counts")), strict=True):
            if t:
                tokens.append(np.frombuffer(t, np.uint64))
                nodes.append(np.frombuffer(n, np.int64))
                flags.append(np.frombuffer(c, np.uint8))
            else:
                ids.append(np.frombuffer(n, np.int64))
                here.append(np.frombuffer(c, np.int64))
        if tokens:
            t, n, many = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(flags)
            order = np.argsort(t, kind="stable")
            t, n, many = t[order], n[order], many[order]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            count = np.diff(np.r_[first, len(t)])
            shared = np.repeat((count > 1) | (np.maximum.reduceat(many, first) > 0), count) & (many == 0)
            a, b = np.unique(n[shared], return_counts=True)
            ids.append(a)
            here.append(b)
        node, shared = total(ids, here)
        # packed again, by the nodes' own buckets: a row for each pair of buckets, not for each node and bucket
        home = node % buckets
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(buckets + 1))
        rows = [(h, node[by[a:b]].tobytes(), shared[by[a:b]].tobytes()) for h, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["home", "nodes", "counts"])

    def total(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        node, at = np.unique(np.concatenate(ids), return_inverse=True)
        return node, np.bincount(at, np.concatenate(counts), len(node)).astype(np.int64)

    def add(table: pa.Table) -> pa.Table:
        node, shared = total(*[[np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()] for c in ("nodes", "counts")])
        return pa.table({"node": pa.array(node, pa.int64()), "shared": pa.array(shared, pa.int64())})

    dealt = sets.select("node", column).mapInArrow(deal, "bucket long, tokens binary, nodes binary, counts binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "home long, nodes binary, counts binary")
    return met.groupBy("home").applyInArrow(add, "node long, shared long")


def _buckets(total: int | None, size: int) -> int:
    return max(1, math.ceil((total or 0) / size))


def candidate_sets(docs: DataFrame, sigs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, n, set): the sets of class representatives that may have a partner, after both filters."""
    rows = sigs.where("doc_id IS NOT NULL AND n > 0").select(F.col("doc_id").alias("node"), "n", "prefix")
    total = rows.agg(F.sum(F.octet_length("prefix") / 8)).first()[0]
    some = shared_counts(rows, "prefix", _buckets(total, BUCKET))
    # partners of n shingles have 0.8 n at least; for those, prefixes share 1 + 0.8 n // 20
    able = some.join(rows.select("node", "n").distinct(), "node").where(F.col("shared") >= 1 + F.floor(F.ceil(F.col("n") * 0.8) / 20)).select("node")
    able = able.join(reps.select(F.col("rep").alias("node")), "node", "left_semi").distinct()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(able.hint("shuffle_hash"), "node", "left_semi")
    sets = written(texts.mapInArrow(full, "node long, n long, set binary").where("n > 0"), "sets")
    total = sets.agg(F.sum("n")).first()[0]
    again = shared_counts(sets, "set", _buckets(total, BUCKET))
    kept = again.join(sets.select("node", "n"), "node").where(F.col("shared") >= F.ceil(F.col("n") * 0.8)).select("node").distinct()
    found = written(sets.join(kept.hint("shuffle_hash"), "node", "left_semi"), "candidates")
    release(sets)
    return found


# ---------------------------------------------------------------- DivideSkip


class Lists:
    """Inverted lists of the sets of one block."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(nodes)), key=lambda i: nodes[i])
        self.nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(tokens, kind="stable")  # documents ascend within a list
        self.tokens, self.docs = tokens[by], doc[by].tolist()

    def search(self, query: np.ndarray) -> list[int]:
        """Places of the sets that link with ``query``."""
        lo, hi = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        has = hi > lo
        lo, hi = lo[has], hi[has]
        t = at_least(len(query))
        if len(lo) < t:
            return []
        size = hi - lo
        longest_first = np.argsort(-size, kind="stable")
        n_long = min(t - 1, int(t / (MU * math.log2(max(2, int(size.max()))) + 1)))
        long = [(int(lo[i]), int(hi[i])) for i in longest_first[:n_long]]
        short = [(int(lo[i]), int(hi[i])) for i in longest_first[n_long:]]
        found = []
        for d, c in self._merge(short, t - n_long):
            need = least_overlap(len(query), self.sizes[d])
            left = len(long)
            for a, b in long:
                if c + left < need:
                    break
                left -= 1
                k = bisect_left(self.docs, d, a, b)
                c += k < b and self.docs[k] == d
            if c >= need:
                found.append(d)
        return found

    def _merge(self, lists: list[tuple[int, int]], t: int) -> Iterator[tuple[int, int]]:
        """(document, occurrences) with ``t`` or more occurrences in ``lists``: MergeSkip."""
        docs, at, end = self.docs, [a for a, _ in lists], [b for _, b in lists]
        heap = [(docs[a], i) for i, a in enumerate(at)]
        heapq.heapify(heap)
        while len(heap) >= t:
            d, popped = heap[0][0], []
            while heap and heap[0][0] == d:
                popped.append(heapq.heappop(heap)[1])
            if len(popped) >= t:
                yield d, len(popped)
                for i in popped:
                    at[i] += 1
                    if at[i] < end[i]:
                        heapq.heappush(heap, (docs[at[i]], i))
                continue
            # t - 1 lists at most hold what stands before the next head: skip them all to it
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
            for i in popped:
                at[i] = bisect_left(docs, target, at[i], end[i])
                if at[i] < end[i]:
                    heapq.heappush(heap, (docs[at[i]], i))


def search_blocks(sets: DataFrame, routes: DataFrame, blocks: int) -> DataFrame:
    """Links (a, b) that the queries of ``routes`` (node, block) find.

    Every block that is asked gets a task for each ``QUERIES`` shingles of its queries, and each task is a
    partition of its own: the index of the block first, then its part of the queries stream past, so a task
    holds one block and one batch of queries, however many there are.
    """
    routes = written(routes, "routes")
    sized = routes.join(sets.select("node", "n"), "node").groupBy("block").agg(F.sum("n").alias("n"))
    sized = sized.select("block", F.ceil(F.col("n") / QUERIES).cast("int").alias("parts"))
    # a narrow row for each block: their tasks are numbered through
    upto = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    tasks = written(sized.select("block", "parts", (F.sum("parts").over(upto) - F.col("parts")).cast("int").alias("first")), "tasks")
    total = tasks.agg(F.sum("parts")).first()[0] or 1
    every = F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)
    index = sets.select(_block("node", blocks).alias("block"), "node", "set").join(tasks, "block").select(F.explode(every).alias("task"), F.lit(0).alias("kind"), "node", "set")
    part = F.col("first") + F.pmod(F.xxhash64("node", F.lit(blocks)), F.col("parts")).cast("int")
    asked = routes.join(tasks, "block").select(part.alias("task"), "node").join(sets.select("node", "set"), "node").select("task", F.lit(1).alias("kind"), "node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, sets, lists = None, [], [], None
        for batch in slices(batches):
            a, b = [], []
            for at, kind, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != task:
                    task, nodes, sets, lists = at, [], [], None
                tokens = np.frombuffer(data, np.uint64)
                if kind == 0:
                    nodes.append(node)
                    sets.append(tokens)
                    continue
                if lists is None:
                    lists = Lists(nodes, sets)
                for d in lists.search(tokens):
                    if lists.nodes[d] != node:
                        a.append(node)
                        b.append(lists.nodes[d])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = index.unionByName(asked).repartitionById(int(total), "task").sortWithinPartitions("task", "kind")
    return rows.mapInArrow(run, "a long, b long")


def _block(node: str, blocks: int):
    return F.pmod(F.xxhash64(node), F.lit(blocks))


# ---------------------------------------------------------------- queries and components


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, node, n): the shared shingles of each set's prefix, rare shingles first."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int64()))], ["node", "tokens"])

    rows = sets.select("node", "set").mapInArrow(unpack, "node long, tokens array<long>").select("node", F.explode("tokens").alias("token"))
    often = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequency")
    ranked = rows.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    n = sets.select("node", "n").groupBy("node").agg(F.max("n").alias("n"))
    # a shingle that only this set has stands before the shared ones and takes its place in the prefix
    length = F.col("n") - F.ceil(F.col("n") * 0.8) + 1 - (F.col("n") - F.size("t"))
    first = ranked.join(n, "node").select("node", "n", F.explode(F.slice("t", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("t"))
    return written(first.select(F.col("t.token").alias("token"), "node", "n"), "prefixes")


def same_ids(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes in which rows of one ``doc_id`` stand."""
    some = sigs.where("doc_id IS NOT NULL AND n > 0")
    twice = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    of = some.join(twice, "doc_id", "left_semi").select("doc_id", "f1", "f2").join(classes, ["f1", "f2"])
    return of.where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()


def links(sets: DataFrame, known: DataFrame) -> DataFrame:
    """(node, component) of all sets that link with another; ``known`` are links (a, b) besides."""
    total = sets.agg(F.sum("n")).first()[0]
    blocks = _buckets(total, BLOCK)
    rows = prefixes(sets)
    heads = written(rows.groupBy("token").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", "head.node", "head.n"), "heads").toDF("token", "head", "head_n")
    near = (F.col("n") * 5 >= F.col("head_n") * 4) & (F.col("head_n") * 5 >= F.col("n") * 4)
    seen = rows.join(heads, "token").where(F.col("node") != F.col("head"))
    routes = seen.where(near).select(F.col("head").alias("node"), _block("node", blocks).alias("block")).groupBy("node", "block").agg(F.lit(1).alias("_one")).drop("_one")
    found = written(search_blocks(sets, routes, blocks), "links")
    first = written(connected_components(found), "components")
    # lists that are not yet in one component: all outside the head's ask the blocks of that list
    own = first.toDF("node", "own")
    of_head = first.toDF("head", "of_head")
    open_rows = seen.join(own, "node", "left").join(of_head, "head", "left").where(F.coalesce("own", "node") != F.coalesce("of_head", "head")).select("token", "node", "n")
    open_rows = written(open_rows, "open")
    places = rows.join(open_rows.select("token").distinct(), "token", "left_semi").select("token", _block("node", blocks).alias("block"), F.col("n").alias("m")).groupBy("token", "block").agg(F.min("m").alias("low"), F.max("m").alias("high"))
    fits = (F.col("high") * 5 >= F.col("n") * 4) & (F.col("low") * 4 <= F.col("n") * 5)
    routes = open_rows.join(written(places, "places"), "token").where(fits).select("node", "block").groupBy("node", "block").agg(F.lit(1).alias("_one")).drop("_one")
    more = written(search_blocks(sets, routes, blocks), "links")
    both = more.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(known)
    return connected_components(both)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    with intermediate() as keep:
        sigs = written(signatures(docs), "signatures")
        classes = written(sigs.where("doc_id IS NOT NULL AND n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
        sets = candidate_sets(docs, sigs, classes)
        named = links(sets, written(same_ids(sigs, classes), "same_ids"))
        keep(sigs, classes, named)
    slim = sigs.select("doc_id", "n", "f1", "f2")
    of_class = classes.join(named, classes["rep"] == named["node"], "left").select("f1", "f2", F.least("rep", F.coalesce("component", "rep")).alias("component"))
    joined = slim.join(of_class, ["f1", "f2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))).alias("component_id"))
