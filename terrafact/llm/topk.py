"""Operator 8: exact top-k by inner product with a ball tree per shard.

All vectors are dealt into shards of about `SHARD`; one task builds each shard's ball tree. Queries
come in blocks. A node's score is at most q.c + |q| r (centre, radius), so a query takes nodes in
the order of this bound and stops at the first bound below its current k-th score. A first pass
searches one shard for each query; its k-th score is where the second pass, over all other shards,
begins, so that most of their nodes are cut off at once.

A shard goes to its task once, with the blocks of queries behind it. Scores are integers; bounds are
widened by more than double precision can lose, and equal bounds are still searched, as ties
go to the smaller id.

Edge cases: rows with a null id, a null or empty vector or null or non-finite components take no
part; candidates of another length than the query's are left out; all rows with the query's
id count as its own row; with fewer candidates than k all are returned; repeated rows are candidates
and queries each; all rows of one query id share one list of answers, the k highest of all that they find. Copies
of one id and vector are counted before they are dealt, and k of them stand for all, as no list holds more. Components must stay below 2**31 in whole units.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD = 16_384
BLOCK = 2048
LEAF = 128


def whole_units(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null unless all are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    ok = F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("int")))


class BallTree:
    """Nodes of a tree over integer vectors: centre, radius, children or a slice of points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        points = points.astype(np.float64)
        where = np.arange(len(ids))
        self.slices: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        todo: list[tuple[int, int, int]] = [(0, len(ids), -1)]
        centres, radii = [], []
        while todo:
            lo, hi, parent = todo.pop()
            here = points[where[lo:hi]]
            centre = here.mean(0)
            away = ((here - centre) ** 2).sum(1)
            node = len(centres)
            centres.append(centre)
            radii.append(float(np.sqrt(away.max())))
            self.slices.append((lo, hi))
            self.children.append(None)
            if parent >= 0:
                a, b = self.children[parent]
                self.children[parent] = (node, b) if a < 0 else (a, node)
            if hi - lo > leaf and radii[-1] > 0:
                far = here[int(away.argmax())]
                other = here[int(((here - far) ** 2).sum(1).argmax())]
                side = here @ (far - other)
                cut = np.argsort(side, kind="stable")
                where[lo:hi] = where[lo:hi][cut]
                mid = (lo + hi) // 2
                self.children[node] = (-1, -1)
                todo += [(mid, hi, node), (lo, mid, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ids, self.points = ids[where], points[where]

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """index of the query, id, score of candidates that reach the query's floor, at most k
        (best score, then smaller id)."""
        queries = queries.astype(np.float64)
        length = np.sqrt((queries**2).sum(1))
        bound = queries @ self.centres.T + length[:, None] * self.radii[None, :]
        bound += 1e-9 * (1 + np.abs(bound) + length[:, None] * (self.radii + np.abs(self.centres).max(initial=0))[None, :])
        for q in range(len(ids)):
            kth = float(floor[q])
            best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
            heap = [(-bound[q, 0], 0)]
            while heap:
                upper, node = heapq.heappop(heap)
                if -upper < kth:
                    break
                if (below := self.children[node]) is not None:
                    for child in below:
                        if bound[q, child] >= kth:
                            heapq.heappush(heap, (-bound[q, child], child))
                    continue
                lo, hi = self.slices[node]
                scores = self.points[lo:hi] @ queries[q]
                good = np.flatnonzero((scores >= kth) & (self.ids[lo:hi] != ids[q]))
                if len(good):
                    best_s = np.concatenate([best_s, scores[good]])
                    best_i = np.concatenate([best_i, self.ids[lo:hi][good]])
                    order = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[order], best_i[order]
                    if len(best_s) == k:
                        kth = max(kth, float(best_s[-1]))
            for s, i in zip(best_s, best_i, strict=True):
                yield q, int(i), int(s)


def _packed(df: DataFrame, key: list[str], kinds: str, extra: list[str]) -> DataFrame:
    """One row for each key: ids and vectors as bytes."""

    def pack(group: pa.Table) -> pa.Table:
        flat = group.column("units").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        out = {k: group.column(k)[:1] for k in key}
        out["ids"] = [group.column("vec_id").to_numpy().tobytes()]
        out["units"] = [flat.tobytes()]
        out["floors"] = [group.column("floor").to_numpy().astype(np.float64).tobytes()] if extra else [b""]
        return pa.table(out)

    return df.groupBy(*key).applyInArrow(lambda t: pack(t), f"{kinds}, ids binary, units binary, floors binary")


def _search(scratch: Scratch, shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score. asked: shard, dim, block, ids, units, floors."""
    kinds = ["shard", "dim", "block", "ids", "units", "floors"]
    both = shards.withColumn("block", F.lit(-1)).select(*kinds).unionByName(asked.select(*kinds))
    dealt = both.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "block")

    def run(rows: Iterable) -> Iterator[tuple[int, int, int]]:
        tree, of = None, None
        for r in rows:
            ids = np.frombuffer(r["ids"], np.int64)
            units = np.frombuffer(r["units"], np.int32).reshape(len(ids), -1)
            if r["block"] < 0:
                tree, of = BallTree(ids, units), (r["shard"], r["dim"])
            elif of == (r["shard"], r["dim"]):
                for q, i, s in tree.search(ids, units, np.frombuffer(r["floors"]), k):
                    yield int(ids[q]), i, s

    found = scratch.spark.createDataFrame(dealt.rdd.mapPartitions(run), "query_id bigint, vec_id bigint, score bigint")
    return scratch.stage(found, "found")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. rows: vec_id, units (array of int, or null)."""
    scratch = Scratch(rows.sparkSession, "topk")
    valid = rows.filter("vec_id IS NOT NULL AND units IS NOT NULL").withColumn("dim", F.size("units"))
    # `k` copies of a row fill any list of answers, so more of them need not be dealt
    copies = valid.groupBy("vec_id", "units", "dim", F.coalesce(is_query, F.lit(False)).alias("asks")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")
    valid = scratch.stage(copies.select("vec_id", "units", "dim", "asks", each), "rows")
    sizes = valid.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.count_if("asks") / block)).cast("int").alias("blocks"),
    )
    dealt = valid.join(sizes, "dim")
    # dealt by vector and id, so that copies of one vector or one id spread over all shards
    shards = scratch.stage(
        _packed(
            dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id", "units", "copy"), F.col("shards")).cast("int")),
            ["shard", "dim"], "shard int, dim int", [],
        ),
        "shards",
    )
    queries = (
        dealt.filter("asks").select("vec_id", "units", "dim", "shards", "blocks", "copy")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "units", "copy"), F.col("blocks")).cast("int"))
    )
    key, kinds = ["dim", "block", "shards"], "dim int, block int, shards int"
    home = F.pmod(F.col("block"), F.col("shards"))
    begin = _packed(queries.withColumn("floor", F.lit(float("-inf"))), key, kinds, ["floor"])
    first = _search(scratch, shards, begin.withColumn("shard", home), k)
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).cast("double").alias("floor")
    )
    known = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = (
        _packed(known, key, kinds, ["floor"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .filter(F.col("shard") != home)
    )
    second = _search(scratch, shards, rest, k)
    # several vectors of one query id search on their own and share the id's answer
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(second)
        .withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
