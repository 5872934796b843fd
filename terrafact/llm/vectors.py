"""Operator 7: near-duplicate vectors by int8 tile products.

Equal vectors of one label are a class. Classes are dealt into tiles of about `TILE` vectors; every
two tiles of a label meet in one task. There vectors are unit length and quantised to int8, each with
the exact norm of what quantising changed. The product of the int8 tiles, plus the error bound
|e_v| + |e_u| |v'|, tells which pairs may reach the threshold; only those are computed again in
double precision. A task returns sums of links and, for the components, a spanning forest of its links,
so no list of pairs leaves it.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label or null id, link with nothing; vectors of different lengths don't link; repeated
rows count as vectors of their own; rows of one id share its component only if linked. A class is named by
a 64-bit hash: two different vectors out of n share one with a chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected

TILE = 1024
THRESHOLD = 0.93
#: Products of int8 values are summed exactly in single precision over this many components.
EXACT = 1024


def usable(vector: str) -> Column:
    """Whether a vector can have a cosine."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, the norms of the errors, the norms of what stands for u."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt(((u - near) ** 2).sum(1)), np.sqrt((near * near).sum(1))


def links(u: np.ndarray, v: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold between unit vectors; with v None between those of u,
    each pair once."""
    same = v is None
    v = u if same else v
    qu, su, eu, _ = quantise(u)
    qv, sv, ev, nv = quantise(v)
    product = np.zeros((len(u), len(v)), np.float64 if u.shape[1] > EXACT else np.float32)
    for lo in range(0, u.shape[1], EXACT):
        product += qu[:, lo : lo + EXACT].astype(np.float32) @ qv[:, lo : lo + EXACT].astype(np.float32).T
    # the last term covers rounding in this sum itself
    upper = product * su[:, None] * sv[None, :] + ev[None, :] + eu[:, None] * nv[None, :] + 1e-6
    i, j = np.nonzero(upper >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        keep[part] = np.einsum("ij,ij->i", u[i[part]], v[j[part]]) >= threshold
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex that each of n vertices reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each of `rows` (vec_id bigint, embedding array, label)."""
    scratch = Scratch(rows.sparkSession, "vectors")
    one = F.transform("embedding", lambda x: x.cast("double"))
    marked = rows.select("vec_id", "label", one.alias("vector")).withColumn(
        "cls",
        F.when(usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("label", "vector")),
    )
    marked = scratch.stage(marked, "rows")
    classes = scratch.stage(
        marked.filter("cls IS NOT NULL").groupBy("cls", "label", "vector").agg(F.count(F.lit(1)).alias("n")), "classes"
    )
    sized = classes.withColumn("dim", F.size("vector"))
    groups = sized.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = sized.join(groups, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        """One row for a tile: ids, counts and vectors as bytes."""
        vectors = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "label": group.column("label")[:1], "dim": group.column("dim")[:1], "tile": group.column("tile")[:1],
            "ids": [group.column("cls").to_numpy().tobytes()], "counts": [group.column("n").to_numpy().tobytes()],
            "vectors": [unit(vectors.reshape(len(group), -1)).tobytes()],
        })

    kind = dealt.schema["label"].dataType.simpleString()
    tiles = scratch.stage(
        dealt.groupBy("label", "dim", "tile").applyInArrow(
            lambda t: pack(t), f"label {kind}, dim int, tile int, ids binary, counts binary, vectors binary"
        ),
        "tiles",
    )

    def side(name: str) -> DataFrame:
        return tiles.select(
            "label", "dim", F.col("tile").alias(name),
            *[F.col(c).alias(f"{c}_{name}") for c in ("ids", "counts", "vectors")],
        )

    pairs = (
        tiles.select("label", "dim", "tile").join(groups, ["label", "dim"])
        .select("label", "dim", F.col("tile").alias("a"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("b"))
    )
    met = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])

    def meet(found: Iterable) -> Iterator[tuple[int, int, int]]:
        for r in found:
            ids, counts = np.frombuffer(r["ids_a"], np.int64), np.frombuffer(r["counts_a"], np.int64)
            u = np.frombuffer(r["vectors_a"]).reshape(len(ids), -1)
            if r["a"] == r["b"]:
                i, j = links(u, None, threshold)
            else:
                v = np.frombuffer(r["vectors_b"]).reshape(-1, r["dim"])
                i, j = links(u, v, threshold)
                j = j + len(ids)
                ids = np.concatenate([ids, np.frombuffer(r["ids_b"], np.int64)])
                counts = np.concatenate([counts, np.frombuffer(r["counts_b"], np.int64)])
            if not len(i):
                continue
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, i, counts[j])
            np.add.at(n, j, counts[i])
            low = forest(i, j, len(ids))
            for k in np.flatnonzero(n):
                yield int(ids[k]), int(n[k]), int(ids[low[k]])

    # rows of a tile pair are large: the RDD's batches are bounded by bytes
    found = scratch.stage(
        rows.sparkSession.createDataFrame(met.rdd.mapPartitions(meet), "v bigint, n bigint, low bigint"), "links"
    )
    labels = connected(scratch, found.select(F.col("v").alias("a"), F.col("low").alias("b")))
    linked = found.groupBy(F.col("v").alias("cls")).agg(F.sum("n").alias("others"))
    about = (
        classes.select("cls", "n").join(linked, "cls", "left")
        .join(labels.withColumnRenamed("v", "cls"), "cls", "left")
        .select("cls", F.coalesce("root", "cls").alias("root"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    placed = scratch.stage(marked.select("vec_id", "cls").join(about, "cls", "left"), "placed")
    smallest = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    return placed.join(smallest, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("least", "vec_id"), F.lit(False)).alias("kept"),
    )
