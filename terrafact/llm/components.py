"""Connected components by contraction, for the operators that link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """v, root for every vertex of the edges (a, b: bigint); all of a component have one root, an
    arbitrary vertex of it.

    Each round every vertex moves to its smallest neighbour, if that is smaller, and the edges between
    what remains are kept once. Vertices should be hashes: then chains of falling ids are short and
    the graph shrinks by a factor each round, whatever its diameter. Minima have a partial
    step before the shuffle and joins split hot keys, so a vertex may have any number of edges.
    """
    now = scratch.stage(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    first, moves = now, []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min("b").alias("to")).filter("to < a").withColumnRenamed("a", "v")
        move = scratch.stage(move, "moves")
        moves.append(move)
        moved = _moved(_moved(now, move, "a"), move, "b")
        after = scratch.stage(
            moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
        )
        if now is not first:
            scratch.drop(now)
        now = after
    labels = first.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("root", F.col("v"))
    for move in moves:
        labels = _moved(labels, move, "root")
    return scratch.stage(labels, "labels")


def _moved(df: DataFrame, move: DataFrame, column: str) -> DataFrame:
    step = move.select(F.col("v").alias("__v"), F.col("to").alias("__to"))
    return (
        df.join(step, F.col(column) == F.col("__v"), "left")
        .withColumn(column, F.coalesce("__to", column))
        .drop("__v", "__to")
    )
