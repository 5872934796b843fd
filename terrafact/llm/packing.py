"""Operator 2: packing into optimal length buckets.

The histogram of all lengths is computed once over the whole corpus. Dynamic programming over its
distinct lengths chooses the upper bounds of `buckets` buckets that minimise the padding
when every document is padded to its bucket's bound (the longest length in it). Inside a bucket, documents
in a fixed order fill batches of at most `budget` tokens, padding included.

The driver holds the histogram only: as many entries as there are distinct lengths, at most the
square root of twice the corpus' tokens. Order within a bucket: documents are dealt into shards by id, numbered inside their shard, and
shards are put one behind the other by a running sum, so a bucket that holds most of the corpus is
still numbered by many tasks.

Length: words `[^\\x20\\x09-\\x0D]+` of the text. Edge cases: null and empty texts have length 0 and are batched in a bucket
like others; a document longer than the budget is a batch of its own (`capacity` 1); rows with a null id
form a shard of their own by length; repeated rows get a place each; an empty table gives no rows;
with fewer distinct lengths than buckets each length has its own. Ties of the optimum go to the
smaller lower bound, from the last bucket backwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

BUCKETS = 8
BUDGET = 16_384
#: Documents of one shard, about.
SHARD = 8192


def n_words(text: str) -> Column:
    """Words of a text: the places where a word begins."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, ascending. The cost of lengths (i, j] is L[j] * (documents) - (tokens); it fulfils the
    quadrangle inequality, so the best cut only moves up with j and each layer is solved by halving."""
    n = len(lengths)
    k = min(buckets, n)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.int64)
    best = lengths * docs[1:] - tokens[1:]  # of lengths 0..j in one bucket
    cuts = np.zeros((k, n), np.int64)
    for layer in range(1, k):
        now = np.full(n, np.iinfo(np.int64).max // 4, np.int64)
        todo = [(layer, n - 1, layer, n - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(j, right) + 1)  # first length of the last bucket
            cost = best[i - 1] + lengths[j] * (docs[j + 1] - docs[i]) - (tokens[j + 1] - tokens[i])
            at = int(np.argmin(cost))
            now[j], cuts[layer, j] = cost[at], i[at]
            todo += [(lo, j - 1, left, int(i[at])), (j + 1, hi, int(i[at]), right)]
        best = now
    bounds, j = [], n - 1
    for layer in range(k - 1, -1, -1):
        bounds.append(int(lengths[j]))
        j = int(cuts[layer, j]) - 1
    return bounds[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """All columns of `docs` and n_tokens, bucket (its upper bound), capacity (documents in a full
    batch), batch (from 0 in each bucket), padding. Columns of these names are replaced, others stay."""
    shard, place, many, sum_ = unused(docs, "__shard", "__in", "__n", "__before")
    extra = ("n_tokens", "bucket", "capacity", "batch", "padding")
    sized = docs.drop(*extra).withColumn("n_tokens", length)
    found = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    lengths, counts = found.column("n_tokens").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(lengths)
    bounds = best_bounds(lengths[order], counts[order], buckets)
    shards = max(1, -(-int(counts.sum()) // SHARD))
    upper = F.lit(None).cast("bigint")
    for b in reversed(bounds):
        upper = F.when(F.col("n_tokens") <= b, F.lit(b).cast("bigint")).otherwise(upper)
    placed = sized.withColumns({
        "bucket": upper,
        shard: F.coalesce(F.pmod(F.col("doc_id"), F.lit(shards)), F.lit(shards) + F.col("n_tokens")).cast("bigint"),
    })
    ranked = placed.withColumn(
        place, F.row_number().over(Window.partitionBy("bucket", shard).orderBy("doc_id", "n_tokens"))
    )
    sums = placed.groupBy("bucket", shard).agg(F.count(F.lit(1)).alias(many))
    before = Window.partitionBy("bucket").orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", shard, F.coalesce(F.sum(many).over(before), F.lit(0)).alias(sum_))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("bigint")
    return (
        ranked.join(offsets, ["bucket", shard])
        .withColumn("capacity", capacity)
        .withColumn("batch", F.floor((F.col(sum_) + F.col(place) - 1) / F.col("capacity")).cast("bigint"))
        .withColumn("padding", F.col("bucket") - F.col("n_tokens"))
        .select(*[c for c in docs.columns if c not in extra], *extra)
    )


#: The same packing as SQL: the table of lengths, all cuts of the dynamic program, its best path
#: backwards (smallest cost, then smallest lower bound), and numbers by shard and id.
def oracle(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
hist AS (SELECT n_tokens AS l, count(*) AS n, row_number() OVER (ORDER BY n_tokens) AS j FROM sized GROUP BY 1),
cum AS (SELECT l, j, sum(n) OVER (ORDER BY j) AS d, sum(n * l) OVER (ORDER BY j) AS t, sum(n) OVER () AS total, max(j) OVER () AS h FROM hist),
dp(k, j, cost, cut) AS (
  SELECT 1, j, CAST(l * d - t AS HUGEINT), CAST(0 AS BIGINT) FROM cum
  UNION ALL
  SELECT k, j, cost, cut FROM (
    SELECT p.k + 1 AS k, b.j, CAST(p.cost + b.l * (b.d - a.d) - (b.t - a.t) AS HUGEINT) AS cost, a.j AS cut,
           row_number() OVER (PARTITION BY b.j ORDER BY p.cost + b.l * (b.d - a.d) - (b.t - a.t), a.j) AS best
    FROM dp p JOIN cum a ON a.j = p.j JOIN cum b ON b.j > a.j WHERE p.k < {buckets} AND p.k < b.h) WHERE best = 1),
path(k, j) AS (
  SELECT least({buckets}, max(h)), max(h) FROM cum HAVING count(*) > 0
  UNION ALL
  SELECT path.k - 1, dp.cut FROM path JOIN dp ON dp.k = path.k AND dp.j = path.j WHERE path.k > 1),
bounds AS (SELECT l AS bucket FROM path JOIN cum USING (j)),
placed AS (
  SELECT doc_id, n_tokens, (SELECT min(bucket) FROM bounds WHERE bucket >= n_tokens) AS bucket,
         coalesce(doc_id % s.shards, s.shards + n_tokens) AS shard
  FROM sized, (SELECT greatest(1, (count(*) + {SHARD - 1}) // {SHARD}) AS shards FROM sized) s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY shard, doc_id, n_tokens) AS r,
                  greatest(1, CAST(floor({budget} / greatest(bucket, 1)) AS BIGINT)) AS capacity FROM placed)
SELECT doc_id, n_tokens, bucket, capacity, CAST((r - 1) // capacity AS BIGINT) AS batch, bucket - n_tokens AS padding FROM ranked
"""
