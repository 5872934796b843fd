"""One registered query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, ngram_join, packing, pieces, quality, repeats, separators, spelling, sql, topk, toxicity, vectors, whitening
from .common import Scratch, fold, table

PIECE_MODEL = "piece_bpe_32k.model"
#: `</s>` of the piece model; encoding a text never gives it.
SEPARATOR = 2


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    learn = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.filter(learn), table(spark, sf, "labels", "doc_id", "toxic").filter(learn))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences", "n_toxic",
    )


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    # Words are counted once; histogram, shards and places are made of the numbers.
    sized = Scratch(spark, "op2").stage(docs.select("doc_id", packing.n_words("text").alias("words")), "sized")
    return packing.pack(sized, F.col("words")).drop("words")


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    model = language.fit(docs.filter(fold("doc_id", 4) != 2))
    return language.predict(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.digests(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path(PIECE_MODEL))


def op5_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    return ngram_join.similarity_classes(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_counts(table(spark, sf, "documents", "doc_id", "text"))


def op7_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf, "embeddings", "vec_id", "embedding", "label"))


def op8_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", topk.whole_units("embedding").alias("units"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op9_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digests(table(spark, sf, "documents", "doc_id", "text"))


def op10_separators(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all documents, found again in flat token files that hold nothing but ids."""
    scratch = Scratch(spark, "op10")
    folder = scratch.new_path("ids")
    order = separators.write_flat(
        table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path(PIECE_MODEL), SEPARATOR, folder
    )
    order = scratch.stage(order, "order")
    blocks = separators.blocks_of(spark, folder, order, 2, separators.BLOCK_IDS)
    # Both sides grow with the corpus, however well the order is compressed on disk.
    found = separators.scan(blocks, folder, SEPARATOR, 2).hint("merge")
    return order.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op11_quality(spark: SparkSession, sf: str) -> DataFrame:
    stats = quality.staged_statistics(table(spark, sf, "documents", "doc_id", "text"))
    learn = fold("doc_id", 4) != 2
    model = quality.fit(stats.filter(learn), table(spark, sf, "labels", "doc_id", "quality").filter(learn))
    return quality.score(stats, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents", "doc_id", "text"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_pieces": op4_pieces,
    "op5_ngram_join": op5_ngram_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_vectors": op7_vectors,
    "op8_topk": op8_topk,
    "op9_repeats": op9_repeats,
    "op10_separators": op10_separators,
    "op11_quality": op11_quality,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op2_packing": packing.oracle(),
    "op5_ngram_join": sql.NGRAM_JOIN,
    "op6_line_dedup": lines.ORACLE,
    "op7_vectors": sql.VECTORS,
    "op8_topk": sql.TOP_K,
    "op12_spelling": sql.SPELLING,
}
