"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, divergence, exact_dedup, feistel, fim, line_dedup, near_dedup, packing, pii, quality, reshard
from .common import table

#: The vocabulary file; any folder of tokenizer files may be given instead.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one shard a source (32 old shards) to 40 shards of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    old = F.crc32(F.encode(F.coalesce(F.col("source"), F.lit("")), "utf-8")) % 32
    return reshard.reshard(docs, old, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.expr(pii.as_text("base")), 256).alias("base_sha256"),
                       F.expr(pii.as_text("concat(base, added)")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=4)


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.with_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op5_bpe_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the fixed-stride shards: first slot, number of records, checksum, payload."""
    seqs, total = feistel.sequences(table(spark, sf_dir, "documents"), vocabulary_path())
    return feistel.shard_blocks(seqs, total)


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op11_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_hash_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.log_of(chat.with_trap(table(spark, sf_dir, "conversations")))
    return chat.digests(chat.read_back(chat.render(chat.fold(log))))


QUERIES = {f.__name__: f for f in (
    op1_min_cost_reshard, op2_contextual_pii, op3_minhash_forest, op4_line_windows, op5_bpe_queue, op6_content_sort,
    op7_rule_ensemble, op8_feistel_order, op9_nnls_packing, op10_kmeans_tree, op11_wavelet_fim,
    op12_hash_recount, op13_event_chat)}

ORACLE = {"op4_line_windows": line_dedup.ORACLE_SQL, "op6_content_sort": exact_dedup.ORACLE_SQL,
          "op11_wavelet_fim": fim.ORACLE_SQL, "op12_hash_recount": divergence.ORACLE_SQL,
          "op13_event_chat": chat.ORACLE_SQL}
