"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, flac, jaccard_join, language, lexical, mixing, oracle, packing, pii, repeats, scoring, sharding, warc
from .common import id_crc, read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontamination.verdicts(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digest(flac.encode_column(read_table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = language.train(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(read_table(spark, sf_dir, "documents"), id_crc(F.col("doc_id")) % 5 != 1)
    return scored.select(
        "doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(read_table(spark, sf_dir, "documents"))


def op11_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_simplex_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_suffix_dedup, op3_pii_weak_supervision, op4_flac_media, op5_best_fit_packing, op6_language_id, op7_byte_balanced_shards, op8_warc_archives, op9_lattice_scoring, op10_jaccard_join, op11_subset_sum_mixing, op12_max_sketch_search, op13_simplex_clustering)}

#: The other queries' rows are models', tokenizers' or media formats', or too slow in SQL over whole tables; tests hold them against plain versions.
SQL: dict[str, str] = {
    "op1_benchmark_decontamination": oracle.OP1,
    "op7_byte_balanced_shards": oracle.OP7,
    "op8_warc_archives": oracle.OP8,
    "op12_max_sketch_search": oracle.OP12,
    "op13_simplex_clustering": oracle.OP13,
}
