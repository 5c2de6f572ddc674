"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels"))).drop("text")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", F.col("size_").alias("size"), "source_size", "target", (F.col("size_") * F.col("copies_")).cast("long").alias("taken"), F.col("rate_").alias("rate"), F.col("copies_").cast("int").alias("copies"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    deviation = F.col("deviation_").try_cast("long").alias("deviation")
    each = rows.select("vec_id", F.posexplode(F.arrays_zip("whitened_", "explained_")).alias("at_", "c_"), F.col("n_").alias("n"), deviation, F.col("identity_error_").alias("identity_error"))
    return each.select("vec_id", (F.col("at_") + 1).alias("component"), "n", "deviation", F.col("c_.whitened_").alias("whitened"), F.col("c_.explained_").alias("explained"), "identity_error")


def op12_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .bpe import decode, encode

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer).drop("text")
    out = decode(ids, tokenizer)
    hashed = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=label)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
