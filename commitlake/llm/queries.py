"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, decontaminate, licenses, mixing, quality, secrets, sharding, simhash, tokens, warc

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The test tables' sources have no domains: their numbers stand for four of them.
DOMAINS = ("web", "books", "code", "forum")
WEIGHTS = {("web",): 4, ("books",): 3, ("code",): 2, ("forum",): 1, ("web", "en"): 3, ("books", "en"): 2}
FRACTION, EPOCHS, SEED = 0.7, 2, 17


def domain_of() -> Column:
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))))


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, domain_of(), WEIGHTS, fraction=FRACTION, max_epochs=EPOCHS, seed=SEED)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixed(docs).select("doc_id", domain_of().alias("domain"), "lang", "source", F.col("epoch").cast("long").alias("epoch"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_read(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("notices")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash.simhash_components(_read(spark, sf_dir, "documents"), width=3, max_bits=3)
    return parts.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, _read(spark, sf_dir, "labels"), carry=False).select("doc_id", *quality.BASE, "base_failed", "kept")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    found = (op1_decontaminate, op2_mixing, op3_warc, op4_tokens, op5_secrets, op6_sharding, op7_licenses, op8_simhash, op9_quality, op10_chat)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
