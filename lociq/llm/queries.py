"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import byte_bpe, chat, conversation_repair, exact_dedup, html_extract, katz, licenses, minhash, packing, periodic_runs, quality, sharding, token_counts
from lociq.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: source / language / hundreds of ids / name."""
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text", path.alias("path")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def repeat_planted(docs: DataFrame) -> DataFrame:
    """Texts of documents whose id's crc32 is divisible by 10 get a repeating end of words; see op11."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    times, more = F.floor((n - a) / p).cast("int"), ((n - a) % p).cast("int")
    period = F.array_join(F.slice("words", a + 1, p), " ")
    planted = F.concat_ws(" ", F.slice("words", F.lit(1), a), F.array_repeat(period, times), F.slice("words", a + 1, more))
    return docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeat_planted(documents(spark, sf_dir))).drop("text")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("longest.length"), -F.col("longest.less")
    return found.select("doc_id", "n_runs", (-F.col("longest.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or made the user's, as their crc32 says; see op12."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), h.alias("h")).filter("h != 0")
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    audits, repaired = conversation_repair.repair(damaged(rows))
    hashes = conversation_repair.digests(repaired)
    every = rows.select("conv_id").distinct()
    out = every.join(audits.withColumnRenamed("conv_id", "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left").join(hashes.withColumnRenamed("conv_id", "b"), F.col("conv_id").eqNullSafe(F.col("b")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_katz, op4_byte_bpe, op5_minhash, op6_sharding, op7_packing, op8_chat, op9_quality_rules, op10_licenses, op11_periodic_runs, op12_conversation_repair, op13_html_extract)}


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
            FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WINDOW same AS (PARTITION BY norm)""",
    }
