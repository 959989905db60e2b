"""Registered queries of the corpus operators: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from paperlens.llm import byte_bpe, decontaminate, hard_negatives, language, line_dedup, mixing, near, ngram, oracle, quality, tokens, toxicity, warc, whitening
from paperlens.llm.common import residue, table

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


@query("op1_quality_rules", oracle.QUALITY)
def op1(spark, d):
    out = quality.quality(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_language")
def op2(spark, d):
    return language.identify(table(spark, d, "documents"), language.teaches())


@query("op3_decontamination", oracle.DECONTAMINATION)
def op3(spark, d):
    out = decontaminate.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, "contaminated")


@query("op4_token_counts")
def op4(spark, d):
    return tokens.token_counts(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_lm_scores")
def op5(spark, d):
    rest = residue("doc_id", 7)
    part = F.when(rest == 2, ngram.UNSEEN).when(rest == 3, ngram.HELD).when(rest.isNull(), ngram.UNSEEN).otherwise(ngram.KEPT)
    out = ngram.score(table(spark, d, "documents"), part)
    return out.withColumn("held_out", F.coalesce(rest == 2, F.lit(False)))


@query("op6_mixing", oracle.MIXING)
def op6(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_toxicity")
def op7(spark, d):
    docs, learn = table(spark, d, "documents"), toxicity.teaches()
    model = toxicity.fit(docs, table(spark, d, "labels"), learn)
    out = toxicity.scores(docs.select("doc_id", "text"), model).withColumnRenamed("toxic_score", "score")
    held_out = F.coalesce(~learn, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_warc", oracle.ARCHIVES)
def op8(spark, d):
    return warc.archived(table(spark, d, "pages")).drop("url", "payload")


@query("op9_line_dedup", oracle.LINE_DEDUP)
def op9(spark, d):
    out = line_dedup.dedup_lines(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_kept", F.md5("text").alias("text_md5"))


@query("op10_simhash")
def op10(spark, d):
    out = near.near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_byte_bpe")
def op11(spark, d):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(table(spark, d, "documents"), *vocabulary), *vocabulary)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids, F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op12_hard_negatives", oracle.HARD_NEGATIVES)
def op12(spark, d):
    rows = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_whitening")
def op13(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))
