"""Registered queries of the text operators: they map the given tables to the operators' records and results back."""

from __future__ import annotations

import uuid


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.llm.benchmark_overlap import benchmark_overlaps
from voxelgrain.llm.conversation_tree import conversation_digests, pack_conversations, read_conversations
from voxelgrain.llm.exact_copies import copy_groups
from voxelgrain.llm.metric_whitening import whiten_metrics
from voxelgrain.llm.near_copies import near_groups
from voxelgrain.llm.page_text import extract_pages
from voxelgrain.llm.periodic_runs import periodic_runs
from voxelgrain.llm.report_language import LanguageModel, fit_languages, identify_languages
from voxelgrain.llm.secret_search import RULES, find_secrets
from voxelgrain.llm.shingle_join import shingle_groups
from voxelgrain.llm.token_store import read_token_store, write_token_store
from voxelgrain.llm.token_transducer import decode_reports, encode_reports
from voxelgrain.llm.toxic_windows import fit_toxic, score_toxic
from voxelgrain.session import checkpoint_folder


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file; a parameter of the token operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("stack_id"), F.col("text").alias("report"))


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(reports(spark, folder))
    listed = F.array_join(
        F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(r.kind) for r in RULES]
    return found.select(F.col("stack_id").alias("doc_id"), *counts, listed.alias("spans")).withColumn(
        "base_sha256", F.sha2(F.col("spans").cast("binary"), 256)
    )


def op2_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path()
    coded = encode_reports(reports(spark, folder), path).drop("report")
    read = decode_reports(coded, path)
    return read.select(
        F.col("stack_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = near_groups(reports(spark, folder))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("stack_id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op7_benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_overlaps(reports(spark, folder), table(spark, folder, "benchmark")).withColumnRenamed("stack_id", "doc_id")


def held_out(remainder: int, parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder


def language_model(documents: DataFrame) -> LanguageModel:
    """Learns from documents outside the held-out part."""
    return fit_languages(documents.where(~held_out(2, 4)), key="doc_id", text="text", language="lang")


def op3_toxic(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").where(~held_out(0, 5)).select(F.col("doc_id").alias("stack_id"), "toxic")
    texts = reports(spark, folder)
    found = score_toxic(texts, fit_toxic(texts, labels)).withColumnRenamed("stack_id", "doc_id")
    return found.select("doc_id", held_out(0, 5).alias("held_out"), "score", "predicted")


def op5_conversation_tree(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return conversation_digests(read_conversations(pack_conversations(given.unionByName(more))))


def op6_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages")).withColumn("n_lines", F.size(F.split("text", "\n")).cast("bigint"))


def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{checkpoint_folder(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    write_token_store(reports(spark, folder), tokenizer_path(), place)
    return read_token_store(spark, place).withColumnRenamed("stack_id", "doc_id")


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = identify_languages(documents.select("doc_id", "text"), language_model(documents), text="text")
    return found.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "rejected")


def op8_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return copy_groups(reports(spark, folder)).withColumnRenamed("stack_id", "doc_id")


def repeating(text: Column, number: Column) -> Column:
    """The text, with words from some place on made periodic where the document's hash ``number`` is divisible by ten."""
    g = F.floor(number / 10)

    def made(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        rest = n - a
        p = F.lit(1) + F.floor(rest / (F.lit(3) + g % 8))
        one = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(one, F.ceil(rest / p).cast("int"))), 1, rest.cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")).otherwise("")

    # the words as a list of one, so that they are cut once
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((number % 10 == 0) & text.isNotNull(), F.transform(F.array(words), made)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    number = F.crc32(F.col("stack_id").cast("string").cast("binary"))
    given = reports(spark, folder).select("stack_id", repeating(F.col("report"), number).alias("report"))
    found = periodic_runs(given)
    # runs come by start and period, so the first of equal exponents stays
    better = "(b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b)"
    best = F.expr(f"aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), {better})")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    marked = found.select("stack_id", "runs", best.alias("best"), lines.alias("lines"), "collapsed")
    return marked.select(
        F.col("stack_id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_groups(reports(spark, folder)).withColumnRenamed("stack_id", "doc_id")


def op13_metric_whitening(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("metrics"))
    return whiten_metrics(given, keys=["vec_id"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_byte_pairs, op3_toxic, op4_near_copies, op5_conversation_tree, op6_page_text, op7_benchmark_overlap,
        op8_exact_copies, op9_token_store,
        op10_language, op11_periodic_runs, op12_shingle_join, op13_metric_whitening,
    )
}
