"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, language_id, mixing, neighbours, oracle, quality_classifier, quality_rules, sharding, simhash, substring, token_output, whitening
from .common import crc_mod, shared_folder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), "hits").select("doc_id", "hits.*")
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.digest_rows(table(spark, sf_dir, "documents"))
    placed = sharding.shuffle_into_shards(rows, shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = token_output.sequences(table(spark, sf_dir, "documents"))
    small, sample = token_output.packed(rows)
    folder = shared_folder(spark, "shards")
    written = token_output.write_shards(token_output.place(small, total), folder, sample).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    if (written["rows"] or 0) != total:
        raise RuntimeError(f"{written['rows']} of {total} sequences written")
    return token_output.read_digests(token_output.place(rows, total), folder, (written["bytes"] or 0) // max(total, 1))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many words as there are, as evenly from all sources as a quarter of repeats at most allows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, target_entropy=None, max_repeat=1.25, epoch_col="epoch", extra={"tokens": "n_words", "weight": "weight", "exponent": "exponent"})
    return mixed.select("doc_id", "source", "n_words", "epoch", F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    weights = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out()))
    scored = quality_classifier.score(docs, weights, "score")
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written from the conversations in several marker styles, parsed back."""
    chats = chat_format.conversations(table(spark, sf_dir, "conversations"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(chat_format.STYLES))).cast("int")
    chats = chats.withColumn("marked", chat_format.marked_turns(style, F.col("turns"))).withColumn("style", style)
    held_out = crc_mod("conv_id", 3) == 1
    counts = chat_format.train(chats.where(~held_out).select(F.col("marked").alias("turns")))
    parsed = chat_format.parse(chats.withColumn("transcript", chat_format.as_transcript(F.col("marked"))), counts, "parsed")
    got, want = F.col("parsed.turns"), F.col("turns")
    right = F.size(F.filter(F.zip_with(got, want, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == F.trim(b["text"])), F.lit(False))), lambda x: x))
    return parsed.select("conv_id", "style", held_out.alias("held_out"), F.size(want).alias("n_turns"), F.size(got).alias("n_parsed"), right.alias("n_right"), F.sha2(F.col("parsed.rendered").cast("binary"), 256).alias("rendered_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.drop("lang"), profiles, "found")
    return found.select("doc_id", language_id.held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, "embedding")
    found = whitening.transform(rows, model, "embedding", "found")
    n, explained, error = (model.n, model.explained, model.identity_error) if model else (0, [], 0.0)
    each = found.select("vec_id", "found.deviation", F.posexplode("found.whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_shard": op3_shard,
    "op4_token_output": op4_token_output,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_substring": op7_substring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "op11_neighbours": op11_neighbours,
    "op12_divergence": op12_divergence,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {"op2_decontaminate": oracle.OP2, "op5_quality_rules": oracle.OP5, "op7_substring": oracle.OP7, "op12_divergence": oracle.OP12}
