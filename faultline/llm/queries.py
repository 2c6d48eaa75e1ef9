"""The registered queries of the corpus operators (opN_<name>) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, passages, quality_rules, statements, toxicity, turns, warc
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated lines, how many went and their places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.deduplicated(docs, Scratch(spark, "op1"), removed="lines")
    return out.select("doc_id", "text", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.array_join(F.sort_array("lines"), ",").alias("removed_lines"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1,024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), Scratch(spark, "op2"), tokenizer())


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike it is to both that and the next document's."""
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the smallest doc_id its links reach."""
    found = near_dedup.near_components(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return found.select("doc_id", near_dedup.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word statistics, the base test's and the learned rules' verdict, and the rule that decided."""
    scratch = Scratch(spark, "op5")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = scratch.keep(quality_rules.with_statistics(docs).drop("text"))
    labels = quality_rules.known_labels(table(spark, sf_dir, "labels"))
    rules = quality_rules.learn(scratch.keep(stats.join(labels, "doc_id")))
    d = quality_rules.with_verdict(stats, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return d.select("doc_id", *[F.col(f"fl_{n}").alias(n) for n in names], F.col("fl_base_failed").alias("base_failed"), F.col("fl_kept").alias("kept"), F.col("fl_rule").alias("rule"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it reads back from the archives it was written to."""
    read = warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "op6"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: ~held_out(doc_id))
    return toxicity.scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its quotes resolved, its thread and its place in it."""
    return chat.linked(table(spark, sf_dir, "conversations"), Scratch(spark, "op8"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix of sources takes from it."""
    m = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage that two documents share, once for each of them: doc_id, start, end (word places) and where it is in other_doc_id."""
    found = passages.passages(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    names = ("doc_id", "start", "end")
    side = lambda one, two: F.struct(*[F.col(f"{one}_{c}").alias(c) for c in names], *[F.col(f"{two}_{c}").alias(f"other_{c}") for c in names], "edits", "similarity")
    return found.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a hash of its turns, with its faults, the cost and audit of its cheapest repair and a digest of
    the repaired text.
    """
    return turns.repaired(turns.damaged(table(spark, sf_dir, "conversations")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of those with its text, and how many they are."""
    return exact_dedup.grouped(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its code, its squared error in whole numbers, its label's error, and a digest of the codebooks."""
    return codes.compressed(table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))


OPERATORS = (
    op1_line_dedup, op2_packing, op3_fingerprints, op4_near_dedup, op5_quality_rules, op6_warc, op7_toxicity, op8_chat_formatting, op9_mixing,
    op10_passages, op11_structure_repair, op12_exact_dedup, op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """Hashes, tokens and learned models of the other operators have no SQL form."""
    return statements.all_statements()
