"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import oracles
from .bpe import bpe_encode
from .collocations import collocations
from .decontamination import decontaminate
from .embedding_dedup import embedding_dedup
from .html_extraction import extract_main_text
from .kd_sharding import kd_shards
from .merkle import leaf_digest, merkle_manifest
from .minhash_dedup import minhash_dedup
from .packing import pack
from .quotation_linking import link_quotations
from .substring_dedup import substring_dedup
from .token_counts import count_with_edits
from .toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no quotes, so each message is first made to quote the two before it, as mail does.

    Messages of odd turns quote without the first and the last line where that leaves two lines or more, one with text.
    """
    messages = table(spark, sf_dir, "conversations")
    back = lambda n: messages.select("conv_id", (F.col("turn") + n).alias("turn"), F.split("text", "\n").alias(f"lines{n}"))
    mark = lambda column, marks: F.transform(F.coalesce(column, F.array()), lambda x: F.concat(F.lit(marks), x))
    mailed = messages.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    inner = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0)))
    cut = lambda c: F.when((F.col("turn") % 2 == 1) & (F.size(c) > 3) & F.exists(inner(c), lambda x: x.rlike(r"\S")), inner(c)).otherwise(F.col(c))
    lines = F.concat(mark(cut("lines2"), "> > "), mark(cut("lines1"), "> "), F.split("text", "\n"))
    linked = link_quotations(mailed.select("conv_id", "turn", "role", F.array_join(lines, "\n").alias("text")))
    return linked.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every text: an insertion at a quarter, a deletion at half and a replacement at three quarters."""
    docs, n = table(spark, sf_dir, "documents"), F.length(F.coalesce("text", F.lit("")))
    at = lambda k: F.floor(n * k / 4).cast("int")
    edit = lambda start, size, text: F.struct(start.alias("start"), (start + size).alias("end"), text.alias("text"))
    piece = F.upper(F.substring("text", at(3), F.lit(5)))
    edits = F.array(edit(at(1), F.lit(0), F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" "))), edit(at(2), F.lit(7), F.lit("")), edit(at(3), F.lit(5), piece))
    return count_with_edits(docs.withColumn("edits", edits), tokenizer_path("byte_bpe_50k.json"), "edits")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id's crc32 is even, the text has lost its line feeds when it is checked."""
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = leaf_digest(*[F.col(c) for c in fields[:-1]], F.replace("text", F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(docs, fields=fields, altered=F.when(even, tampered)).drop("proof")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_minhash_dedup, op3_quotation_linking, op4_best_fit_packing, op5_edit_aware_counts, op6_html_extraction, op7_toxicity, op8_decontamination, op9_embedding_dedup, op10_kd_sharding, op11_bpe_round_trip, op12_phrase_collocations, op13_merkle_manifest)}
ORACLES: dict[str, str] = oracles.ORACLES
