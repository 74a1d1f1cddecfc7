"""The operators' queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, divergence, lines, media, merkle, packing, pieces, quality, simhash, sstable, suffixes, tokens, toxicity, trie


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    lexicon = toxicity.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_hits")


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(common.documents(spark, sf_dir))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"), passages=suffixes.PASSAGE_WORDS)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(media.store_texts(common.documents(spark, sf_dir)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_turns(chat.with_probe(chat.conversations(spark, sf_dir))))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir), tokens.default_vocabulary())


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.clean(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(common.documents(spark, sf_dir), common.shared_path(spark, "sstable"), tokens.default_vocabulary(), end_id=2)
    return sstable.read_shards(manifest)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(common.documents(spark, sf_dir), pieces.default_model(), from_files=True, with_ids=False)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.conversations(spark, sf_dir))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(quality.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_merkle": op2_merkle,
        "op3_suffixes": op3_suffixes,
        "op4_media": op4_media,
        "op5_simhash": op5_simhash,
        "op6_chat": op6_chat,
        "op7_packing": op7_packing,
        "op8_lines": op8_lines,
        "op9_sstable": op9_sstable,
        "op10_pieces": op10_pieces,
        "op11_trie": op11_trie,
        "op12_quality": op12_quality,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_lines": lines.ORACLE_SQL, "op11_trie": trie.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
