"""The training-data queries, one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinweave.llm import decontamination, jaccard, passages, periods, pieces, pii, repetition, simhash, tools, toxicity, urls, wavelet, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return repetition.repetition(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learnt from the labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in occurrences of benchmark windows, and the items whose rarest words it has near each other."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=True)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's user turns as calls, linked to the replies."""
    return tools.link(*tools.exchanges(table(spark, sf_dir, "conversations")), tools.schema_table(spark))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that another document repeats, exactly or nearly."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to wavelet-matrix shards and read back."""
    return wavelet.documents(wavelet.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a repeating end planted in every tenth."""
    return periods.digest(periods.periodic_runs(periods.planted(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened values of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links of nine tenths of three-word shingles in common."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition": op1_repetition,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_tool_calls": op5_tool_calls,
    "op6_passages": op6_passages,
    "op7_wavelet_matrix": op7_wavelet_matrix,
    "op8_url_rules": op8_url_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_runs": op11_runs,
    "op12_whitening": op12_whitening,
    "op13_jaccard": op13_jaccard,
}

ORACLE_SQL: dict[str, str] = {"op1_repetition": repetition.SQL, "op2_pii": pii.SQL, "op4_decontamination": decontamination.SQL, "op5_tool_calls": tools.SQL, "op8_url_rules": urls.SQL}
