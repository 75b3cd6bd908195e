"""The thin queries opN_*: each applies its operator to a whole table and returns the columns agreed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import automaton, exact, html, mixing, near, pieces, pii, ppm, quality, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeated_bytes(table(spark, sf_dir, "documents"), keep="none", earlier=True)


def op5_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.drop_repeated_words(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), tokenizer_bytes())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix_plan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"), k=4)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


#: Of the query only; a user's key is kept outside the code.
QUERY_KEY = b"key of the query"


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_ppm, op3_suffix_dedup, op5_automaton_dedup, op4_pieces, op6_quality, op7_mixing, op8_main_text, op9_near_dedup, op10_pseudonyms)}
