"""A corpus pipeline of five stages; each reads what the one before it wrote.

Every stage takes any table with doc_id, text, lang and source, and returns its columns as they came, whatever their
names, but for the last.  Nulls: a null text counts as empty, a null language or source is a group like
any other, a row without an id is judged by its text.  Rows that repeat one another are judged alike, and
near-dedup leaves one of them.  An empty table stays empty, texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import byte_bpe, mixing, near_copies, pii, quality
from seamark.llm.common import materialise, read

#: Wanted shares of tokens; clean text keeps what it has, the other domains are thinned to their shares and never repeated.
WEIGHTS = {"clean": 0.97, "poor": 0.025, "toxic": 0.005}
#: What the operators read; all other columns are only carried.
READ = ("doc_id", "text", "lang", "source")


def _aside(docs: DataFrame) -> DataFrame:
    """Carried columns under names that no result has."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in READ else f"_own{k}") for k, c in enumerate(docs.columns)))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(c if c in READ else f"_own{k}").alias(c) for k, c in enumerate(docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go; so do those without words."""
    return _back(quality.judge(_aside(docs)).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id, one without an id only where all are."""
    return near_copies.drop_near_copies(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in every text, under the session's key; n_chars, where there is one, follows the text."""
    out = _back(pii.replace(_aside(docs), pii.key_of(spark)), docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, by the hash of their id; rows without an id share one draw."""
    there = _aside(docs)
    mixed = mixing.mix(there, read(spark, sf_dir, "labels"), WEIGHTS, keep=there.columns, anchor="clean", thin=True)
    times = mixed.where("copies > 0").select(F.struct(*there.columns).alias("row"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _back(times.select("row.*"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens and the other columns but the text; no text has no ids."""
    import public_tokenizers as tok

    return byte_bpe.encode(docs, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).drop("text")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("surrogates", surrogates), ("mixing", mix_domains), ("byte BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs


#: Byte pair merging, covering codes and keyed surrogates are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
