"""Documents to training data in five stages; each reads what the stage before it wrote as Parquet.

Part of the subpackage tiermark.llm.  SQL cannot express the learned, the hashed and the tokenizing stages, so there is no
ORACLE_SQL; the tests hold each stage against a brute-force version on its own input.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermark.llm import line_dedup, mixing, pieces, simhash, toxicity
from tiermark.llm.common import scratch_dir, ship, table, temporary
from tiermark.llm.queries import tokenizer_path, toxicity_model

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go.  A null or empty text has the score of a text without words; a null doc_id meets no
    label but is scored; repeated rows get the same score; of an empty table nothing is learnt and nothing stays."""
    model, (score,) = toxicity_model(spark, docs, sf_dir), temporary("score")
    return docs.withColumn(score, toxicity.toxicity_score(docs, model)).where(F.col(score) < 0.5).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in one of them; text and n_chars are those of the lines that stay.  A null or empty text is
    one empty line and comes out empty; rows that repeat an id are documents of their own, and the same text loses the same lines;
    a row with a null id owns a line only where no other holds it."""
    kept, *counts = temporary("kept", "n_lines", "n_dropped")
    rows = line_dedup.dedup_lines(docs, kept=kept, counts=tuple(counts))
    changed = rows.withColumn("text", F.col(kept)).withColumn("n_chars", F.char_length(kept).cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays: SimHash fingerprints of five-word shingles within two bits,
    verified by Jaccard similarity (0.8 or more), and an exact search for what is as similar but further apart in 64 bits.  Texts
    without words are one group; rows with a null id all stay; of rows that repeat an id and text one stays."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times.  A null source is a source, last in order; texts without words have no
    size and are taken or not as the plan for their source has it; rows that repeat an id are documents of their own."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of their decoding.  A null or empty text has the end id alone; repeated
    rows get the same digests."""
    path = tokenizer_path("piece_bpe_32k.model")
    return docs.select("doc_id", "lang", "source", pieces.piece_digests(path).alias("p")).select("doc_id", "lang", "source", "p.*")


def _shipped(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipped(f)) for name, f in (("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-dedup", drop_copies), ("mixing", mix), ("pieces", encode))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
