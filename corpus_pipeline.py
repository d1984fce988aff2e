"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, jaccard, mixing, suffixes, toxicity
from tidewell.llm.common import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half, as fitted on the table's own labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of smallest id."""
    return jaccard.one_per_group(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what occurred earlier; those of which nothing is left go, n_chars follows."""
    cut = suffixes.repeated_strings(docs, carry=True).filter(
        (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))
    )
    untouched = F.col("n_removed") == 0
    changed = {
        "text": F.when(untouched, F.col("row.text")).otherwise(F.col("kept")),
        "n_chars": F.when(untouched, F.col("row.n_chars")).otherwise(
            F.length("kept").cast(docs.schema["n_chars"].dataType)
        ),
    }
    return cut.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, which may be never or up to three times."""
    return mixing.remix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the hash of the text that the ids decode to."""
    return bpe.decode(bpe.encode(docs)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_strings),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

# Learned scores, repeated byte strings and token merges have no SQL form; tests hold them to plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
