"""Documents to token digests: every stage works on all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Stages keep missing and empty texts unless their own rule takes them: a missing text
is scored like an empty one, has no lines, is alike with every text without words
(so one of them stays), hits no benchmark and has no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrank.llm import bpe, decontaminate, lines, shingles, toxicity
from panelrank.llm.common import table
from panelrank.llm.queries import VOCABULARY
from panelrank.operators.scale import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came earlier go; the number of characters follows the text. No document goes."""
    found = lines.dedup(docs, exact=1)
    if "n_chars" not in docs.columns:
        return found
    counted = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", F.coalesce(counted, "n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Near: five-word shingles with a Jaccard similarity of 0.8 or more, every such pair.
    """
    return shingles.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

# Training, a set join and byte-pair merging are beyond SQL; tests hold every stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
