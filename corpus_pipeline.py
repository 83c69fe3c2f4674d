"""A corpus pipeline: five stages, each over all documents that the one before has kept."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescribe.functions.scratch import new_folder
from lakescribe.llm.common import fold, fresh, tokenizer_path
from lakescribe.llm.decontaminate import drop_contaminated
from lakescribe.llm.jaccard import drop_near_duplicates
from lakescribe.llm.pieces import piece_counts
from lakescribe.llm.secrets import redact_secrets
from lakescribe.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels outside fold 0 of 5, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, fold(F.col("doc_id")) != 0)
    names = fresh("score", docs.columns), fresh("predicted", docs.columns)
    scored = score_toxicity(docs, model, keep=docs.columns, names=names)
    return scored.where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group that near-duplicate links connect."""
    return drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a mark stands in place of each secret, n_chars follows."""
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, encoded and decoded: doc_id, n_pieces, n_fallback, ids_sha256, round_trip."""
    return piece_counts(docs, partial(tokenizer_path, "piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("SentencePiece encoding and decoding", encode),
]
#: A trained classifier is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
