"""The corpus pipeline: documents in, packed training pieces out, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import jaccard, mixing, packing, secret_scan, toxicity
from gridwright.llm.frames import only, read_table, small_batches, written
from gridwright.llm.queries import secret_model

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from labelled rows of ``docs``."""
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep=DOCUMENT).filter(F.col("score") < 0.5).select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are alike (five words, 0.8 or more) the smallest id stays.

    Rows of one id are one document to the join: one of them stays. Rows without an id stay.
    """
    small_batches(spark)
    groups = written(jaccard.join(docs, words=5, percent=80).filter("doc_id IS NOT NULL"), "groups")
    kept = groups.filter("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    rows = docs.select(*DOCUMENT)
    stay = only(rows, written(kept, "kept").select("doc_id"), "doc_id")
    if not kept.filter("rows > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(rows.filter("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the scan calls a secret replaced by a mark."""
    small_batches(spark)
    clean = secret_scan.redact(docs.select(*DOCUMENT), secret_model(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed texts: a row for each document and pass over its source, with the words taken of it."""
    small_batches(spark)
    mixed = mixing.texts(docs, mixing.plan(docs), keep=DOCUMENT)
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of up to 4096 tokens."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models, pseudorandom draws and a tokenizer can't be said in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
