"""Training corpus from ``documents``: five stages, each over all that the one before kept.

1. toxicity: documents that the toxicity operator rejects go
2. near-duplicates: one document of each group stays
3. decontamination: spans shared with ``benchmark`` are cut; mostly contaminated documents go
4. personal data: spans are replaced by their kind
5. tokens: byte-level BPE ids of each text, and their number

A stage returns the columns of ``documents``; the last adds nothing but its own result. Nulls, empty and
repeated rows, ties and empty tables are treated as the operators' docstrings say: rows without
text pass every stage, of repeated rows of a kept document all stay.  Texts are read whole, however long.  Columns of other
names, also those that operators use inside, are left out by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.llm import bpe, decontaminate, minhash, pii, toxicity
from inkproof.llm.queries import held_out
from inkproof.llm.shared import small_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs.select(COLUMNS), toxicity.fit(docs, labels, ~held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.keep_one(docs.select(COLUMNS))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(COLUMNS), items)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.redact(docs.select(COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    where = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = docs.select(*COLUMNS, bpe.encode_ids(F.col("text"), *where).alias("ids"))
    back = coded.select("*", bpe.decode_ids(F.col("ids"), *where).alias("decoded"))
    return back.select(
        *COLUMNS,
        bpe.token_count(F.col("ids")).alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", redact_personal_data),
    ("tokens", encode_tokens),
]

#: A learned model and whole-text tokenization have no SQL form; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows stored in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
