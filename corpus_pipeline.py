"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing, packing.

Each stage takes the table that the stage before it has kept, with the columns
of ``documents``, and returns what it keeps of it; the last returns packed
pieces. Every stage reads all rows and whole texts.

Defined cases, for each stage: an empty table gives an empty table. A null text is
an empty one; null ids and sources are kept as such. Repeated rows are documents
each. Ties are broken as the operators say (the largest id keeps a line, the
smallest id stands for near copies, hashes of ids order the mix); rows of one id
stay or go together in near_dedup. Other columns pass through whatever their names,
up to packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.line_dedup import dedup_lines
from gradeloom.llm.mixing import mix, n_words
from gradeloom.llm.packing import pack_documents
from gradeloom.llm.queries import tokenizer_file
from gradeloom.llm.shared import materialize, not_held_out, read_table
from gradeloom.llm.simhash import keep_one
from gradeloom.llm.toxicity import drop_toxic, train
from gradeloom.session import share_code


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7, a null or empty text by its lack of votes; without usable labels the fixed lists decide."""
    share_code(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return drop_toxic(docs, train(docs.select("doc_id", "text"), labels, not_held_out(F.col("doc_id"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least three of them hold, but in the largest doc_id; n_chars follows the text."""
    share_code(spark)
    out = dedup_lines(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: five words, similarity of 0.8; texts without words are copies of each other."""
    share_code(spark)
    return keep_one(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all; documents without words are not taken."""
    share_code(spark)
    plan = mix(docs).where("copies > 0").select(F.struct("doc_id", "source", "size").alias("key"), "copies").distinct()
    own = docs.select(F.struct("*").alias("doc"), F.struct("doc_id", "source", n_words(F.col("text")).alias("size")).alias("own"))
    hit = own.join(plan, F.col("own").eqNullSafe(F.col("key")))
    return hit.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)"""
    share_code(spark)
    return pack_documents(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
