"""From raw documents to packed training sequences, stage by stage.

Each stage works on what its predecessor has kept and is written as Parquet to
the shared folder before the next one reads it. Python workers get small batches:
stages that use them set the session's batch sizes where it has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import minhash, mixing, packing, secrets, toxicity
from shutterlake.llm.common import Stored, bound_batches, crc_fold, numbers, scratch, small_batches, table
from shutterlake.llm.queries import THRESHOLD, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Labels are learned from the folds that the toxicity query trains on."""
    bound_batches(spark)
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 4) != 2)
    return toxicity.scored(docs, lexicon, "_toxicity").where(F.col("_toxicity") < THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: the one with the smallest doc_id, then with the smallest hash of its text.

    Rows that repeat a doc_id are documents of their own, told apart by their
    texts: one goes only as a near copy of another, or as an equal row. Rows
    without a doc_id stay.
    """
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    often = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if often.limit(1).isEmpty():
        gone = minhash.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # ids of rows, in the order of doc_id and text's hash
    one = rows.where("doc_id is not null").groupBy("doc_id", "_hash").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    numbered = Stored(numbers(one, ["doc_id", "_hash"], "_id"), "numbered").df
    near = minhash.near_duplicates(numbered.select(F.col("_id").alias("doc_id"), "_row.text"))
    kept = numbered.join(near.where("kept").select(F.col("doc_id").alias("_id")), "_id", "left_semi").select("_row.*")
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to the names of their kinds; every document stays."""
    bound_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order that interleaves sources to their target weights; files follow it and packing reads it from them."""
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, which follow the order that the mix was written in."""
    bound_batches(spark)
    return packing.packed(mixing.places(docs, "_place"), tokenizer_path(), order="_place")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages' models and schedules have no SQL form; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    with small_batches(spark):
        for name, stage in STAGES:
            with scratch() as kept:  # what a stage has written on its way goes when its result is there
                after = Stored(stage(spark, docs, sf_dir), name)
                kept.append(after)
            if before is not None:
                before.drop()
            before, docs = after, after.df
    return docs
