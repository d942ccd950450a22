"""Cleaning of a training corpus in five stages, each over all documents that the stage before kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from addrforge.llm import language_id, minhash_dedup, packing, suffix_dedup, toxicity
from addrforge.llm.runtime import cut


def drop_toxic(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.filter(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def keep_identified_language(spark, docs, sf_dir):
    model = language_id.fit(docs.select("doc_id", "text", "lang").filter(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def drop_near_copies(spark, docs, sf_dir):
    return minhash_dedup.keep_one(docs)


def remove_repeated_passages(spark, docs, sf_dir):
    """Texts lose every byte of a repeated 200-byte string; n_chars follows; a text may become empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = suffix_dedup.remove_repeats(docs, carry=others).withColumn("text", suffix_dedup.as_text(F.col("kept"))).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(docs.columns)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified_language),
    ("minhash_dedup", drop_near_copies),
    ("suffix_dedup", remove_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the exact ones could be said in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
