"""The corpus pipeline: documents to packed training sequences in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from cohortlens.llm.common import staged, table

# No stage list with a model, a tokenizer and a search for near duplicates is SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones of ``docs``, doesn't call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, column="__toxicity")
    return scored.where("__toxicity < 0.5").select(*[scored[c] for c in docs.columns])


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has (n_chars is that of the new text)."""
    new = line_dedup.dedupe(docs)
    return new.select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
                        if c == "n_chars" else new[c] for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id. Rows with one
    doc_id and text are one document; a row without doc_id stays."""
    classes = near_dedup.classes(docs)
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    rows = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    named = rows.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(rows.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), column="__hits")
    return found.where(F.size("__hits") == 0).select(*[found[c] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedupe_lines), ("near_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
