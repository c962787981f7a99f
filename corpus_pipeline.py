"""A training-data pipeline over ``documents``: five stages, each by one operator.

Every stage takes (spark, docs, sf_dir) and gives the documents that it keeps,
with the same columns (and any others that came along, whatever their names); the
last one adds the token ids (ids, decoded, n_tokens). A stage's output is written as Parquet and read again by the next.

1 toxicity          documents that the classifier rejects go
2 near_duplicates   of each component of near duplicates the least id stays
3 substring_dedup   words inside repeated runs of 13 words go from all but the first document
4 decontamination   documents that hold a window of a benchmark item go
5 sentencepiece     ids of each text, and the text that they decode to

Null ids count as an id made of the text (equal texts without ids are one
document); of rows that repeat an id one stays in stage 2; null texts pass
through all stages and have no ids; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm import block_dedup, decontaminate, ngram_join, sentencepiece_codec, toxicity
from tallyloom.llm.scratch import Scratch

def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The text, these columns, and all columns but the text in one, so that no operator's column meets one of theirs."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(*more, "text", F.struct(F.lit(0).alias("_"), *others).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them anew."""
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return unpacked(toxicity.score(packed(docs), model).where("score < 0.5"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows without an id come after all ids: one stays only where no row of its group has an id.
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text").bitwiseAND((1 << 62) - 1) + (1 << 62)).cast("long").alias("key")
    rows = packed(docs, key)
    found = ngram_join.near_duplicates(rows.select("key", "text"), id_col="key")
    kept = found.where(F.col("key") == F.col("component_id")).select("key").distinct()
    # Of rows that repeat an id one stays: the first by its text, then by its other columns.
    order = F.struct(F.col("row.doc_id").isNull(), F.col("text"), F.to_json("row"))
    first = rows.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("text", "row"), order).alias("one"))
    return unpacked(first.select("one.*"), docs)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packed(docs, F.col("doc_id"), F.col("text").isNull().alias("no_text"))
    found = block_dedup.dedup(rows, layout=True, label="pipeline-runs")
    # The operator gives an empty text for a null one: it is put back.
    text = F.when(F.col("no_text"), F.lit(None).cast("string")).otherwise(F.col("kept"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(found, docs, **new)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return unpacked(decontaminate.search(packed(docs), benchmark).where("n_hit = 0"), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.round_trip(docs, model).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_runs),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: Training a classifier and subword segmentation are beyond SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
