"""A pipeline of documents in five stages; each returns the columns of documents, but the last, which returns pieces.

A stage's function takes (spark, docs, sf_dir), docs being all that its predecessor kept. Defined results: rows with null
or empty texts pass every filter (they hold nothing toxic, contaminated or duplicate); repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, jaccard, linededup, pieces, toxicity
from factloom.llm.common import table, text_of, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents of the table, not held out."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return docs.filter(toxicity.score(text_of(), model) < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat over ten documents go; n_chars follows the text."""
    out = linededup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the first by doc_id."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage near a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), out="__fl_passages")
    return found.filter(F.size("__fl_passages") == 0).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text's pieces with seeded dropout, their number, and whether they decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return docs.select("doc_id", pieces.round_trip(F.col("text"), F.col("doc_id"), path).alias("r")).select(
        "doc_id", F.coalesce("r.n_pieces", F.lit(0)).cast("long").alias("n_pieces"), F.col("r.ids_crc32").cast("long").alias("ids_crc32"), F.sha2(F.col("r.decoded").cast("binary"), 256).alias("text_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier, the forest and the tokenizer aren't expressible in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
