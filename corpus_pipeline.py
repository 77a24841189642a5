"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

No SQL for run()'s rows: toxicity scores and links of near copies can't be said in SQL; the tests
hold every stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.llm.linededup import drop_repeated_lines
from panolith.llm.mixing import mix_sources
from panolith.llm.neardup import drop_similar
from panolith.llm.packing import SHARD_PIECES, pack_sequences, word_tokens
from panolith.llm.queries import MIX_SHARES
from panolith.llm.toxicity import score_toxicity, train_toxicity
from panolith.session import discard, load, temporary_tables, written

ORACLE_SQL = None

#: Near copies have at least this Jaccard similarity of five-word shingles.
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5."""
    model = train_toxicity(docs, load(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in 10 documents or more; n_chars follows the text."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of copies and near copies.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8
    or more. Groups to search come from the fingerprints' files, and sets decide. Of repeated rows of one id, and of a group without any id, one row stays.
    """
    return drop_similar(docs, shingle=5, similarity=SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; the files, by name, hold it from first to last row."""
    mixed = mix_sources(docs, MIX_SHARES, other_share=4)
    return mixed.orderBy("mix_slot", "mix_offset").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a shard is a run of rows in the order of the mix."""
    run_of_rows = F.floor(F.col("_metadata.row_index") / SHARD_PIECES).cast("string")
    place = F.concat_ws("/", F.regexp_extract("_metadata.file_name", r"^(part-\d+)", 1), run_of_rows)
    return pack_sequences(docs, word_tokens(), shard=place)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. Each stage's table is removed when the next one's is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary_tables(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
