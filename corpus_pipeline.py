"""A corpus pipeline of five stages: documents in, packed training sequences out.

Each stage works on all that the one before has kept and is written as Parquet
and read again, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, decontaminate, linededup, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep.

    Null, empty and short texts go (under 50 words); texts are read whole, however
    long.  Ids aren't looked at: repeated rows and rows without an id are each
    judged.  All columns pass by, whatever their names; no documents give none.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier one has; n_chars follows the text.

    No document goes.  A null or empty text is one empty line and becomes an empty text.
    Rows that share an id are one document; one without an id loses what two others
    share.  All columns pass by, whatever their names; no documents give none.
    """
    return linededup.keep_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words.

    The row with the smallest id stays, one without an id only where none of its
    group has one; rows that share an id are told apart by their texts, and of equal
    rows one stays.  Documents without words are copies of one another.  All
    columns pass by, whatever their names; no documents give none.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none and stay; texts are searched whole.  Benchmark
    items without a text have no passage; without an id, theirs count.  Repeated
    rows are each judged.  All columns pass by, whatever their names; no
    documents give none, an empty benchmark takes none away.
    """
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents and their places in sequences.

    A null or empty text is its end token; a long one is cut into pieces of a
    sequence.  Repeated rows and rows with the same or no id are each packed; other
    columns are left out; no documents give no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack", pack),
]

#: The stages' votes, fingerprints and packing aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return docs
