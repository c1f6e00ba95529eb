"""Substring dedup by sliding spans of consecutive sentences."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SENTENCES = 2
MIN_WORDS = 12
_SENTENCE = re.compile(rb"[^\n]*?(?:[.!?]+(?=[ \t\x0b\x0c\r\n]|\Z)|\n|\Z)[ \t\x0b\x0c\r\n]*", re.S)


def sentences(text: bytes | None) -> list[bytes]:
    """The text cut after ``.``, ``!`` or ``?`` before white space and after line ends; joined, they are the text."""
    return [s for s in _SENTENCE.findall(text or b"") if s]


def span_ends(sizes: list[int], least: int = SENTENCES, min_words: int = MIN_WORDS) -> list[int]:
    """End (exclusive) of the span from each sentence: the shortest run of ``least`` sentences and ``min_words`` words; 0: none."""
    ends, end, words = [], 0, 0
    for start, size in enumerate(sizes):
        while end < len(sizes) and (end - start < least or words < min_words):
            words += sizes[end]
            end += 1
        ends.append(end if end - start >= least and words >= min_words else 0)
        words -= size
    return ends


def _spans(text: bytes | None, least: int, min_words: int) -> tuple[list[int], list[bytes]]:
    """(places, 128-bit hashes) of a text's spans, over words with A-Z lower-cased; a place is its start << 32 | end."""
    own = [s.lower().split() for s in sentences(text)]
    joined = [b" ".join(w) for w in own]
    places, hashes = [], []
    for start, end in enumerate(span_ends([len(w) for w in own], least, min_words)):
        if end and own[start]:
            places.append(start << 32 | end)
            hashes.append(xxhash.xxh3_128_digest(b" ".join(filter(None, joined[start:end]))))
    return places, hashes


def dedup_spans(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = SENTENCES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row for each document: doc_id, n_sentences, n_removed, kept_sha256, text (what is kept).

    From every sentence the shortest run of ``least`` or more consecutive sentences
    that reaches ``min_words`` words is hashed; runs are compared over all
    documents, and sentences inside any but the first run of a hash go.  First is the
    smallest (doc_id, row, sentence).  So what repeats in fewer words, or in
    part of a sentence only, stays, and a text of one sentence loses nothing: that is
    the method's bound.  Only hashes of 128 bits are shuffled: once to find the
    first of each, once to tell the others, a hot hash being split among tasks.
    A null or empty text has no sentences and stays an empty text.  Documents
    with equal or no ids are told apart by their rows; a null id comes last.
    Blank lines belong to the sentence before.
    """
    common.prepare(docs.sparkSession)
    id_sql = common.id_type(docs, doc_id)
    own = common.only(docs, doc_id=doc_id, text=text)

    def run(batches):
        for batch in batches:
            places, hashes, sizes = [], [], []
            for t in common.text_bytes(batch.column(1)):
                own_places, own_hashes = _spans(t, least, min_words)
                sizes.append(len(own_places))
                places += own_places
                hashes += own_hashes
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            listed = lambda a: pa.ListArray.from_arrays(offsets, pa.array(a, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, listed(both[:, 0]), listed(both[:, 1]), listed(np.array(places, np.int64))],
                names=["doc_id", "text", "hashes", "checks", "places"],
            )

    spans = common.map_arrow(own, run, f"doc_id {id_sql}, text string, hashes array<long>, checks array<long>, places array<long>")
    spans = spans.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "text", F.arrays_zip("hashes", "checks", "places").alias("spans")
    )
    spans = common.stage(spans, "spans")
    each = spans.select("doc_id", "row", F.explode("spans").alias("s")).select(
        F.col("s.hashes").alias("h"),
        F.col("s.checks").alias("check"),
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", F.col("s.places").alias("at")).alias("place"),
    )
    key = ["h", "check"]
    first = each.groupBy(key).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # written first: both sides of the join are then shuffled for it alone, and Spark may split a hot hash
    first = common.stage(first, "repeated")
    again = each.join(first, key).filter("place <> first").select("place.row", "place.at")
    gone = again.groupBy("row").agg(F.collect_list("at").alias("gone"))
    whole = spans.drop("spans").join(gone, "row", "left").select("doc_id", "text", "gone")

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, kept = [], [], []
        for t, runs in zip(common.text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            own = sentences(t)
            out = {i for r in runs or () for i in range(r >> 32, r & 0xFFFFFFFF)}
            sizes.append(len(own))
            removed.append(len(out))
            kept.append(b"".join(s for i, s in enumerate(own) if i not in out))
        return common.record_batch(
            doc_id=batch.column(0),
            n_sentences=pa.array(sizes, pa.int64()),
            n_removed=pa.array(removed, pa.int64()),
            kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            text=pa.array(kept, pa.binary()).cast(pa.string()),
        )

    return common.map_batches(
        whole, drop, f"doc_id {id_sql}, n_sentences long, n_removed long, kept_sha256 string, text string"
    )
