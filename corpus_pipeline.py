"""A pipeline from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage
before has kept, and returns a DataFrame. All but the last return the columns of
documents, and drop others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteq.llm import language_id, packing, secrets, simhash_dedup
from graniteq.llm.common import checkpointed, take
from graniteq.sources import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Five bits of fingerprints of word pairs, and 12 of those of five words: of two texts of similarity 0.8 these differ in 10 on average.
#: Tries are dealt out again beyond 1,024 rows, as a walk within five bits drops fewer pairs.
NEAR = {"shingle_words": 2, "max_bits": 5, "check_words": 5, "check_bits": 12, "walk_rows": 1024}


def _own(docs: DataFrame) -> DataFrame:
    """The columns of documents, by place; others may have names that differ only in case."""
    return take(docs, {c: c for c in COLUMNS})


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or like no learned language, go.

    The languages are learned from the documents themselves, as the language
    identification query does. Where no document has a language, nothing can be
    learned and all with a letter stay. A null or empty text goes; texts of any
    length are read whole. A null id or language teaches nothing, but its document is
    judged like others. Repeated rows are judged each; no rows give none.
    """
    docs = _own(docs)
    profiles = language_id.learn_profiles(docs.filter(~language_id.held_out(F.col("doc_id"))))
    if not profiles.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language_id.keep_known(docs, profiles)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; documents without an id stay.

    Copies are documents of a similarity of about 0.8 or more over five-word
    shingles, as their fingerprints tell it: candidates come from the walk over
    fingerprints of word pairs, of which few edits change few bits, and link only if
    the fingerprints of five-word shingles are near too. The query of the operator
    has its own contract of three words and 3 bits. Texts are read whole, null ones
    are empty. Rows that repeat an id are one document, and all of them stay or go;
    no rows give none.
    """
    docs = _own(docs)
    groups = simhash_dedup.near_duplicates(docs, **NEAR)
    copies = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by its kind; n_chars counts the new text.

    A null text stays null with its n_chars. Of findings that overlap the first
    one's kind stands for all. Repeated rows are redacted each; no rows give none.
    """
    clean = secrets.redact(_own(docs), "text", COLUMNS)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences, with the ids of each piece.

    A null text is empty and has the end mark alone. Null ids are kept, repeated
    rows are packed each, and no rows give none.
    """
    return packing.pack_documents(_own(docs), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the language profiles or the packing; a test holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
