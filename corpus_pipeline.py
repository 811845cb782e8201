"""A training corpus from the documents table, stage by stage.

Rejected: documents without a language, all but one of each group of near-duplicates, bytes
that repeat an earlier document, and what the mixture does not take. A document of which
nothing is left after the third stage has no words and so no part in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescape.llm import jaccard, language, mixing, packing, repeats
from filescape.llm.queries import tokenizer
from filescape.llm.tables import table
from filescape.session import cut, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter go, and no others where nothing is labelled."""
    field = language.fit_field(docs, language.remainder("doc_id", 5) != 0)
    found = language.identify(docs, field, keep=COLUMNS[1:])
    known = F.col("text").rlike(r"\p{L}") if field is None else F.col("lang_pred") != language.UNKNOWN
    return found.filter(known).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id, null last; of rows equal in id
    and text one. Ids may repeat: rows are told apart by a hash of id and text."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    linked = jaccard.link_documents(keyed, cut, doc="_key").select(F.col("doc_id").alias("_key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"]
    kept = linked.distinct().join(keyed.select("_key", "doc_id").distinct(), "_key").groupBy("component_id").agg(first.alias("_key"))
    joined = keyed.join(kept, "_key", "left_semi")
    return joined.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that also start in an earlier document."""
    left = repeats.without_repeats(docs, cut, keep=("lang", "source"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a part is the words it takes."""
    return mixing.mixed_documents(docs, cut).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer(), cut)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
