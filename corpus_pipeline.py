"""The corpus pipeline: language ID, Jaccard join, suffix-array dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; run()
writes each stage's rows as Parquet and gives them to the next one. All but the last return the columns of `docs`.
Empty tables, null texts and extra columns of any name pass through every stage; only a copy_no of `docs` gives way to
that of the mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import jaccard, language, leaks, mixing, suffix
from curatrix.llm.common import written

SHINGLE_WORDS = 5
SIMILARITY = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the declared languages. Null and empty texts go."""
    return language.known_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that links of Jaccard similarity 0.8 over
    five-word shingles connect; of equal rows one. Rows without doc_id, or without words, stay."""
    groups = jaccard.jaccard_join(docs, SHINGLE_WORDS, SIMILARITY)
    groups = written(groups, "groups")
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")  # of known size from here on
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    again = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("repeated_id"))
    again = written(again, "repeated")
    if again.isEmpty():
        return kept
    twice = kept.join(again, kept["doc_id"] == again["repeated_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, kept["doc_id"] == again["repeated_id"], "left_anti").union(twice)


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        texts = [t.decode("utf-8", "ignore") for t in x.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(texts, pa.string())], ["cut_id", "cut_text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a string of 100 bytes covers which starts earlier too. What is left of a
    character that was cut in two goes as well; n_chars is that of the text that stays; documents of which nothing
    is left go."""
    cut = suffix.suffix_dedup(docs).where("n_removed > 0").select("doc_id", "kept").mapInArrow(_readable, "cut_id long, cut_text string").dropDuplicates(["cut_id"])
    left = cut["cut_text"]
    rows = docs.join(cut, docs["doc_id"].cast("long") == cut["cut_id"], "left").where(left.isNull() | left.rlike(r"[^ \t-\r]"))
    new = {"text": F.coalesce(left, docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(left.isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return rows.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with copy_no."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Trained models, byte-level cuts and string tiling are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
