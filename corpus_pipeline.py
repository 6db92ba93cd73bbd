"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.decontaminate import decontaminate
from cairn.llm.exact_dedup import exact_dedup
from cairn.llm.minhash import near_dedup
from cairn.llm.packing import pack
from cairn.llm.runtime import cleaned, drop, table, tokenizer_path, written
from cairn.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier chain doesn't reject. Null and empty texts stay; rows that repeat are judged each, by their own text; no rows give none."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text that is equal after lower-casing A-Z: that with the smallest id, a null id last. Null counts as empty; of rows that repeat id and text one stays; no rows give none."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id. Texts without words (null and empty among them) are groups of their own; rows with a null id stay; an id that repeats stays or goes as one; no rows give none."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Null and empty texts stay; rows that repeat are judged each, by their own text; no items keep all rows, no rows give none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows, every token id of every row in one of them. Null and empty texts are the end id alone; rows that repeat are packed each; equal lengths lie in order of part, id and start; no rows give none."""
    return pack(docs, tokenizer_path(), end_id=0, window=1024)


STAGES = [("op5_toxicity", toxicity), ("op8_exact_dedup", exact), ("op10_minhash", near), ("op4_decontamination", benchmark), ("op9_packing", packing)]

# Trained models and signatures are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it. What a stage leaves behind goes when its rows are written, and its rows when the next stage's are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with cleaned(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
