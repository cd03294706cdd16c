"""A training corpus out of documents: five stages, each an operator of recordloom.llm applied to all its predecessor kept.

Defined results, of every stage but the last: all columns stay, whatever their names, and n_chars, if there, follows a text
that a stage changes. Null and empty texts are never toxic by their words, have no lines, shingles or test items, and stay;
rows that repeat in doc_id and text are one after keep_one, and rows without a word stay all; null doc_ids are ids like
others. Texts of any length are read whole. Of copies, and of ties, the smallest doc_id stays. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import decontamination, lines, minhash, packing, toxicity
from recordloom.llm.common import cut, made, release, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list = []


def stage(f: Stage) -> Stage:
    """Before a stage begins, tables that earlier stages cut are removed, but those that its docs still read."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            release(_left, docs.inputFiles())
            _left.clear()
        before = len(made())
        out = f(spark, docs, sf_dir)
        _left.extend(made()[before:])
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled rows of documents and labels, and without any label none go."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from texts; all documents stay until decontaminate, which drops those emptied here."""
    return lines.dedup_lines(docs)


@stage
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingles of five words are alike to 0.8, the one of the smallest doc_id stays."""
    return minhash.keep_one(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go from texts; documents that are mostly test items go, and those that line dedup has emptied."""
    return decontamination.clean(lines.without_emptied(docs, table(spark, sf_dir, "documents", at_once=False)), table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces with their places in sequences; a document without text is a piece of the end id alone."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash", keep_one), ("decontamination", decontaminate), ("packing", pack)]

#: Tokens, chunk boundaries and a fitted model are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = cut(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
