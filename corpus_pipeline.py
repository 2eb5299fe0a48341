"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor left and all but the last give back the
columns of ``documents``:

* language: documents in no known language go (no letter, or no language ahead of the others);
* toxicity: documents that the classifier marks go;
* near copies: of each group of near copies the document with the smallest id stays;
* repeats: byte strings that also occur earlier are cut out of the texts;
* packing: the texts become token sequences.

An empty table passes through; null texts have no letter and go at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlab.llm import language_id, packing, queries, simhash, suffix_dedup, toxicity
from rosterlab.llm.common import stored

# A language's share in the vote of all, over 64 bytes at most, below which none is ahead.
LEAST_LANGUAGE_SCORE = 0.4
_MARK = "_stage_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language_id.identify(docs, queries.language_trees(docs), prefix=_MARK)
    known = f"{_MARK}lang_pred <> '{language_id.UNKNOWN}' AND {_MARK}score >= {LEAST_LANGUAGE_SCORE}"
    return judged.where(known).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = toxicity.score(docs, queries.toxicity_model(spark, sf_dir, docs), prefix=_MARK)
    return judged.where(f"{_MARK}predicted = 0").select(*docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, keep_columns=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.Packing(queries.BYTE_TOKENIZER))


STAGES = [
    ("language", language),
    ("toxicity", not_toxic),
    ("near_copies", no_near_copies),
    ("repeats", no_repeats),
    ("packing", packed),
]

# Trained models, hashes and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages, one after the other, to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
