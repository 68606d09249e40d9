"""The corpus pipeline: language ID, near duplicates, decontamination, token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over the whole of ``docs``; between stages the rows are
written as Parquet and reread. All stages but the last return the columns of ``docs``.

* ``language`` drops what language ID rejects: null texts and texts without a letter.
* ``near_duplicates`` keeps one document of each class of texts whose five-word shingles have a Jaccard likeness of 0.8, the one with
  the smallest doc_id. Candidates meet at the anchors of wide SimHash fingerprints and each link is checked exactly.
* ``decontaminate`` drops contaminated documents and cuts hit spans out of the others.
* ``pieces`` adds token ids.

Null values, repeated rows, empty tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basinframe.llm import decontaminate, language, pieces, simhash
from basinframe.llm.common import bounded, settle, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return language.keep_known(docs, language.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return simhash.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return pieces.tokenised(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("pieces", pieces_stage),
]

#: The network and the merges are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
