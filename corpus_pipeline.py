"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Toxic documents go; of each group of near copies one document stays; documents with the passages of two
or more benchmark items go, and the hits of a single item are cut out of the others; personal data is
replaced by [KIND]; what is left is packed into bins of tokens. Stages in the middle return the columns
of documents, with the same rows or fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import decontaminate, jaccard, packing, pii, toxicity
from heliograph.llm.common import materialize, read_table

#: No SQL can express the classifier, so tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic. It is fitted on all labels of sf_dir that the
    documents still have, but for the held-out third."""
    model = toxicity.fit(docs, toxicity.training_labels(read_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; see jaccard.keep_one."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two or more items go; single items' passages are cut out."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return pii.redact(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its bin, offset and the bin's length."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage_{name}")
    return docs


