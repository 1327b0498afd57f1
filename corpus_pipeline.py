"""The corpus pipeline: score, deduplicate, decontaminate, replace personal data, tokenize.

Defined cases: a null or empty text scores the share of good labels, so it stays or goes
with that; it is no copy of anything, holds no test and no personal data, stays as it is
and has no tokens. Rows of one doc_id are one document to the deduplication, which keeps
or drops them all. A row without a doc_id is never a copy. Without labels every score is
one half, and nothing is kept; without a benchmark nothing is dropped for it. An empty
table gives an empty result. Columns beyond those of documents pass through, whatever
their names, as far as the last stage.
"""

from pyspark.sql import DataFrame, SparkSession

from meterbook.llm import bpe, decontaminate, neardup, quality, surrogates
from meterbook.llm.common import prepare, staged, table
from meterbook.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for them."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def drop_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text replaced by surrogates."""
    return surrogates.replace_personal(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text."""
    return bpe.tokenize(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_copies),
    ("benchmark decontamination", drop_tests),
    ("surrogates", replace_personal),
    ("byte-level tokens", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
