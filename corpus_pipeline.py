"""Documents through quality classifier, quality rules, line dedup, near-duplicate join and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and those of any more columns
as they are, whatever their names. An empty table gives an empty one in each. `run` writes each stage's result as Parquet into the shared folder,
gives what it reads back to the next, and deletes what no later stage reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twigspark.functions.durable import remove
from twigspark.llm import line_dedup, ngram_join, packing, quality_model, quality_rules
from twigspark.llm.common import fresh_path, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more. The model learns from the labelled ones among docs.

    A null or empty text is scored like any other; a null or repeated doc_id is scored row by row; without both labels, all score the share of label 1 (0.5 without any) and stay if
    that is 0.3 or more."""
    return quality_model.keep(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A null or empty text has no words and goes; repeated rows are judged row by row."""
    return quality_rules.keep(docs)


def deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that at least ten documents hold, the first stays; documents left without a word go.

    The first is that of the smallest doc_id (null before all), then of the smallest position; rows of one doc_id are one document. Null and empty texts have no line to lose and stay."""
    return line_dedup.apply(docs, min_docs=10, drop="later")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity 0.8 or more. Of a line of 50 words or more that still several hold, the first stays.

    Of a component the row with the smallest doc_id stays (null last), of equal ones that with the smaller text digest, of rows equal in both one. Null and empty texts
    are near nothing and stay."""
    return line_dedup.apply(ngram_join.representatives(docs, words=5, num=80, den=100), min_docs=2, min_words=50, drop="later")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024. A null or empty text is its end id; rows that repeat a doc_id are packed row by row; equal places on the curve are ordered by doc_id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=1024)


STAGES = [("quality classifier", classified), ("quality rules", ruled), ("line dedup", deduped), ("n-gram Jaccard join", distinct), ("packing", packed)]

#: A trained classifier and a tokenizer take part, which SQL can't express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if k:
                remove(spark, before)
            before = path
    return docs
