"""From raw documents to packed training sequences: the stages, each written as Parquet and read again by the next.

Each stage takes any table with the columns doc_id, text and, for the language stage, lang; further columns go along, whatever
their names, and all stages but the last return the columns they got. Any column may hold nulls. An empty table gives an
empty result. What a stage does with null and empty texts, ties and repeated rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import decontaminate, language, packing, quality, simhash
from loomframe.llm.common import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from the labels table, is at least 0.3. Whole texts are scored; a null or empty
    text is one empty passage, and rows of one text stay or go alike, whatever their ids."""
    return quality.kept(docs, quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the documents' own lang column teaches; those go that are without a letter (null and empty
    texts too), without a clear language, or coded much worse than the language's own documents. Rows of one text stay or go
    alike, whatever their ids; a null lang teaches nothing."""
    return language.kept(docs, language.learned(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: the one of the smallest id, nulls last, then of the smallest fingerprint
    and digest of its text. Null and empty texts are one group, as are rows that repeat an id and a text. Fingerprints are
    linked at 3 of 64 differing bits, so copies that differ in more than a few words of a hundred are not found."""
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 13 words of a benchmark item anywhere, and of which less than a twentieth of the words
    lie in shorter items. Null and empty texts have no words and stay; rows of one text stay or go alike."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens. A null or empty text is one piece of the end
    token; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no tokenizers, trained models or XXH64; the tests hold the rows of run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
