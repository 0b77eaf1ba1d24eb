"""A corpus through five operators: quality, near duplicates, benchmark leaks, source mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. A
rerun after a failure can begin at any stage's file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brevia.llm import quality
from brevia.llm._stage import place, saved
from brevia.llm.decontaminate import decontaminate
from brevia.llm.mixing import mix
from brevia.llm.ngram_join import ngram_join
from brevia.llm.queries import table, vocabulary
from brevia.llm.token_files import token_files


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier predicts as 1, in one pass without a join.

    Each row is judged by its own text: a null id, or an id that repeats with another text, changes nothing. Null and empty
    texts are judged like any. Repeated rows go or stay together; other columns are kept; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, and of its repeated rows one.

    A doc_id with several texts is one document and keeps one row of each. Null and empty texts are in no group, so they
    stay (repeated rows once). Rows without a doc_id can't be told apart and stay. Other columns are kept.
    """
    rows = ngram_join(docs).rows
    gone = saved(rows.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    again = saved(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text leaks no benchmark item; each is judged by its own text, whatever its id.

    Null and empty texts leak nothing and stay; repeated rows go or stay together; other columns are kept.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the source targets ask for; a null source is a source of its own, rows without words count as size 0.

    Rows that repeat an id and its text draw alike. All columns are kept.
    """
    return mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token files: doc_id, start, n_tokens, ids_crc32, one row per row.

    Null ids come first, null and empty texts have the end id alone, and repeated rows stand side by side.
    """
    return token_files(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenised),
]

#: The classifier and the tokenizer can't be told in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = place(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
