"""From documents to token ids: each stage is one operator, its result written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.byte_bpe import decoded, encoded, split_pattern, vocabulary
from cohortlens.llm.decontaminate import without_contaminated
from cohortlens.llm.language import in_known_language
from cohortlens.llm.line_dedup import without_repeated_lines
from cohortlens.llm.near_dedup import one_of_each
from cohortlens.llm.stage import released, removed, staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; those without a language get the predicted one."""
    return in_known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words; emptied ones go."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), whatever its id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, exact``: token ids, and whether they decode to the text.

    Texts don't go through the tasks that decode; their SHA-256 does. The ids are staged, so
    that no task runs the Python that encodes beside the one that decodes.
    """
    vocab, pattern = vocabulary(), split_pattern()
    ids = encoded(docs.select("doc_id", "text"), vocab, pattern)
    ids = staged(ids.selectExpr("doc_id", "ids", "sha2(coalesce(text, ''), 256) as own"), "ids")
    rows = decoded(ids, vocab, pattern)
    return rows.selectExpr("doc_id", "ids", "octet_length(ids) div 4 as n_tokens", "sha2(decoded, 256) = own as exact")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: Language models, MinHash and BPE are beyond SQL; the stages' operators are tested one by
#: one against SQL or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from the table ``documents`` on.

    Each stage's result is written and read again; what it staged on the way, and the result
    before, is deleted once it is written. Of the last stage the ids are staged, which is all
    that its result reads. Null or repeated ids, null and empty texts, and
    columns with any names pass through as the stages' operators say: a row without a letter
    goes in the first, one of each group of near-duplicates stays whatever its id. An empty
    table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with released(spark) as paths:
            docs = staged(stage(spark, docs, sf_dir), name)
            result = paths.pop()
        if before:
            removed(spark, before)
        before = result
    rows = STAGES[-1][1](spark, docs, sf_dir)
    if before:
        removed(spark, before)
    return rows
