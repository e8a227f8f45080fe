"""A training corpus from ``documents``, in five stages.

Each stage is a function of (spark, docs, sf_dir) that applies one of the
operators to all that the stage before kept; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next one's documents.
All but the last return the columns of the documents.  An empty table, or one
whose documents all go, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from residuum.llm.queries import END_ID, read, vocabulary_path
from residuum.llm.shared import Workspace, text_batches


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; all of them if there
    are no labels of both kinds to learn from."""
    held_out = F.crc32(F.col("_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), usable=~held_out, otherwise=toxicity.UNDECIDED)
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8, five words)."""
    text_batches(spark)
    return ngram_join.keep_representatives(docs, Workspace(spark, "pipeline-join"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not repeat the benchmark's passages."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), Workspace(spark, "pipeline-benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics."""
    return mixing.sample(docs, Workspace(spark, "pipeline-mixing"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of what is left, read back."""
    text_batches(spark)
    manifest = token_files.write_token_files(docs, Workspace(spark, "pipeline-tokens"), vocabulary_path(), END_ID)
    return token_files.read_token_files(manifest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("token output", token_output),
]

#: SQL can express neither the fitted score nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored for itself is deleted
    once its result is written."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        before = list(Workspace.live)
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{number}")
        for own in [w for w in Workspace.live if w not in before]:
            own.release()
    return docs
