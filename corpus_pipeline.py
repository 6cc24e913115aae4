"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Nulls, ties and repeats, by stage: a document with a null text, or without a letter, goes in the first stage; documents
with a null id stay and link with nothing; of rows with equal ids all stay or go together; a null source is a source of
its own. Very long texts go through whole. Extra columns, whatever their names (dots and backticks among them), are carried
to the mixing stage's output: each stage works on numbered names and gives the columns theirs back. An empty table gives no rows, with the columns of the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import langid, mixing, ngram_join, packing, pii
from brindle.llm.common import shared_path, table
from brindle.llm.queries import vocabulary
from brindle.session import ship

#: A document this far from every language's profile is not text in any of them.
LEAST_SCORE = 0.1


#: The columns that stages read by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage with extra columns under numbered names while it runs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[n if n in KNOWN else f"_extra_{i}" for i, n in enumerate(names)]), sf_dir).toDF(*names)

    return run


@carrying
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter and resemble one of the languages that the labelled ones are in."""
    profiles = langid.fit_profiles(docs.select("doc_id", "text", "lang"))
    return langid.accepted(docs, profiles, LEAST_SCORE)


@carrying
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with Jaccard 0.8 or more, directly or through others, the smallest id stays."""
    groups = ngram_join.jaccard_components(docs, ngram_join.Rule(5, 80, 100))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    # Dealt by id at every size: what goes grows with the documents.
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@carrying
def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind."""
    return pii.redact(docs, pii.fit_field(docs))


@carrying
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("ngram_join", one_of_each), ("pii", without_pii), ("mixing", mixed), ("packing", packed)]
#: Loopy message passing, components and tokenizers have no SQL; a test holds run() against a plain Python version of all
#: five stages: which documents stay, how their texts change, how often they are taken, and each token id's place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
