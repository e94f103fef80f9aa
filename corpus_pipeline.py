"""A corpus pipeline: every stage reads the Parquet that the one before wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. A document stays as it is until the mix, where it appears as often as it is taken; the
last stage returns one row of token digests for each row of the mix.

Defined cases: a row without doc_id is no document and goes at the first stage; null, empty and
letterless texts go there too, for no language is found in them; identical rows become one in exact
dedup; any number of other columns, of whatever names, pass through to the mix; an empty table gives
an empty result. What the stages write for themselves is deleted when a stage's output is written.

Each stage sets the session's `spark.sql.execution.arrow.maxBytesPerBatch` to BATCH_BYTES, if it is more:
by rows alone, a batch has 10,000 whole texts, which the JVM and the Python worker hold some times over.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from granula.llm import bpe, exact, jaccard, langid, mixing
from granula.llm.common import delete, scratch, shared_dir
from granula.llm.queries import tokenizer_path


#: Bytes of the rows sent to a Python worker at a time; a longer text goes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(stage):
    """The stage with batches of BATCH_BYTES; it stays set, for the stage's table is computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
            spark.conf.set(_BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@by_bytes
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found."""
    return langid.keep_known(docs)


@by_bytes
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs)


@by_bytes
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


@by_bytes
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs)


@by_bytes
def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: Language ID is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
