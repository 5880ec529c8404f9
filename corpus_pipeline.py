"""A corpus pipeline in five stages: toxic documents go, one document of each near-duplicate group stays, documents with
benchmark passages go, secrets are blanked, and sources are mixed to target weights.

Each stage takes ``(spark, docs, sf_dir)`` and returns all documents that it keeps; all but the last return the columns of
``documents``. ``run`` writes each stage's documents as Parquet in the shared folder and gives them to the next.

Defined cases, beside the operators' own: rows with null or repeated ids are decided on one by one; columns other than ``doc_id``,
``text``, ``source`` and ``n_chars`` are passed on unread, whatever their names; the mix numbers its copies in ``copy``, or in ``copy_``
(or more underscores) if the documents have a column of that name.

A stage sets the session's bound on Arrow batches to ``BATCH_BYTES``: batches of long texts, held several times over by Spark and by the
Python workers, would take more of an executor's memory than the work itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import ngram_join, phrase_index, secret_scan, source_mix, toxicity
from gatelens.llm.tables import read_table, saved


BATCH_BYTES = 4 << 20
READ = ("doc_id", "text", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def of_documents(stage: Stage) -> Stage:
    """The stage with its columns' names, which can't clash with the documents' own: those that no stage reads go by number in it."""

    @wraps(stage)
    def on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        inner = docs.toDF(*(c if c.lower() in READ else f"other_{k}" for k, c in enumerate(docs.columns)))
        out = stage(spark, inner, sf_dir)
        taken, added = {c.lower() for c in docs.columns}, out.columns[len(docs.columns) :]
        for k, name in enumerate(added):
            while name.lower() in taken:
                name += "_"
            added[k] = name
        return out.toDF(*docs.columns, *added)

    return on


@of_documents
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic. The decision is made where the text is; nothing is shuffled."""
    chain = toxicity.corpus_chain(spark, sf_dir, docs)
    return toxicity.with_toxicity(docs, chain, "__toxicity").filter(F.col("__toxicity.toxic") == 0).drop("__toxicity")


def with_key(docs: DataFrame) -> DataFrame:
    """The documents, stored with a ``__key`` of each row: ids may be null or repeated, and each row is decided on by itself."""
    return saved(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")


def keys_as_ids(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("__key").alias("doc_id"), "text")


def without_keys(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key isn't among ``doc_id`` of ``keys``, which is stored: Spark knows its size and joins it accordingly."""
    gone = saved(keys.select(F.col("doc_id").alias("__gone")), "gone")
    return keyed.join(gone, keyed["__key"] == gone["__gone"], "left_anti").drop("__key")


#: Of the stage's shingles; op7's own contract has other values.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


@of_documents
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram join: that with the smallest id, null ids last, and of equal ids the first stored."""
    keyed = with_key(docs)
    found = ngram_join.jaccard_components(keys_as_ids(keyed), n=SHINGLE_WORDS, percent=SHINGLE_PERCENT).filter("n_component > 1").withColumnRenamed("doc_id", "__key")
    named = saved(found.select("__key", "component_id").join(keyed.select("__key", "doc_id"), "__key"), "components")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__key")).alias("first"))
    gone = named.join(first.select(F.col("first.__key").alias("__key")), "__key", "left_anti")
    return without_keys(keyed, gone.select(F.col("__key").alias("doc_id")))


@of_documents
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the phrase index finds no benchmark phrase."""
    keyed = with_key(docs)
    found = phrase_index.contamination(keys_as_ids(keyed), read_table(spark, sf_dir, "benchmark"))
    return without_keys(keyed, found.filter("n_hit > 0"))


@of_documents
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blanked."""
    return secret_scan.redacted(docs, secret_scan.fit(docs))


@of_documents
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks, numbered by ``copy``."""
    return source_mix.emit(source_mix.mix_plan(docs)).select(*docs.columns, "copy")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mix", mixed),
]

#: The classifiers can't be expressed in SQL; a test compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
